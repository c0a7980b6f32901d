"""Log-forensics analytics as Spark plans."""
