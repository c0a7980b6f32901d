"""Planted truth: detectors find exactly what generators planted, on real data and on the pseudonymised copy."""

from pyspark.sql import functions as F

from emberlog.operators import correlation, detectors, passages, privacy
from emberlog.plans import questions
from emberlog.plans.safe_sql import QueryEngine
from emberlog.plans.toolkit import Toolkit, review
from emberlog.sources import ingest, raw_profile, readers, synthetic


def test_web(spark):
    raw, bad = synthetic.web(spark)
    m = ingest.Mapping("web", {"uri": "http_uri", "status_code": "http_status", "src_ip": "source_ip", "user_agent": "http_user_agent", "http_method": "http_method"}, {"field": "timestamp", "format": "%Y-%d-%mT%H:%M"}, {"user_id": {"from": "http_uri", "regex": r"ATUSER-ID-(\d+)"}, "x_invoice_id": {"from": "http_uri", "regex": r"invoice_id=(\d+)", "type": "BIGINT"}})
    logs = ingest.canonical(raw, m).persist()
    assert logs.filter("timestamp_utc IS NULL").count() == 0
    assert {r.actor for r in detectors.resource_breadth(logs, "user_id", "x_invoice_id").collect()} <= bad
    assert {r.actor for r in detectors.automation_clients(logs).collect()} == bad
    assert {r.actor for r in detectors.activity_ramp(logs).collect()} == bad
    groups = detectors.actor_ip_cluster(logs).collect()
    assert len(groups) == 1 and set(groups[0].actors) == bad and groups[0].closed
    clean, _ = synthetic.web(spark, attackers=0)
    logs = ingest.canonical(clean, m)
    assert detectors.automation_clients(logs).count() == 0 and detectors.activity_ramp(logs).count() == 0


def test_firewall_endpoint_and_parity(spark):
    logs, truth = synthetic.firewall(spark)
    logs = logs.persist()
    found = detectors.run_all(logs, "network")
    for name, want in truth.items():
        rows = found[name].collect()
        got = {str(r[0]) for r in rows}
        assert got == want, name
    copy, tables = privacy.pseudonymize(logs)
    one = detectors.service_fanout(logs).select("actor", "services", "severity")
    two = detectors.service_fanout(copy).select("actor", "services", "severity")
    assert privacy.parity(one, two, tables["src_ip"]).count() == 0
    same = privacy.detector_parity(logs, copy, tables, "network")
    assert all(x["equivalent"] for x in same.values()) and len(same) >= 8, same
    ep, planted = synthetic.endpoint(spark, logs)
    hidden, ep_tables = privacy.pseudonymize(ep.persist())
    same = privacy.detector_parity(ep, hidden.persist(), ep_tables, "endpoint")
    assert all(x["equivalent"] for x in same.values()) and "lolbin_network" in same, same
    for name, want in planted.items():
        assert {r.host for r in detectors.REGISTRY[name][1](ep).collect()} == want, name
    ms = lambda d: d.select(F.col("source_row").alias("id"), "src_ip", "dst_ip", "dst_port", F.unix_millis("timestamp_utc").alias("ms"))
    got = correlation.correlate_project(ms(ep.filter("src_port IS NOT NULL AND host <> 'pc-lol'")), ms(logs.filter("action = 'ALLOW'")), within_ms=5000)
    assert got["skew_ms"] == 2500 and got["consistent"]
    whole = lambda d, *c: ms(d).join(d.select(F.col("source_row").alias("id"), *c), "id")
    got = correlation.correlate_project(whole(ep.filter("src_port IS NOT NULL AND host <> 'pc-lol'"), "host", "process_name"), ms(logs.filter("action = 'ALLOW'")), within_ms=5000)
    assert got["ip_hosts"].count() == got["ip_hosts"].select("ip").distinct().count() > 5
    assert all(1 <= len(r.processes) <= 3 for r in got["attributions"].collect())


def test_toolkit_and_review(spark):
    df = spark.createDataFrame([(i, f"u{i % 3}") for i in range(30)], "id long, user_id string").withColumn("timestamp_utc", F.timestamp_seconds(F.col("id") + 1_700_000_000))
    kit = Toolkit(QueryEngine(df))
    assert kit.run_query("SELECT user_id, count(*) AS n FROM logs GROUP BY 1 ORDER BY 1 LIMIT 2")["reproducible"]
    assert kit.profile("user_id")[0]["n"] == 10 and kit.build_timeline()[0]["n"] == 30 and kit.suspicious_text("user_id") == 0
    ok, out = review([{"id": "a", "sql": "SELECT id FROM logs"}, {"id": "a", "sql": "SELECT id FROM logs"}, {"id": "b", "sql": "DROP VIEW logs"}, {"id": "c", "sql": "SELECT nope FROM logs"}, {"id": "d", "canonical": "src_ip", "field": "x"}, {"id": "e", "canonical": "src_ip", "field": "user_id"}], df, {"src_ip"})
    assert [p["id"] for p in ok] == ["a", "e"] and out == [("a", "duplicate_id"), ("b", "policy_rejected"), ("c", "sql_error"), ("d", "unknown_field")]


def test_passages(spark, tmp_path):
    text = "short\n\n" + "long sentence here. " * 100 + "\n\nend\n\n" + "x" * 2500
    parts = [r.passage for r in passages.split(spark.createDataFrame([(1, 1, text)], "d int, p int, t string"), "d", "p", "t").orderBy("idx").collect()]
    assert all(len(p) <= 1100 for p in parts) and parts[0].startswith("short long") and parts[-1] == "x" * (len(parts[-1])) and "".join(parts).count("x") == 2500
    assert " ".join(parts[:2]).split() == text.split()[: len(" ".join(parts[:2]).split())] and len(parts[0]) > 1050
    told = passages.prepare_for_model([(3, "a" * 4000), (1, "b" * 4000)])
    assert told["pages"] == [3] and told["text"] == "[p.3] " + "a" * 4000 and told["chars"] == 4006
    df = spark.createDataFrame([(1, "evil.com 8.8.8.8")], "id int, text string")
    passages.write_iocs(df, "id", "text", str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "blocklist")).count() == 2


def test_styles_lead_to_the_same_log(spark, tmp_path):
    """A firewall log in each make's names, and as syslog lines, is proposed and read back as it was."""
    logs, _ = synthetic.firewall(spark, hosts=6, days=1)
    logs = logs.limit(300).persist()
    want = sorted((r.src_ip, r.dst_ip, r.dst_port, r.action) for r in logs.collect())
    names = ("src_ip", "dst_ip", "dst_port", "action", "src_port", "protocol", "rule_name")
    for style in synthetic.STYLES:
        raw = synthetic.styled(logs, style)
        fields = raw_profile.profile(raw)["mapping"]["fields"]
        assert {c: fields.get(c) for c in names} == {c: synthetic.STYLES[style][c] for c in names}, style
        m = ingest.Mapping(style, {c: fields[c] for c in names}, {"field": synthetic.STYLES[style]["timestamp_utc"], "format": "%Y-%m-%d %H:%M:%S"}, schema="network")
        got = ingest.canonical(raw, m).collect()
        assert sorted((r.src_ip, r.dst_ip, r.dst_port, r.action) for r in got) == want, style
        assert all(r.timestamp_utc is not None for r in got)
    synthetic.panos_syslog(logs).coalesce(1).write.text(str(tmp_path / "fw"))
    back, spec = readers.open_source(spark, str(tmp_path / "fw"))
    assert spec.format == "panos" and sorted((r.src_ip, r.dst_ip, int(r.dst_port) if r.dst_port else None, r.action) for r in back.collect()) == want
    ep, _ = synthetic.endpoint(spark, logs)
    fields = raw_profile.profile(synthetic.falcon(ep))["mapping"]["fields"]
    assert {fields[c] for c in ("host", "process_name", "command_line", "src_ip", "dst_ip")} == {"ComputerName", "ImageFileName", "CommandLine", "LocalAddressIP4", "RemoteAddressIP4"}


def test_more_questions(spark):
    logs, _ = synthetic.firewall(spark, hosts=6, days=1)
    ranges = spark.createDataFrame([(93 << 24, (94 << 24) - 1, "NL"), (8 << 24, (9 << 24) - 1, "US")], "lo long, hi long, label string")
    kind, got = questions.answer("which countries are the destinations", logs, ranges=ranges)
    assert kind == "countries" and got.columns == ["country", "events", "ips"]
    kind, got = questions.answer("How many IPs are there?", logs)
    sides = {r.side: r.ips for r in got.collect()}
    assert kind == "ip_counts" and sides["all"] >= max(sides["src_ip"], sides["dst_ip"])
    few = questions.answer("how many rows", logs, context={"src_ip": "10.0.0.1"})[1].first().n
    those = questions.answer("how many rows are those", logs, context={"src_ip": "10.0.0.1"})[1].first().n
    assert those < few == logs.count()
