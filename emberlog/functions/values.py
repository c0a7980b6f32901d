"""Fixed values that results depend on: vocabularies, ranges, patterns and formats, stated as they are."""

# Action words of firewalls
ALLOW_WORDS = ["allow", "allowed", "accept", "accepted", "permit", "permitted", "pass", "permitir", "permitido", "aceptar", "aceptado"]
DENY_WORDS = ["block", "blocked", "deny", "denied", "drop", "dropped", "reject", "rejected", "discard", "bloquear", "bloqueado", "denegar", "denegado", "rechazado", "descartado", "reset-both", "reset-client", "reset-server", "drop-icmp"]
BLOCKING_RULE = r"(?i)(block|deny|drop|reject|bloq|deneg|rechaz)"
# Administration and legacy ports that should not leave the inner network
RISKY_PORTS = [21, 22, 23, 135, 137, 138, 139, 445, 1433, 3306, 3389, 5432, 5900, 5985, 5986]
# IPv4 ranges by scope, first match wins; anything else is public
IPV4_RANGES = [
    ("loopback", ["127.0.0.0/8"]),
    ("link_local", ["169.254.0.0/16"]),
    ("shared", ["100.64.0.0/10"]),
    ("private", ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"]),
    ("reserved", ["0.0.0.0/8", "192.0.0.0/24", "192.0.2.0/24", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4"]),
]
# IPv6 networks by scope, first match wins; anything else is public
IPV6_RANGES = [
    ("loopback", ["::1/128"]),
    ("link_local", ["fe80::/10"]),
    ("private", ["fc00::/7"]),
    ("public", ["2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]),
    ("reserved", ["::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "ff00::/8"]),
]
# A strict IPv4 text, octets without leading zeros
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
STRICT_IPV4 = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"
# Families of user agents
AGENT_FAMILIES = {
    "offensive_tool": r"sqlmap|nikto|nmap|masscan|zgrab|gobuster|dirbuster|ffuf|wfuzz|nuclei|burp",
    "scripted_client": r"scrapy|crawler4j|python-requests|python-urllib|aiohttp|httpx|go-http-client|okhttp|apache-httpclient|libwww|node-fetch|axios|curl|wget|powershell|java/",
    "api_client": r"postman|insomnia|httpie",
}
# Process names
LOLBINS = ["powershell.exe", "pwsh.exe", "rundll32.exe", "regsvr32.exe", "mshta.exe", "certutil.exe", "bitsadmin.exe", "wscript.exe", "cscript.exe", "msiexec.exe", "installutil.exe", "cmd.exe"]
OFFICE = ["winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe", "onenote.exe", "acrord32.exe", "acrobat.exe"]
SHELLS = ["cmd.exe", "powershell.exe", "pwsh.exe", "wscript.exe", "cscript.exe", "mshta.exe", "rundll32.exe", "regsvr32.exe"]
# Command-line flags in output order
COMMAND_FLAGS = [
    ("encoded", r"(?i)\s-(e|en|enc|enco|encodedcommand)\s+[a-z0-9+/=]{16,}"),
    ("download", r"(?i)(downloadstring|downloadfile|invoke-webrequest|\biwr\b|\bwget\b|\bcurl\b|urlcache|bitstransfer|/transfer)"),
    ("hidden", r"(?i)\s-w(indowstyle)?\s+hidden"),
    ("bypass", r"(?i)(executionpolicy\s+bypass|\s-ep\s+bypass|\s-nop(rofile)?\b)"),
    ("script_proxy", r"(?i)(mshta|regsvr32|rundll32)(\.exe)?\s.*(https?:|javascript:|scrobj|\.sct)"),
]
# Meanings of values
SEMANTICS = {
    "ipv4": r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$",
    "ipv6": r"^(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}$",
    "email": r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$",
    "url": r"^(?i:https?|ftp)://\S+$",
    "uri_path": r"^/\S*$",
    "http_request_line": r"^(?:GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH|CONNECT|TRACE) \S+ HTTP/\d(?:\.\d)?$",
    "http_method": r"^(?:GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH|CONNECT|TRACE)$",
    "http_status": r"^[1-5]\d\d$",
    "user_agent": r"(?i)^(?:mozilla/|curl/|wget|python-|go-http|java/|okhttp|postmanruntime|scrapy|crawler|sqlmap|nikto)",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "md5": r"^[0-9a-fA-F]{32}$",
    "sha1": r"^[0-9a-fA-F]{40}$",
    "sha256": r"^[0-9a-fA-F]{64}$",
    "mac": r"^(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$",
    "domain": r"^(?i:(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63})$",
    "windows_path": r"^(?:[A-Za-z]:\\|\\\\|\\Device\\)",
    "windows_sid": r"^S-1-\d+(?:-\d+)+$",
    "jwt": r"^eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*$",
}
SECRET_IN_VALUE = r"(?i)(?:^|[?&;\s])[a-z_]*(?:token|api[_-]?key|passw(?:or)?d|pwd|secret|auth|contrase(?:ñ|n)a|clave)[a-z_]*="
# Formats of values, first match wins
FORMATS = {
    "alias": r"^[A-Z]{1,6}-[0-9]{2,}$",
    "ipv4": r"^([0-9]{1,3}\.){3}[0-9]{1,3}$",
    "ipv6": r"^([0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}$",
    "email": r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$",
    "url": r"^(https?://|www\.)",
    "hash": r"^([0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$",
    "path": r"^([A-Za-z]:\\|\\|/)",
    "number": r"^-?[0-9]+(\.[0-9]+)?$",
}
# Masks of pseudonymised text
ID_SEGMENT = r"/([0-9]{3,}|[0-9A-Fa-f]{12,}|[0-9A-Fa-f]{8}-[0-9A-Fa-f-]{27})(/|$)"
EMAIL_MASK = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IP_MASK = r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b"
TOKEN_MASK = r"[A-Za-z0-9+/=_-]{24,}"
# Treatment of each canonical column in a pseudonymised copy
TREATMENTS = {
    "source_row": "keep",
    "timestamp_utc": "keep",
    "timestamp_raw": "keep",
    "http_method": "keep",
    "status_code": "keep",
    "bytes_out": "keep",
    "src_ip": "ip",
    "dst_ip": "ip",
    "user_id": "alias",
    "src_port": "keep",
    "dst_port": "keep",
    "protocol": "keep",
    "action": "keep",
    "rule_name": "keep",
    "application": "keep",
    "bytes_in": "keep",
    "process_name": "path",
    "parent_process": "path",
    "file_path": "path",
    "command_line": "cmd",
    "event_type": "keep",
    "process_id": "keep",
    "file_hash": "keep",
    "session_id": "alias",
    "host": "alias",
    "referer": "alias",
    "query_string": "mask_values",
    "endpoint": "mask_ids",
    "user_agent": "scrub",
}
# Prefixes of aliases
ALIAS_PREFIX = {"src_ip": "IP", "dst_ip": "DST", "user_id": "U", "session_id": "S", "host": "H", "referer": "REF", "process_name": "PROC", "parent_process": "PPROC", "file_path": "FILE", "command_line": "CMD"}
# Instructions hidden in log text, English and Spanish
INJECTION = {
    "ignore_instructions": r"(?i)\b(ignore|disregard|forget|override|bypass|ignora|olvida|omite|descarta)\b[^.\n]{0,40}\b(instructions?|prompts?|rules?|guidelines?|instrucciones|indicaciones|reglas)\b",
    "role_change": r"(?i)\b(you are now|you are an?|act as|from now on|act[uú]a como|eres un|ahora eres)\b",
    "system_markers": r"(?i)(system prompt|\bsystem\s*:|\bassistant\s*:|\bhuman\s*:|<\|[a-z_]+\|>|\[/?INST\]|###\s*(system|instruction))",
    "exfiltration": r"(?i)\b(reveal|print|show|send|exfiltrate|dump|muestra|revela|env[ií]a)\b[^.\n]{0,40}[^a-z0-9](token|password|secret|api[_ -]?key|credentials?|contrase[ñn]a|clave)([^a-z0-9]|$)",
}
# Patterns of indicators; the first group is the value
INDICATORS = {
    "hash": r"(?<![0-9A-Fa-f])([0-9A-Fa-f]{64}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{32})(?![0-9A-Fa-f])",
    "hex_run": r"(?<![0-9A-Za-z])([0-9A-Fa-f]{20,})(?![0-9A-Za-z])",
    "ipv4": r"(?<![\w.])((?:\d{1,3}\.){3}\d{1,3})(?!\w|\.\d)",
    "url": r"(?i)((?:https?|ftp)://[^\s<>\"'`\])]+)",
    "domain": r"(?<![\w@.-])((?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24})(?![\w-])",
    "onion": r"(?i)(?<![\w.-])([a-z2-7]{10,56}\.onion)(?![\w-])",
    "email": r"(?<![\w.%+-])([A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24})(?![\w-])",
    "cve": r"(?i)\b(CVE-\d{4}-\d{4,7})\b",
}
# How indicators are made unclickable, and what stands for it
REFANG = [(r"(?i)hxxp", "http"), (r"\[\s*:\s*//\s*\]", "://"), (r"(?i)[\[({]\s*(?:\.|dot)\s*[\])}]", "."), (r"(?i)[\[({]\s*(?:@|at)\s*[\])}]", "@"), (r"\[\s*:\s*\]", ":")]
# The counter of a page, such as 1/6 or 2 of 6
PAGE_COUNTER = r"\b\d{1,4}\s*(?:/|de|of)\s*\d{1,4}\b"
# Domain endings that count as indicators, without those that are file extensions
TLDS = ["com", "net", "org", "info", "biz", "edu", "gov", "mil", "int", "io", "co", "xyz", "top", "site", "online", "shop", "club", "app", "dev", "cloud", "tech", "store", "live", "icu", "vip", "work", "link", "click", "ac", "ae", "ar", "at", "au", "be", "bg", "br", "by", "ca", "ch", "cl", "cn", "cz", "de", "dk", "do", "ec", "ee", "es", "eu", "fi", "fr", "gb", "gr", "hk", "hr", "hu", "id", "ie", "il", "in", "ir", "is", "it", "jp", "kr", "kz", "lt", "lu", "lv", "mx", "my", "nl", "no", "nz", "pa", "pe", "ph", "pk", "pt", "ro", "ru", "se", "sg", "si", "sk", "th", "tr", "tw", "ua", "uk", "us", "uy", "ve", "vn", "za", "cc", "tv", "me", "gg", "ly", "to", "ws", "su", "pw", "tk", "ml", "ga", "cf", "gq", "cx", "la"]
KNOWN_SERVICES = ["x.com", "twitter.com", "torproject.org", "google.com", "microsoft.com", "github.com", "youtube.com", "facebook.com", "linkedin.com", "wikipedia.org", "mitre.org", "virustotal.com", "cisa.gov", "nist.gov", "sophos.com", "fortinet.com", "crowdstrike.com", "paloaltonetworks.com"]
# Stop words, ASCII-folded
STOP_EN = ["the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "by", "from", "at", "as", "is", "are", "was", "were", "be", "been", "it", "its", "this", "that", "these", "those", "not", "no", "but", "if", "then", "than", "which", "who", "whom", "their", "they", "them", "we", "you", "he", "she", "his", "her", "our", "your", "has", "have", "had", "do", "does", "did", "can", "could", "would", "should", "will", "may", "might", "also", "into", "over", "under", "between", "about", "after", "before", "such"]
STOP_ES = ["el", "la", "los", "las", "un", "una", "unos", "unas", "y", "o", "de", "del", "al", "en", "con", "por", "para", "como", "es", "son", "fue", "fueron", "ser", "se", "su", "sus", "lo", "le", "les", "que", "cual", "quien", "no", "pero", "si", "mas", "menos", "muy", "tambien", "entre", "sobre", "tras", "desde", "hasta", "este", "esta", "estos", "estas", "ese", "esa", "eso", "esto", "hay", "ha", "han", "he", "habia", "puede", "pueden", "donde", "cuando", "cuanto"]

#: Columns whose bare program names a copy keeps, and the endings of programs
PROGRAM_COLUMNS = ("process_name", "parent_process", "command_line", "file_path")
PROGRAM_ENDINGS = (".exe", ".dll", ".bat", ".cmd", ".ps1", ".com", ".scr", ".sys", ".msi")
