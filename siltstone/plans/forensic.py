"""Queries on logs, packets, processes, permissions and rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import catalog as C
from siltstone.operators import logs as L
from siltstone.operators import memory as M
from siltstone.operators import network as N
from siltstone.operators import security as S
from siltstone.runtime import table
from siltstone.sources import sinks
from siltstone.sources.files import decode_captures

_LINE = r"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ) (\S+?)\[(\d+)\]: rc=(\d+) sz=(\d+) id=(\S+)"


def device_lines(spark, d) -> DataFrame:
    """Device log lines inside the documents."""
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(f"^{_LINE}$"))
    part = lambda k: F.regexp_extract("line", _LINE, k)
    return lines.select("doc_id", F.unix_micros(part(1).cast("timestamp")).alias("ts_us"), part(2).alias("host"), part(3).cast("int").alias("pid"), part(4).cast("int").alias("rc"), part(5).cast("bigint").alias("size"), part(6).alias("mark"))


def device_line_summary(spark, d):
    return device_lines(spark, d).groupBy("host", "rc").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


def _event_logs(spark, d) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "Warning").when(F.col("event_type") == "view", "debug").otherwise("INFO")
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("app"), F.col("user_id") % 17).alias("source"), level.alias("level"), F.concat_ws(" ", "event_type", "props").alias("message"),
        F.concat(F.lit("node"), F.col("user_id") % 5).alias("host"), F.col("event_type").alias("process"), (F.col("user_id") % 1000).cast("int").alias("pid"),
    )


def log_filter(spark, d):
    logs = L.filter_logs(_event_logs(spark, d), start="2024-01-05", end="2024-01-20", source="APP1", host="node", keyword="K", classes=("error", "warning", "info"))
    return logs.select("event_id", "source", "level", "message")


def log_statistics(spark, d):
    got = L.log_statistics(_event_logs(spark, d), "host")
    return got.withColumns({"first_ts": F.unix_micros("first_ts"), "last_ts": F.unix_micros("last_ts")})


def log_first_sources(spark, d):
    return L.first_sources(_event_logs(spark, d), "event_id")


def log_top_sources(spark, d):
    return L.top_sources(_event_logs(spark, d))


def log_search(spark, d):
    return L.search_logs(_event_logs(spark, d), "RR", case_sensitive=False)


#: Lines in the usual forms, as a log collector meets them.
_SAMPLES = (
    ("a.log", "Jan 15 10:30:45 server1 sshd[2345]: Failed password error for root"), ("b.txt", "Jan  5 10:30:46 server1 systemd[1]: Started warning service"),
    ("c.log", '10.0.0.7 - - [15/Jan/2024:10:30:45 +0000] "GET /index.html HTTP/1.1" 404 512'), ("d.log", '{"ts": "2024-01-15T10:30:45Z", "level": "ERROR", "message": "disk full", "pid": 7}'),
    ("e.json", "x"), ("f.csv", "2024-01-15 10:30:45,app,warn,slow,host1,proc,9"), ("g.log", "free text with a fatal flaw"), ("h.log", ""),
)


def _samples(spark) -> DataFrame:
    return spark.createDataFrame(list(_SAMPLES), "path string, value string")


def log_formats(spark, d):
    kind = L.detect_format(F.col("path"), F.col("value"))
    return _samples(spark).select("path", kind.alias("format"), L.format_description(kind).alias("description"))


def log_parsed(spark, d):
    """Each sample line through the parser of its format."""
    lines = _samples(spark).withColumn("format", L.detect_format(F.col("path"), F.col("value")))
    out = None
    for name in ("syslog", "apache", "json", "csv", "custom"):
        rows = L.PARSERS[name](lines.where(F.col("format") == name))
        out = rows if out is None else out.unionByName(rows)
    return out.select(F.unix_seconds("ts").alias("ts_s"), "source", "level", "message", "host", "process", "pid")


def log_written(spark, d):
    return L.formatted(_event_logs(spark, d), "syslog")


def _packets(spark, d) -> DataFrame:
    """Packets from order lines: supplier to part, port by line number."""
    ports = F.array(*map(F.lit, (80, 443, 53, 22, 4444, 8080, 25)))
    i = table(spark, d, "lineitem")
    return i.select(
        (F.lit(0x0A000000) + F.col("l_suppkey") % 40).alias("src_ip"), (F.lit(0xC0A80000) + F.col("l_partkey") % 50).alias("dst_ip"), (F.lit(40_000) + F.col("l_orderkey") % 20_000).cast("int").alias("src_port"),
        F.element_at(ports, F.col("l_linenumber") % 7 + 1).alias("dst_port"), F.when(F.col("l_returnflag") == "A", N.NUMBER["UDP"]).when(F.col("l_returnflag") == "R", N.NUMBER["ICMP"]).otherwise(N.NUMBER["TCP"]).alias("protocol"),
        F.col("l_quantity").cast("bigint").alias("packet_size"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price"),
    )


def _connections(spark, d) -> DataFrame:
    per = _packets(spark, d).groupBy("src_ip", "dst_ip", "dst_port", "protocol").agg(F.count(F.lit(1)).alias("packet_count"), F.sum("packet_size").alias("size"), F.sum("price").alias("price"))
    return per.select("src_ip", "dst_ip", "dst_port", "protocol", "packet_count", F.col("price").alias("bytes_sent"), F.when(F.col("dst_port") == 53, 0).otherwise(F.col("size")).alias("bytes_received"))


def captured_packets(spark, d):
    """Capture files, one for each customer's orders in either byte order, decoded packet by packet."""
    big = lambda n, size: F.lpad(F.hex(n), 2 * size, "0")
    swapped = lambda n: F.concat(*(F.substring(big(n, 4), 7 - 2 * k, 2) for k in range(4)))
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("bigint").alias("k"), F.col("o_custkey").cast("bigint").alias("c"))
    tcp = F.col("k") % 2 == 0
    ports = F.concat(big(F.col("k") % 60_000 + 1024, 2), big(F.when(tcp, 80).otherwise(53).cast("bigint"), 2))
    body = F.when(tcp, F.concat(ports, F.lit("00" * 8), F.lit("50"), F.lit("00" * 7))).otherwise(F.concat(ports, F.lit("00" * 4)))
    ip = F.concat(F.lit("45" + "00" * 8), F.when(tcp, "06").otherwise("11"), F.lit("0000"), big(F.lit(0x0A000000) + F.col("k") % 65_536, 4), big(F.lit(0xC0A80000) + F.col("c") % 65_536, 4))
    frame = F.concat(F.lit("00" * 12 + "0800"), ip, body, F.lit("6869"))
    n = (F.length(frame) / 2).cast("bigint")
    little = F.col("c") % 2 == 0
    head = lambda x: F.when(little, swapped(x)).otherwise(big(x, 4))
    packet = F.concat(head(F.lit(1_700_000_000) + F.col("k") % 1000), head(F.lit(5).cast("bigint")), head(n), head(n + 100), frame)
    mark = F.when(F.col("c") % 2 == 0, "D4C3B2A1").otherwise("A1B2C3D4")
    files = o.groupBy("c").agg(F.concat_ws("", F.sort_array(F.collect_list(packet))).alias("packets"))  # some orders a customer
    raw = files.select(F.col("c").cast("string").alias("path"), F.unhex(F.concat(mark, F.lit("00" * 20), F.col("packets"))).alias("content"))
    got = decode_captures(raw)
    return got.select("path", F.unix_micros("ts").alias("ts_us"), "packet_size", N.ip_to_string(F.col("src_ip")).alias("src"), N.ip_to_string(F.col("dst_ip")).alias("dst"), "src_port", "dst_port", N.protocol_name(F.col("protocol")).alias("protocol"), F.decode("payload", "UTF-8").alias("payload"))


def packet_rate(spark, d):
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    return N.packet_rate(e).select("packets", F.round("seconds", 3).alias("seconds"), F.round("packets_per_second", 6).alias("packets_per_second"))


def log_round_trip(spark, d):
    """Every event written as a line of one of three formats and parsed again."""
    logs = _event_logs(spark, d).withColumn("ts", F.date_trunc("second", "ts"))
    out = None
    for k, style in enumerate(("syslog", "json", "csv")):
        some = logs.where(F.col("event_id") % 3 == k)
        rows = L.parse_syslog(L.formatted(some, style), year=2024) if style == "syslog" else L.PARSERS[style](L.formatted(some, style))
        rows = rows.groupBy(F.lit(style).alias("style"), "process", "pid", F.unix_micros("ts").alias("ts_us"), "message").agg(F.count(F.lit(1)).alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


def known_rootkits(spark, d):
    """Files of the catalog that carry the name of a known rootkit."""
    kits = spark.createDataFrame(list(M.KNOWN_ROOTKITS), "rootkit string, description string, how_to_find string")
    files = C.current(table(spark, d, "file_entry"), ["full_path"]).where("full_path is not null").withColumn("low", F.lower("full_path"))
    found = S.find_patterns(files, "file_id", "low", kits.select(F.lower("rootkit").alias("pattern")))
    return found.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def memory_summary(spark, d):
    return sinks.memory_report(M.process_behaviour(_processes(spark, d)), M.connection_behaviour(_sockets(spark, d)))


def network_statistics(spark, d):
    got = N.packet_statistics(_packets(spark, d))
    return got.select(N.protocol_name(F.col("protocol")).alias("protocol"), "packets", "bytes", "suspicious", F.round("average_size", 6).alias("average_size"))


def network_flood_targets(spark, d):
    return N.flood_targets(_packets(spark, d), 1000, 0.0195)


def network_port_scans(spark, d):
    return N.port_scans(_packets(spark, d), 50, 5)


def network_exfiltration(spark, d):
    return N.exfiltration(_connections(spark, d)).select(N.ip_to_string(F.col("src_ip")).alias("src"), N.ip_to_string(F.col("dst_ip")).alias("dst"), "dst_port", "bytes_sent")


def network_command_and_control(spark, d):
    listed = spark.createDataFrame([(0xC0A80007,), (0xC0A80009,)], "dst_ip long")
    return N.command_and_control(_connections(spark, d), listed).select("src_ip", "dst_ip", "dst_port", "protocol")


def network_threats(spark, d):
    _, labelled = N.label_threats(_packets(spark, d), _connections(spark, d))
    return labelled.groupBy("threat_type").agg(F.count(F.lit(1)).alias("n"))


def network_connection_threats(spark, d):
    return N.connection_threat(_connections(spark, d)).where("is_suspicious").select("src_ip", "dst_ip", "dst_port", "protocol", "threat_type", "confidence")


def network_applications(spark, d):
    payload = F.when(F.col("dst_port") == 8080, F.encode(F.lit("GET / HTTP/1.1"), "UTF-8")).otherwise(F.encode(F.lit("data"), "UTF-8"))
    app = N.application_protocol(F.col("src_port"), F.col("dst_port"), F.col("protocol"), payload)
    return _packets(spark, d).groupBy(N.protocol_name(app).alias("application"), N.protocol_description(app).alias("description")).agg(F.count(F.lit(1)).alias("n"))


def _processes(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    names = F.array(*map(F.lit, ("explorer.exe", "trojan.exe", "svchost.exe", "hidden.exe", "injector", "chrome.exe", "MALWARE.EXE")))
    return c.select(
        F.col("c_custkey").alias("process_id"), F.element_at(names, (F.col("c_custkey") % 7 + 1).cast("int")).alias("process_name"), (F.col("c_custkey") % 131).cast("int").alias("thread_count"),
        (F.col("c_custkey") % 90 * 12_000_000).alias("virtual_size"), (F.col("c_custkey") % 40 * 1_000_000).alias("working_set_size"),
    )


def _sockets(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    ports = F.array(*map(F.lit, (80, 443, 4444, 445, 31337, 22)))
    return o.select(
        F.col("o_orderkey").alias("socket_id"), F.when(F.col("o_custkey") % 3 == 0, 0x08080808).otherwise(0x0A000005).alias("local_ip"), (F.lit(0xC0A80100) + F.col("o_custkey") % 256).alias("remote_ip"),
        F.element_at(ports, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("remote_port"), F.when(F.col("o_orderstatus") == "F", 6).when(F.col("o_orderstatus") == "O", 17).otherwise(47).alias("protocol"),
    )


def memory_processes(spark, d):
    judged = M.process_behaviour(_processes(spark, d))
    rootkit = M.known_rootkit(F.col("process_name"), F.col("is_suspicious"), F.col("confidence"))
    return judged.select("process_id", "is_suspicious", "threat_type", "confidence", M.known_malware(F.col("process_name")).alias("malware"), rootkit.alias("rootkit"))


def memory_connections(spark, d):
    judged = M.listed_connections(M.connection_behaviour(_sockets(spark, d)))
    return judged.select("socket_id", "is_suspicious", "threat_type", "confidence", "bad_ip", "risky_port")


def memory_injection(spark, d):
    return M.injection_count(_processes(spark, d))


def memory_rootkit_activity(spark, d):
    return M.rootkit_activity(M.process_behaviour(_processes(spark, d)), M.connection_behaviour(_sockets(spark, d)))


def _permissions(spark, d) -> DataFrame:
    rows = C.current_rows(table(spark, d, "metadata_info"), ["metadata_id"], "received_at", ["full_path", "is_directory", "owner_id", "group_name", "permissions"])
    return rows.where("full_path is not null").select("metadata_id", F.col("full_path").alias("path"), "is_directory", "owner_id", "group_name", F.col("permissions").alias("mode"))


def permission_findings(spark, d):
    return S.analyse_permissions(_permissions(spark, d)).select("metadata_id", "issue", "severity", "is_insecure")


def permission_patterns(spark, d):
    return S.insecure_patterns(_permissions(spark, d)).groupBy("issue", "severity").agg(F.count(F.lit(1)).alias("n"))


def permission_risks(spark, d):
    return S.permission_risks(_permissions(spark, d)).select("metadata_id", "escalation", "disclosure", "unauthorized_access", "bypass", "group_risk")


def permission_inheritance(spark, d):
    """World-writable files below directories that are not, over the catalog's paths."""
    files = C.current(table(spark, d, "file_entry"), ["full_path", "mode"]).where("full_path is not null")
    folders = files.select(F.regexp_extract("full_path", r"^(.*)[/\\][^/\\]*$", 1).alias("path")).distinct().select("path", F.lit(True).alias("is_directory"), F.lit(0o40755).alias("mode"))
    return S.inheritance_violations(files.select(F.col("full_path").alias("path"), F.lit(False).alias("is_directory"), "mode").unionByName(folders))


#: A small vulnerability table: identifier, software, severity, score, exploitable.
_VULNERABILITIES = (("V-1", "steel", "Critical", 9.8, True), ("V-2", "copper", "High", 7.5, False), ("V-3", "brass", "High", 7.5, True), ("V-4", "large", "Low", 2.1, False))


def _vulnerabilities(spark) -> DataFrame:
    return spark.createDataFrame(list(_VULNERABILITIES), "vulnerability_id string, affected_software string, severity string, cvss_score double, is_exploitable boolean")


def vulnerability_matches(spark, d):
    return S.match_vulnerabilities(table(spark, d, "part").select(F.lower("p_name").alias("name")), _vulnerabilities(spark))


def vulnerability_priorities(spark, d):
    return S.prioritise(_vulnerabilities(spark), 3).select("vulnerability_id", "severity")


def _policies(spark, d, side: int) -> DataFrame:
    n = table(spark, d, "nation")
    return n.where(F.col("n_nationkey") % 7 != side).select(F.element_at(F.array(*map(F.lit, S.POLICY_TYPES)), F.col("n_nationkey") % 6 + 1).alias("type"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 5 == side, "off").otherwise("on").alias("value"))


def policy_baseline(spark, d):
    return S.compare_to_baseline(_policies(spark, d, 1), _policies(spark, d, 2))


def security_audit(spark, d):
    policies = policy_baseline(spark, d).select((F.col("status") == "match").alias("is_compliant"))
    got = S.audit_score(S.analyse_permissions(_permissions(spark, d)), _vulnerabilities(spark), policies)
    return got.withColumn("score", F.round("score", 9))


def rule_matches(spark, d):
    rules = spark.createDataFrame([("quota", "quota", 3, True), ("tape", "tape", 8, True), ("off", "the", 9, False), ("volume", "volumen V", 6, True)], "rule string, pattern string, severity int, enabled boolean")
    found = S.scan_rules(table(spark, d, "documents"), rules, "doc_id", "text")
    return found.select("doc_id", "rule", S.rule_severity(F.col("severity")).alias("severity"), "offset")


def vulnerability_counts(spark, d):
    """Report of the matches over all parts, each vulnerability as often as it was found."""
    found = vulnerability_matches(spark, d).select("vulnerability_id").join(_vulnerabilities(spark), "vulnerability_id")
    return sinks.vulnerability_report(found)


def compliance_summary(spark, d):
    met = policy_baseline(spark, d).select((F.col("status") == "match").alias("is_compliant"))
    return sinks.compliance_report(met).withColumn("percent", F.round("percent", 6))


def audit_lines(spark, d):
    return sinks.audit_report(security_audit(spark, d).withColumn("score", F.round("score", 4)))


def remediation_steps(spark, d):
    met = policy_baseline(spark, d).select("name", (F.col("status") == "match").alias("is_compliant"), F.when(F.col("status") == "missing", "High").otherwise("Low").alias("severity"))
    return S.remediation_plan(met)


def template_policies(spark, d):
    """Policies made from templates, one for each part type."""
    kinds = table(spark, d, "part").select("p_type").distinct()
    templates = kinds.select(F.lit("Audit").alias("type"), F.col("p_type").alias("template_name"), F.lit(None).cast("string").alias("description"), F.when(F.col("p_type").contains("STEEL"), "check").alias("recommended_setting"), F.lit("High").alias("severity_if_violated"))
    return S.policies_from_templates(templates)


_LOGS = """(SELECT event_id, ts, 'app' || user_id % 17 AS source, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'Warning' WHEN 'view' THEN 'debug' ELSE 'INFO' END AS level,
  event_type || ' ' || props AS message, 'node' || user_id % 5 AS host, event_type AS process, user_id % 1000 AS pid FROM events)"""
_LINES = r"""(SELECT doc_id, epoch_us(regexp_extract(line, '^(\S+)', 1)::TIMESTAMPTZ) AS ts_us, regexp_extract(line, 'Z (\S+?)\[', 1) AS host, regexp_extract(line, '\[(\d+)\]', 1)::INTEGER AS pid,
  regexp_extract(line, 'rc=(\d+)', 1)::INTEGER AS rc, regexp_extract(line, 'sz=(\d+)', 1)::BIGINT AS size, regexp_extract(line, 'id=(\S+)', 1) AS mark
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_full_match(line, '(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ) (\S+?)\[(\d+)\]: rc=(\d+) sz=(\d+) id=(\S+)'))"""
_PACKETS = """(SELECT 167772160 + l_suppkey % 40 AS src_ip, 3232235520 + l_partkey % 50 AS dst_ip, CAST(40000 + l_orderkey % 20000 AS INTEGER) AS src_port, ([80, 443, 53, 22, 4444, 8080, 25])[l_linenumber % 7 + 1] AS dst_port,
  CASE l_returnflag WHEN 'A' THEN 5 WHEN 'R' THEN 6 ELSE 4 END AS protocol, CAST(l_quantity AS BIGINT) AS packet_size, CAST(round(l_extendedprice * 100) AS BIGINT) AS price FROM lineitem)"""
_CONNECTIONS = f"""(SELECT src_ip, dst_ip, dst_port, protocol, packet_count, CAST(price AS BIGINT) AS bytes_sent, CAST(CASE WHEN dst_port = 53 THEN 0 ELSE size END AS BIGINT) AS bytes_received
  FROM (SELECT src_ip, dst_ip, dst_port, protocol, count(*) AS packet_count, sum(packet_size) AS size, sum(price) AS price FROM {_PACKETS} GROUP BY ALL))"""
_IP = "({0} >> 24) || '.' || (({0} >> 16) & 255) || '.' || (({0} >> 8) & 255) || '.' || ({0} & 255)"
_NAME = "CASE {0} " + " ".join(f"WHEN {n} THEN '{name}'" for n, name, _ in N.PROTOCOLS) + " END"
_TEXT = "CASE {0} " + " ".join(f"WHEN {n} THEN '{text}'" for n, _, text in N.PROTOCOLS) + " END"
_PROCESSES = """(SELECT c_custkey AS process_id, (['explorer.exe', 'trojan.exe', 'svchost.exe', 'hidden.exe', 'injector', 'chrome.exe', 'MALWARE.EXE'])[c_custkey % 7 + 1] AS process_name, c_custkey % 131 AS thread_count,
  c_custkey % 90 * 12000000 AS virtual_size, c_custkey % 40 * 1000000 AS working_set_size FROM customer)"""
_JUDGED = f"""(SELECT *, CASE WHEN regexp_matches(process_name, 'malware|trojan|virus|backdoor|keylogger|ransomware|spyware|rootkit|inject|hack') THEN 'Suspicious Process Name' WHEN thread_count > 100 THEN 'Unusual Thread Count' WHEN virtual_size > 1000000000 THEN 'Large Virtual Memory' END AS t FROM {_PROCESSES})"""
_SOCKETS = """(SELECT o_orderkey AS socket_id, CASE WHEN o_custkey % 3 = 0 THEN 134744072 ELSE 167772165 END AS local_ip, 3232235776 + o_custkey % 256 AS remote_ip, ([80, 443, 4444, 445, 31337, 22])[o_orderkey % 6 + 1] AS remote_port,
  CASE o_orderstatus WHEN 'F' THEN 6 WHEN 'O' THEN 17 ELSE 47 END AS protocol FROM orders)"""
_JUDGED_SOCKETS = f"(SELECT *, CASE WHEN remote_port IN (4444, 31337) THEN 'Connection to malicious port' WHEN local_ip = 134744072 THEN 'Connection to private network from public IP' WHEN protocol = 47 THEN 'Unusual protocol' END AS t FROM {_SOCKETS})"
_PERMISSIONS = "(SELECT metadata_id, full_path AS path, is_directory, owner_id, group_name, permissions AS mode FROM metadata_info WHERE full_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY metadata_id ORDER BY received_at DESC) = 1)"
_SECRET = "regexp_matches(path, '\\.key|\\.pem|\\.priv|\\.private|\\.secret|\\.pass|\\.password')"
_FINDING = f"(SELECT *, CASE WHEN mode & 2 <> 0 THEN 'World-writable permissions pose security risk' WHEN mode & 3072 <> 0 AND owner_id <> 0 THEN 'SUID/SGID bit set on non-root owned file' WHEN mode & 4 <> 0 AND {_SECRET} THEN 'Sensitive file with world-readable permissions' END AS issue FROM {_PERMISSIONS})"
_POLICY = "SELECT (['Password', 'Account', 'Audit', 'Privilege', 'Network', 'Encryption'])[n_nationkey % 6 + 1] AS type, n_name AS name, CASE WHEN n_nationkey % 5 = {0} THEN 'off' ELSE 'on' END AS value FROM nation WHERE n_nationkey % 7 <> {0}"
_BASELINE = f"""(SELECT coalesce(a.type, b.type) AS type, coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'missing' WHEN a.name IS NULL THEN 'extra' WHEN a.value = b.value THEN 'match' ELSE 'changed' END AS status
  FROM ({_POLICY.format(2)}) a FULL JOIN ({_POLICY.format(1)}) b ON a.type = b.type AND a.name = b.name)"""

QUERIES = {
    f.__name__: f
    for f in (
        device_lines, device_line_summary, log_filter, log_statistics, log_first_sources, log_top_sources, log_search, log_formats, log_parsed, log_written, network_statistics, network_flood_targets, network_port_scans,
        network_exfiltration, network_command_and_control, network_threats, network_connection_threats, network_applications, memory_processes, memory_connections, memory_injection, memory_rootkit_activity,
        captured_packets, packet_rate, log_round_trip, known_rootkits, memory_summary, vulnerability_counts, compliance_summary, audit_lines, remediation_steps, template_policies,
        permission_findings, permission_patterns, permission_risks, permission_inheritance, vulnerability_matches, vulnerability_priorities, policy_baseline, security_audit, rule_matches,
    )
}

SQL = {
    "log_written": f"SELECT strftime(ts, '%b %d %H:%M:%S') || ' ' || host || ' ' || process || '[' || pid || ']: ' || message AS value FROM {_LOGS}",
    "log_round_trip": f"""
SELECT style, process, pid::INTEGER AS pid, epoch_us(date_trunc('second', ts)) AS ts_us, message, count(*) AS n
FROM (SELECT *, (['syslog', 'json', 'csv'])[event_id % 3 + 1] AS style FROM {_LOGS}) GROUP BY ALL""",
    "log_formats": """
SELECT * FROM (VALUES ('a.log', 'syslog', 'Syslog format'), ('b.txt', 'syslog', 'Syslog format'), ('c.log', 'apache', 'Apache Common Log Format'), ('d.log', 'json', 'JSON Log Format'), ('e.json', 'json', 'JSON Log Format'),
  ('f.csv', 'csv', 'CSV Log Format'), ('g.log', 'custom', 'Custom Log Format'), ('h.log', NULL, 'Unknown format')) t(path, format, description)""",
    "log_parsed": """
SELECT * FROM (VALUES (1247445::BIGINT, 'syslog', 'error', 'Failed password error for root', 'server1', 'sshd', 2345), (383446, 'syslog', 'warn', 'Started warning service', 'server1', 'systemd', 1),
  (1705314645, 'apache', 'warn', 'GET /index.html HTTP/1.1', '10.0.0.7', NULL, NULL), (1705314645, 'json', 'error', 'disk full', NULL, NULL, 7), (NULL, 'json', 'info', 'x', NULL, NULL, NULL),
  (1705314645, 'app', 'warn', 'slow', 'host1', 'proc', 9), (NULL, 'custom', 'fatal', 'free text with a fatal flaw', NULL, NULL, NULL)) t(ts_s, source, level, message, host, process, pid)""",
    "captured_packets": """
SELECT o_custkey::VARCHAR AS path, (1700000000 + o_orderkey % 1000) * 1000000 + 5 AS ts_us, (CASE WHEN o_orderkey % 2 = 0 THEN 56 ELSE 44 END + 100)::BIGINT AS packet_size, '10.0.' || (o_orderkey % 65536 >> 8) || '.' || (o_orderkey % 256) AS src,
  '192.168.' || (o_custkey % 65536 >> 8) || '.' || (o_custkey % 256) AS dst, (o_orderkey % 60000 + 1024)::INTEGER AS src_port, CASE WHEN o_orderkey % 2 = 0 THEN 80 ELSE 53 END AS dst_port, CASE WHEN o_orderkey % 2 = 0 THEN 'TCP' ELSE 'UDP' END AS protocol, 'hi' AS payload FROM orders""",
    "packet_rate": "SELECT count(*) AS packets, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS seconds, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS packets_per_second FROM events",
    "known_rootkits": "SELECT pattern, count(*) AS n FROM (SELECT * FROM file_entry QUALIFY row_number() OVER (PARTITION BY volume_id, file_id ORDER BY seq DESC) = 1), (VALUES "
    + ", ".join(f"('{name.lower()}')" for name, *_ in M.KNOWN_ROOTKITS) + ") k(pattern) WHERE NOT deleted AND contains(lower(full_path), pattern) GROUP BY 1",
    "memory_summary": f"SELECT 'processes' AS section, count(*) AS n, count(t) AS suspicious FROM {_JUDGED} UNION ALL SELECT 'connections', count(*), count(t) FROM {_JUDGED_SOCKETS}",
    "vulnerability_counts": """
SELECT severity, count(*) AS n, count(*) FILTER (WHERE x) AS exploitable, max(score)::DOUBLE AS worst
FROM (SELECT DISTINCT lower(p_name) AS name FROM part), (VALUES ('steel', 'Critical', 9.8, true), ('copper', 'High', 7.5, false), ('brass', 'High', 7.5, true), ('large', 'Low', 2.1, false)) v(s, severity, score, x) WHERE contains(name, s) GROUP BY 1""",
    "compliance_summary": f"SELECT count(*) AS checked, count(*) FILTER (WHERE status = 'match') AS compliant, count(*) FILTER (WHERE status <> 'match') AS violations, round(count(*) FILTER (WHERE status = 'match') * 100 / count(*), 6) AS percent FROM {_BASELINE}",
    "remediation_steps": f"SELECT name, 'Remediate ' || name AS action, CASE WHEN status = 'missing' THEN 'Medium' ELSE 'Low' END AS effort FROM {_BASELINE} WHERE status <> 'match'",
    "template_policies": "SELECT DISTINCT 'Audit' AS type, p_type AS name, 'Template-based policy' AS description, false AS is_compliant, 'Policy not yet evaluated' AS violation_details, CASE WHEN contains(p_type, 'STEEL') THEN 'check' ELSE 'No recommendation' END AS recommended_action, 'High' AS severity FROM part",
    "device_lines": f"SELECT * FROM {_LINES}",
    "device_line_summary": f"SELECT host, rc, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, min(ts_us) AS first_us, max(ts_us) AS last_us FROM {_LINES} GROUP BY 1, 2",
    "log_filter": f"SELECT event_id, source, level, message FROM {_LOGS} WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND contains(source, 'app1') AND contains(lower(message), 'k') AND level <> 'debug'",
    "log_statistics": f"SELECT host, count(*) AS total, count(*) FILTER (WHERE level = 'ERROR') AS error_count, count(*) FILTER (WHERE level = 'Warning') AS warning_count, count(*) FILTER (WHERE level = 'INFO') AS info_count, count(*) FILTER (WHERE level = 'debug') AS debug_count, epoch_us(min(ts)) AS first_ts, epoch_us(max(ts)) AS last_ts FROM {_LOGS} GROUP BY 1",
    "log_first_sources": f"SELECT source, min(event_id) AS first_seen FROM {_LOGS} GROUP BY 1 ORDER BY 2 LIMIT 10",
    "log_top_sources": f"SELECT source, count(*) AS n FROM {_LOGS} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "log_search": f"SELECT CAST(sum(length(m) - length(replace(m, 'rr', 'r'))) AS BIGINT) AS n FROM (SELECT lower(message) AS m FROM {_LOGS})",
    "network_statistics": f"SELECT {_NAME.format('protocol')} AS protocol, count(*) AS packets, CAST(sum(packet_size) AS BIGINT) AS bytes, count(*) FILTER (WHERE protocol = 4 AND dst_port IN (4444, 1337)) AS suspicious, round(avg(packet_size), 6) AS average_size FROM {_PACKETS} GROUP BY protocol",
    "network_flood_targets": f"SELECT dst_ip, packets FROM (SELECT dst_ip, count(*) AS packets, sum(count(*)) OVER () AS total FROM {_PACKETS} GROUP BY 1) WHERE total >= 1000 AND packets > total * 0.0195",
    "network_port_scans": f"SELECT src_ip, dst_ip, count(DISTINCT dst_port) AS ports FROM {_PACKETS} GROUP BY 1, 2 HAVING count(DISTINCT dst_port) > 5",
    "network_exfiltration": f"SELECT {_IP.format('src_ip')} AS src, {_IP.format('dst_ip')} AS dst, dst_port, bytes_sent FROM {_CONNECTIONS} WHERE bytes_sent > 1000000 AND bytes_received < 10000 AND protocol IN (6, 9)",
    "network_command_and_control": f"SELECT src_ip, dst_ip, dst_port, protocol FROM {_CONNECTIONS} WHERE dst_ip IN (3232235527, 3232235529) OR dst_port IN (4444, 1337, 6667) OR (packet_count > 100 AND bytes_sent + bytes_received < 10000)",
    "network_connection_threats": f"SELECT src_ip, dst_ip, dst_port, protocol, CASE WHEN a THEN 'Potential data exfiltration' ELSE 'Potential scanning/C&C' END AS threat_type, CASE WHEN a THEN 0.8 ELSE 0.7 END::DOUBLE AS confidence FROM (SELECT *, bytes_sent > 1000000 AND bytes_received = 0 AS a, packet_count > 1000 AND bytes_sent + bytes_received < 10000 AS b FROM {_CONNECTIONS}) WHERE a OR b",
    "network_threats": f"""
WITH p AS (SELECT * FROM {_PACKETS}), c AS (SELECT * FROM {_CONNECTIONS}), f AS (SELECT
  (SELECT count(*) > 0 FROM (SELECT count(DISTINCT dst_port) AS n FROM p GROUP BY src_ip, dst_ip) WHERE n > 50) AS scan,
  (SELECT count(*) > 0 FROM c WHERE bytes_sent > 1000000 AND bytes_received < 10000 AND protocol IN (6, 9)) AS leak,
  (SELECT count(*) > 0 FROM c WHERE dst_port IN (4444, 1337, 6667) OR (packet_count > 100 AND bytes_sent + bytes_received < 10000)) AS cnc)
SELECT CASE WHEN cnc AND dst_port IN (4444, 1337, 6667) THEN 'C&C' WHEN leak AND bytes_sent > 1000000 AND bytes_received < 10000 THEN 'Data Exfiltration' WHEN scan THEN 'Port Scanning' END AS threat_type, count(*) AS n FROM c, f GROUP BY 1""",
    "network_applications": f"""
SELECT {_NAME.format('a')} AS application, {_TEXT.format('a')} AS description, count(*) AS n
FROM (SELECT CASE dst_port WHEN 8080 THEN 7 WHEN 80 THEN 7 WHEN 443 THEN 8 WHEN 53 THEN 9 WHEN 22 THEN 11 WHEN 25 THEN 13 ELSE protocol END AS a FROM {_PACKETS}) GROUP BY 1, 2""",
    "memory_processes": f"""
SELECT process_id, t IS NOT NULL AS is_suspicious, t AS threat_type, CAST(CASE t WHEN 'Suspicious Process Name' THEN 0.9 WHEN 'Unusual Thread Count' THEN 0.7 WHEN 'Large Virtual Memory' THEN 0.6 ELSE 0 END AS DOUBLE) AS confidence,
  CASE WHEN lower(process_name) IN ('trojan.exe', 'malware.exe') THEN lower(process_name) END AS malware, CASE WHEN process_name = 'hidden.exe' THEN 'hidden.exe' WHEN t = 'Suspicious Process Name' THEN 'Potential Rootkit' END AS rootkit FROM {_JUDGED}""",
    "memory_connections": f"""
SELECT socket_id, t IS NOT NULL AS is_suspicious, t AS threat_type, CAST(CASE t WHEN 'Connection to malicious port' THEN 0.9 WHEN 'Connection to private network from public IP' THEN 0.7 WHEN 'Unusual protocol' THEN 0.6 ELSE 0 END AS DOUBLE) AS confidence,
  remote_ip IN (167772161, 3232236030, 2130706433) AS bad_ip, remote_port IN (135, 139, 445, 1433, 3389, 5900, 8080) AS risky_port FROM {_JUDGED_SOCKETS}""",
    "memory_injection": f"SELECT count(*) FILTER (WHERE regexp_matches(process_name, 'inject|malware')) AS simple, count(*) FILTER (WHERE regexp_matches(process_name, 'inject|malware|trojan|backdoor|keylog|ransom|spyware|rootkit')) + count(*) FILTER (WHERE virtual_size > 1000000000 AND working_set_size < 10000000) AS \"full\" FROM {_PROCESSES}",
    "memory_rootkit_activity": f"""
SELECT p AS suspicious_processes, n AS nameless, c AS suspicious_connections, (p > 3 AND c > 5) OR n > 0 AS detected
FROM (SELECT count(t) AS p, count(*) FILTER (WHERE coalesce(process_name, '') = '') AS n FROM {_JUDGED}), (SELECT count(t) AS c FROM {_JUDGED_SOCKETS})""",
    "permission_findings": f"SELECT metadata_id, issue, CASE WHEN issue LIKE 'World%' THEN 'High' WHEN issue IS NULL THEN 'Low' ELSE 'Critical' END AS severity, issue IS NOT NULL AS is_insecure FROM {_FINDING}",
    "permission_patterns": f"""
SELECT issue, severity, count(*) AS n FROM (SELECT CASE WHEN mode & 2 <> 0 THEN ['World-writable permissions pose security risk', 'High'] WHEN mode & 3072 <> 0 THEN ['SUID/SGID bit set, potential privilege escalation risk', 'Critical']
  WHEN mode & 512 <> 0 AND NOT is_directory THEN ['Sticky bit set on file, unusual configuration', 'Medium'] WHEN mode & 16 <> 0 AND mode & 32 <> 0 AND regexp_matches(path, 'shadow|passwd|sudoers|ssh|ssl|cert') THEN ['Sensitive file with group read-write permissions', 'High']
  WHEN mode & 4 <> 0 AND {_SECRET} THEN ['Sensitive file with world-readable permissions', 'Critical'] ELSE [NULL, 'Low'] END AS v, v[1] AS issue, v[2] AS severity FROM {_PERMISSIONS}) GROUP BY 1, 2""",
    "permission_risks": f"""
SELECT metadata_id, mode & 3072 <> 0 OR (mode & 2 <> 0 AND is_directory) AS escalation, mode & 4 <> 0 AND regexp_matches(path, 'conf|settings|database|db|cred|secret|key|cert|pem|log|debug') AS disclosure,
  mode & 2 <> 0 OR (mode & 16 <> 0 AND regexp_matches(path, 'shadow|passwd|sudoers|sshd?_config')) AS unauthorized_access, NOT is_directory AND mode & 2048 <> 0 AS bypass, coalesce(mode & 16 <> 0 AND group_name IN ('root', 'wheel', 'admin', 'sudo'), false) AS group_risk
FROM {_PERMISSIONS}""",
    "permission_inheritance": "SELECT DISTINCT full_path AS path, regexp_extract(full_path, '^(.*)[/\\\\][^/\\\\]*$', 1) AS parent FROM (SELECT * FROM file_entry QUALIFY row_number() OVER (PARTITION BY volume_id, file_id ORDER BY seq DESC) = 1) WHERE NOT deleted AND full_path IS NOT NULL AND mode & 2 <> 0",
    "vulnerability_matches": "SELECT DISTINCT lower(p_name) AS name, id AS vulnerability_id, 0.8::DOUBLE AS confidence FROM part, (VALUES ('V-1', 'steel'), ('V-2', 'copper'), ('V-3', 'brass'), ('V-4', 'large')) v(id, s) WHERE contains(lower(p_name), s)",
    "vulnerability_priorities": "SELECT * FROM (VALUES ('V-1', 'Critical'), ('V-3', 'High'), ('V-2', 'High')) v(vulnerability_id, severity)",
    "policy_baseline": f"SELECT type, name, status, CASE WHEN status = 'match' THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM {_BASELINE}",
    "security_audit": f"""
SELECT *, round((1 - insecure / permissions + 1 - critical / (vulnerabilities + 1) + 1 - violations / (policies + 1)) / 3, 9) AS score
FROM (SELECT count(*) AS permissions, count(issue) AS insecure FROM {_FINDING}), (SELECT 4::BIGINT AS vulnerabilities, 1::BIGINT AS critical), (SELECT count(*) AS policies, count(*) FILTER (WHERE status <> 'match') AS violations FROM {_BASELINE})""",
    "rule_matches": "SELECT doc_id, rule, severity, strpos(text, pattern)::INTEGER - 1 AS \"offset\" FROM documents, (VALUES ('quota', 'quota', 'Moderate'), ('tape', 'tape', 'Very high'), ('volume', 'volumen V', 'High')) r(rule, pattern, severity) WHERE contains(text, pattern)",
}
SQL["audit_lines"] = f"""
SELECT unnest(['Security audit summary:', '  Permissions checked: ' || permissions, '  Insecure permissions: ' || insecure, '  Vulnerabilities found: ' || vulnerabilities, '  Critical vulnerabilities: ' || critical,
  '  Policy violations: ' || violations, printf('  Overall score: %.2f%%', round(score, 4) * 100)]) AS value FROM ({SQL["security_audit"]})"""
