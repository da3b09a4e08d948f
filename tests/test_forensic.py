"""Logs, packets, memory and permissions on small hand-made inputs."""

import struct

import pytest
from pyspark.sql import functions as F

from siltstone.functions import modes, texts
from siltstone.operators import logs as L
from siltstone.operators import memory as M
from siltstone.operators import network as N
from siltstone.operators import security as S
from siltstone.plans import forensic
from siltstone.sources import sinks
from siltstone.sources.files import read_pcap, read_trash, scan

SYSLOG = [
    "Jan 15 10:30:45 server1 systemd[1]: Started session", "Jan 15 10:31:45 server1 sshd[2345]: Accepted password", "Jan 15 10:32:45 server1 sshd[2346]: Failed password error",
    "Jan 15 10:33:45 server1 kernel: warning: low memory", "Jan 15 10:34:45 server1 apache2[99]: GET /", "Jan 15 10:35:45 server1 apache2[99]: POST /", "", "not a log line",
]


def test_syslog_lines_filters_and_statistics(spark):
    logs = L.parse_syslog(spark.createDataFrame([(s,) for s in SYSLOG], "value string"), year=2024)
    rows = logs.orderBy("ts").collect()
    assert [(r.process, r.pid, r.level) for r in rows] == [("systemd", 1, "info"), ("sshd", 2345, "info"), ("sshd", 2346, "error"), ("kernel", None, "warn"), ("apache2", 99, "info"), ("apache2", 99, "info")]
    assert str(rows[0].ts) == "2024-01-15 10:30:45" and rows[3].message == "warning: low memory"
    assert L.filter_logs(logs, process="APACHE2").count() == 2
    assert L.filter_logs(logs, classes=("error",)).count() == 1
    s = L.log_statistics(logs).first()
    assert (s.total, s.error_count, s.warning_count, s.info_count) == (6, 1, 1, 4)
    assert L.search_logs(logs, "ss").first().n == 3
    lines = [r.value for r in L.formatted(logs.where("pid = 1"), "syslog").collect()]
    assert lines == ["Jan 15 10:30:45 server1 systemd[1]: Started session"]


@pytest.mark.parametrize("style", ["syslog", "json", "csv"])
def test_written_logs_read_back(spark, style):
    logs = L.parse_syslog(spark.createDataFrame([(SYSLOG[1],)], "value string"))
    again = L.PARSERS[style](L.formatted(logs, style)).first()
    assert (again.host, again.process, again.pid, again.message) == ("server1", "sshd", 2345, "Accepted password")


def test_null_fields_pass_filters(spark):
    logs = spark.createDataFrame([(None, None, None, None, None, None, None)], "ts timestamp, source string, level string, message string, host string, process string, pid int")
    assert L.filter_logs(logs, source="a", keyword="b", classes=()).count() == 1


@pytest.mark.parametrize(("text", "word", "n"), [("aaaa", "aa", 3), ("abab", "ab", 2), ("", "a", 0), ("a", "", 0), ("a.b.c", ".", 2), ("xyz", "xyz1", 0)])
def test_overlapping_count(spark, text, word, n):
    assert spark.createDataFrame([(text,)], "t string").select(texts.overlapping_count(F.col("t"), word)).first()[0] == n


def ethernet(src, dst, sport, dport, protocol=6, payload=b"GET / HTTP/1.1"):
    body = struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 5 << 4, 0, 0, 0, 0) if protocol == 6 else struct.pack(">HHHH", sport, dport, 8 + len(payload), 0)
    ip = struct.pack(">BBHHHBBHII", 0x45, 0, 20 + len(body) + len(payload), 0, 0, 64, protocol, 0, src, dst)
    return b"\0" * 12 + b"\x08\x00" + ip + body + payload


def test_capture_files(spark, tmp_path):
    frames = [ethernet(0x0A000001, 0xC0A80001, 40000, 4444), ethernet(0x0A000002, 0xC0A80001, 5353, 53, 17, b"\0\0\1\0" + b"\0" * 8), b"\0" * 12 + b"\x08\x06" + b"\0" * 28]
    data = struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack("<IIII", 1000 + i, 7, len(f), len(f)) + f for i, f in enumerate(frames))
    (tmp_path / "a.pcap").write_bytes(data + b"\0\0")
    rows = read_pcap(spark, str(tmp_path)).withColumn("app", N.application_protocol(F.col("src_port"), F.col("dst_port"), F.col("protocol"), F.col("payload"))).withColumn("src", N.ip_to_string(F.col("src_ip"))).orderBy("ts").collect()
    assert [(r.src, r.src_port, r.dst_port, r.protocol) for r in rows] == [("10.0.0.1", 40000, 4444, N.NUMBER["TCP"]), ("10.0.0.2", 5353, 53, N.NUMBER["UDP"]), ("", None, None, N.NUMBER["Ethernet"])]
    assert [r.app for r in rows[:2]] == [N.NUMBER["HTTP"], N.NUMBER["DNS"]] and bytes(rows[0].payload) == b"GET / HTTP/1.1"
    assert N.packet_threat(read_pcap(spark, str(tmp_path))).where("is_suspicious").count() == 1


def test_addresses(spark):
    ips = spark.createDataFrame([(0xC0A86464,), (0,), (0xFFFFFFFF,)], "ip long")
    text = N.ip_to_string(F.col("ip"))
    assert [tuple(r) for r in ips.select(text, N.string_to_ip(text)).collect()] == [("192.168.100.100", 0xC0A86464), ("0.0.0.0", 0), ("255.255.255.255", 0xFFFFFFFF)]


def test_floods_and_scans(spark):
    packets = spark.range(1000).select(F.lit(1).cast("long").alias("src_ip"), F.when(F.col("id") < 900, 2).otherwise(3).cast("long").alias("dst_ip"), (F.col("id") % 60).cast("int").alias("dst_port"), F.lit(4).alias("protocol"), F.lit(10).cast("long").alias("packet_size"))
    assert [(r.dst_ip, r.packets) for r in N.flood_targets(packets).collect()] == [(2, 900)]
    assert {(r.dst_ip, r.ports) for r in N.port_scans(packets).collect()} == {(2, 60), (3, 60)}
    assert N.flood_targets(packets.limit(999)).count() == 0


PERMISSIONS = [("a.txt", False, 0o644), ("b.txt", False, 0o666), ("database.key", False, 0o644), ("dir", True, 0o755), ("open", True, 0o777), ("open2/x", False, 0o4755), ("s", False, 0o1644)]


def test_permissions(spark):
    df = spark.createDataFrame([(p, d, 5, "users", (0o040000 if d else 0o100000) | m) for p, d, m in PERMISSIONS], "path string, is_directory boolean, owner_id long, group_name string, mode int")
    got = {r.path: (r.severity, r.is_insecure) for r in S.analyse_permissions(df).collect()}
    assert got == {"a.txt": ("Low", False), "b.txt": ("High", True), "database.key": ("Critical", True), "dir": ("Low", False), "open": ("High", True), "open2/x": ("Critical", True), "s": ("Low", False)}
    assert {r.path for r in S.insecure_patterns(df).where("severity = 'Medium'").collect()} == {"s"}
    risks = {r.path: r for r in S.permission_risks(df).collect()}
    assert risks["open"].escalation and not risks["b.txt"].escalation and risks["open2/x"].bypass and risks["database.key"].disclosure


@pytest.mark.parametrize(("mode", "text"), [(0o100755, "-rwxr-xr-x"), (0o100644, "-rw-r--r--"), (0o040777, "drwxrwxrwx"), (0o100600, "-rw-------"), (0o100444, "-r--r--r--"), (0o104755, "-rwsr-xr-x"), (0o102644, "-rw-r-Sr--"), (0o041777, "drwxrwxrwt"), (0o120777, "lrwxrwxrwx")])
def test_mode_text(spark, mode, text):
    got = spark.createDataFrame([(mode,)], "m int").select(modes.permission_string(F.col("m")).alias("t")).select("t", modes.mode_of(F.col("t")).alias("m")).first()
    assert (got.t, got.m) == (text, mode & 0o7777)


def test_scan_and_trash(spark, tmp_path):
    for name in ("a.txt", "b.pdf", "sub/c.TXT", "sub/d.log"):
        p = tmp_path / "files" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * 5000)
    rows = scan(spark, str(tmp_path / "files"), include_extensions=(".txt", ".log"), exclude_names=("d.",)).collect()
    assert sorted(r.full_path.rsplit("/", 1)[1] for r in rows) == ["a.txt", "c.TXT"] and {r.size_on_disk for r in rows} == {8192}
    assert scan(spark, str(tmp_path / "files"), recursive=False).count() == 2
    (tmp_path / "trash").mkdir()
    (tmp_path / "trash" / "a.txt.trashinfo").write_text("[Trash Info]\nPath=/home/u/a%20b.txt\nDeletionDate=2024-01-02T03:04:05\n")
    r = read_trash(spark, str(tmp_path / "trash")).first()
    assert (r.trashed_name, r.original_path, r.deletion_date) == ("a.txt", "/home/u/a b.txt", "2024-01-02T03:04:05")


def test_rules_and_severity(spark):
    files = spark.createDataFrame([(1, "clean malware note"), (2, "a virus"), (3, "trojan"), (4, None)], "id long, text string")
    rules = spark.createDataFrame([("v", "virus", 9, True), ("m", "malware", 8, True), ("t", "trojan", 7, True), ("x", "clean", 1, False)], "rule string, pattern string, severity int, enabled boolean")
    assert {(r.id, r.rule, r.offset) for r in S.scan_rules(files, rules, "id", "text").collect()} == {(1, "m", 6), (2, "v", 2), (3, "t", 0)}
    assert [r[0] for r in spark.range(13).select(S.rule_severity(F.col("id").cast("int"))).collect()][1::2] == ["Low", "Moderate", "High", "Very high", "Critical", "Critical"]


def test_every_event_is_written(spark, tmp_path):
    rows = [(i, i % 7, "view", "{}") for i in (0, 999, 1000, 123_456)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string").withColumn("ts", F.timestamp_seconds("event_id"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    assert forensic.log_written(spark, str(tmp_path)).count() == 4


def test_patterns_in_blocks_with_nulls_and_empty_ones(spark, monkeypatch):
    monkeypatch.setattr(S, "PATTERNS", 2)
    texts = spark.createDataFrame([(1, "abcabc"), (2, ""), (3, None), (4, "ünïc abc")], "id long, t string")
    patterns = spark.createDataFrame([("abc",), ("bca",), ("c",), ("",), (None,), ("abc",)], "pattern string")
    got = sorted(map(tuple, S.find_patterns(texts, "id", "t", patterns).collect()))
    assert got == sorted([(1, "abc", 0), (1, "bca", 1), (1, "c", 2), (4, "abc", 5), (4, "c", 3), (1, "", 0), (2, "", 0), (4, "", 0)])
    assert S.find_patterns(texts, "id", "t", patterns.limit(0)).count() == 0
    rules = spark.createDataFrame([("r", "abc", 5, True)], "rule string, pattern string, severity int, enabled boolean")
    assert [r.id for r in S.scan_rules(texts, rules, "id", "t", exclude=("ün",), path="t").collect()] == [1]


def test_thresholds_are_arguments(spark):
    p = spark.createDataFrame([(1, "a.exe", 60, 5, 5)], "process_id long, process_name string, thread_count int, virtual_size long, working_set_size long")
    assert M.process_behaviour(p).first().threat_type is None and M.process_behaviour(p, threads=50).first().threat_type == "Unusual Thread Count"
    assert M.process_behaviour(p, words=("a.",)).first().threat_type == "Suspicious Process Name"
    c = spark.createDataFrame([(1, 9)], "remote_ip long, remote_port int")
    assert M.listed_connections(c, spark.createDataFrame([(1,)], "remote_ip long"), ports=(9,)).first()[2:] == (True, True)


def test_reports(spark):
    assert sinks.compliance_report(spark.createDataFrame([(True,), (None,), (False,)], "is_compliant boolean")).first()[:3] == (3, 1, 2)
    assert sinks.compliance_report(spark.createDataFrame([], "is_compliant boolean")).first().percent == 0.0
    lines = [r.value for r in sinks.report_lines(spark.createDataFrame([(1, None)], "a int, b string"), "Title").collect()]
    assert lines == ["Title", "a: 1, b: -"]


def test_vulnerabilities_say_what_is_not_known(spark):
    v = spark.createDataFrame([("a", "easy", "http://x"), ("b", None, None)], "vulnerability_id string, exploitability string, patch_url string")
    got = {r.vulnerability_id: (r.exploit_details, r.patch_details, r.is_patch_available) for r in S.assess_vulnerabilities(v).collect()}
    assert got == {"a": ("easy", "http://x", True), "b": ("No exploit information available", "No patch information available", False)}


def test_policies_from_templates(spark):
    t = spark.createDataFrame([("Audit", None, None, None, "Low")], "type string, template_name string, description string, recommended_setting string, severity_if_violated string")
    r = S.policies_from_templates(t).first()
    assert (r["name"], r.description, r.is_compliant, r.recommended_action, r.severity) == ("Unknown Template", "Template-based policy", False, "No recommendation", "Low")
