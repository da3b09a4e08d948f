"""Packets and connections: decoding, statistics, threat rules.

Addresses are BIGINT in host order.  Packets: ts, src_ip, dst_ip, src_port,
dst_port, protocol, packet_size, payload; connections: the same keys with
bytes_sent, bytes_received, packet_count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Protocol numbers, names, descriptions.
PROTOCOLS = (
    (1, "Ethernet", "Ethernet frame"), (2, "IPv4", "Internet Protocol version 4"), (3, "IPv6", "Internet Protocol version 6"), (4, "TCP", "Transmission Control Protocol"),
    (5, "UDP", "User Datagram Protocol"), (6, "ICMP", "Internet Control Message Protocol"), (7, "HTTP", "Hypertext Transfer Protocol"), (8, "HTTPS", "Hypertext Transfer Protocol Secure"),
    (9, "DNS", "Domain Name System"), (10, "FTP", "File Transfer Protocol"), (11, "SSH", "Secure Shell"), (12, "Telnet", "Telnet protocol"), (13, "SMTP", "Simple Mail Transfer Protocol"),
    (14, "POP3", "Post Office Protocol version 3"), (15, "IMAP", "Internet Message Access Protocol"),
)
NUMBER = {name: n for n, name, _ in PROTOCOLS}
#: Ports that tell an application protocol, first match wins.
PORTS = ((80, "HTTP"), (443, "HTTPS"), (53, "DNS"), (21, "FTP"), (22, "SSH"), (23, "Telnet"), (25, "SMTP"), (110, "POP3"), (143, "IMAP"))
COMMAND_PORTS = (4444, 1337, 6667)
BLACKLIST = ("192.168.100.100", "10.0.0.123")


def ip_to_string(ip: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(ip, s).bitwiseAND(255) for s in (24, 16, 8, 0)))


def string_to_ip(text: Column) -> Column:
    parts = F.split(text, r"\.")
    return sum((F.shiftleft(parts[k].try_cast("bigint"), 24 - 8 * k) for k in range(4)), F.lit(0))


def protocol_name(number: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for n, name, _ in PROTOCOLS for x in (n, name)))[number], F.lit("Unknown"))


def protocol_description(number: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for n, _, text in PROTOCOLS for x in (n, text)))[number], F.lit("Unknown protocol"))


def _uint(data: Column, at: Column | int, size: int) -> Column:
    """Big-endian number in ``data`` at a place counted from 0."""
    at = at if isinstance(at, Column) else F.lit(at)
    return F.conv(F.hex(F.substring(data, at + 1, F.lit(size))), 16, 10).cast("bigint")


def decode_ethernet(packets: DataFrame, frame: str = "frame") -> DataFrame:
    """``packets`` with src_ip, dst_ip, src_port, dst_port, protocol and payload of
    Ethernet frames that carry IPv4 or IPv6; null where a frame is cut off."""
    f = F.col(frame)
    kind = _uint(f, 12, 2)
    v4, v6 = kind == 0x0800, kind == 0x86DD
    header = F.when(v4, _uint(f, 14, 1).bitwiseAND(15) * 4).when(v6, 40).cast("int")
    carried = F.when(v4, _uint(f, 23, 1)).when(v6, _uint(f, 20, 1))
    start = header + 14
    ported = carried.isin(6, 17)
    body = F.when(carried == 6, F.shiftright(_uint(f, start + 12, 1), 4) * 4).when(carried == 17, 8).otherwise(0).cast("int")
    protocol = F.when(carried == 6, NUMBER["TCP"]).when(carried == 17, NUMBER["UDP"]).when(carried.isin(1, 58), NUMBER["ICMP"]).when(v4, NUMBER["IPv4"]).when(v6, NUMBER["IPv6"]).otherwise(NUMBER["Ethernet"])
    return packets.select(
        "*", F.when(v4, _uint(f, 26, 4)).when(v6, _uint(f, 22, 4)).alias("src_ip"), F.when(v4, _uint(f, 30, 4)).when(v6, _uint(f, 38, 4)).alias("dst_ip"),
        F.when(ported, _uint(f, start, 2)).cast("int").alias("src_port"), F.when(ported, _uint(f, start + 2, 2)).cast("int").alias("dst_port"), protocol.alias("protocol"),
        F.substring(f, start + body + 1, F.lit(2**31 - 1)).alias("payload"),
    )


def application_protocol(src_port: Column, dst_port: Column, protocol: Column, payload: Column) -> Column:
    """Protocol number: a payload that begins as HTTP or DNS goes before the ports."""
    head = F.substring(payload, 1, 4)
    out = F.when(head.isin(*(F.encode(F.lit(x), "UTF-8") for x in ("GET ", "POST", "HEAD", "HTTP"))), NUMBER["HTTP"])
    out = out.when((F.octet_length(payload) >= 12) & (F.hex(F.substring(payload, 3, 2)) == "0100"), NUMBER["DNS"])
    for port, name in PORTS:
        out = out.when((dst_port == port) | (src_port == port), NUMBER[name])
    return out.otherwise(protocol)


def packet_threat(packets: DataFrame, ports: tuple[int, ...] = (4444, 1337)) -> DataFrame:
    bad = (F.col("protocol") == NUMBER["TCP"]) & F.col("dst_port").isin(*ports)
    return packets.select("*", bad.alias("is_suspicious"), F.when(bad, "Suspicious port").alias("threat_type"), F.when(bad, 0.9).otherwise(0.0).alias("confidence"))


def connection_threat(connections: DataFrame, sent: int = 1_000_000, packets: int = 1000, small: int = 10_000) -> DataFrame:
    """Over ``sent`` bytes without an answer goes before over ``packets`` packets of
    under ``small`` bytes in all."""
    upload = (F.col("bytes_sent") > sent) & (F.col("bytes_received") == 0)
    many = (F.col("packet_count") > packets) & (F.col("bytes_sent") + F.col("bytes_received") < small)
    kind = F.when(upload, "Potential data exfiltration").when(many, "Potential scanning/C&C")
    return connections.select("*", kind.isNotNull().alias("is_suspicious"), kind.alias("threat_type"), F.when(upload, 0.8).when(many, 0.7).otherwise(0.0).alias("confidence"))


def packet_rate(packets: DataFrame) -> DataFrame:
    """(packets, seconds, packets_per_second) from the first to the last ts; 0 a second
    if no time passed."""
    span = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6
    one = packets.agg(F.count(F.lit(1)).alias("packets"), F.coalesce(span, F.lit(0.0)).alias("seconds"))
    return one.withColumn("packets_per_second", F.when(F.col("seconds") > 0, F.col("packets") / F.col("seconds")).otherwise(0.0))


def packet_statistics(packets: DataFrame) -> DataFrame:
    """(protocol, packets, bytes, suspicious, average_size)."""
    flagged = packet_threat(packets)
    return flagged.groupBy("protocol").agg(F.count(F.lit(1)).alias("packets"), F.sum("packet_size").alias("bytes"), F.count_if("is_suspicious").alias("suspicious"), F.avg("packet_size").alias("average_size"))


def flood_targets(packets: DataFrame, least: int = 1000, share: float = 0.8) -> DataFrame:
    """(dst_ip, packets): targets of more than ``share`` of at least ``least`` packets."""
    per = packets.groupBy("dst_ip").agg(F.count(F.lit(1)).alias("packets"))
    total = per.agg(F.sum("packets").alias("total"))
    return per.join(F.broadcast(total), F.lit(True)).where((F.col("total") >= least) & (F.col("packets") > F.col("total") * share)).select("dst_ip", "packets")


def port_scans(packets: DataFrame, least: int = 50, ports: int = 50) -> DataFrame:
    """(src_ip, dst_ip, ports): pairs with more than ``ports`` different target ports."""
    pairs = packets.groupBy("src_ip", "dst_ip").agg(F.count_distinct("dst_port").alias("ports"), F.count(F.lit(1)).alias("n"))
    total = pairs.agg(F.sum("n").alias("total"))
    return pairs.join(F.broadcast(total), F.lit(True)).where((F.col("total") >= least) & (F.col("ports") > ports)).select("src_ip", "dst_ip", "ports")


def exfiltration(connections: DataFrame, sent: int = 1_000_000, received: int = 10_000) -> DataFrame:
    return connections.where((F.col("bytes_sent") > sent) & (F.col("bytes_received") < received) & F.col("protocol").isin(NUMBER["DNS"], NUMBER["ICMP"]))


def command_and_control(connections: DataFrame, blacklist: DataFrame | None = None, ports: tuple[int, ...] = COMMAND_PORTS, packets: int = 100, small: int = 10_000) -> DataFrame:
    """Connections to a listed address, to a known port, or of many tiny packets.

    ``blacklist`` (dst_ip) is any table; by default the few fixed addresses.
    """
    known = F.col("dst_port").isin(*ports) | ((F.col("packet_count") > packets) & (F.col("bytes_sent") + F.col("bytes_received") < small))
    if blacklist is None:
        return connections.where(known | ip_to_string(F.col("dst_ip")).isin(*BLACKLIST))
    listed = blacklist.select("dst_ip").distinct().withColumn("_listed", F.lit(True))
    return connections.join(listed, "dst_ip", "left").where(known | F.col("_listed")).drop("_listed")


def label_threats(packets: DataFrame, connections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packets and connections with is_suspicious and threat_type, by findings over
    all of them; of several findings the last one names a connection."""
    spark = packets.sparkSession

    def found(rows: DataFrame, name: str) -> DataFrame:
        return rows.agg((F.count(F.lit(1)) > 0).alias(name))

    one = spark.range(1)
    for rows, name in ((flood_targets(packets), "_flood"), (port_scans(packets), "_scan"), (exfiltration(connections), "_leak"), (command_and_control(connections), "_cnc")):
        one = one.join(found(rows, name), F.lit(True))
    flags = F.broadcast(one.drop("id"))  # one row
    flood = packets.join(flags, F.lit(True)).select(*packets.columns, F.col("_flood").alias("is_suspicious"), F.when(F.col("_flood"), "DDoS").alias("threat_type"))
    kind = (
        F.when(F.col("_cnc") & F.col("dst_port").isin(*COMMAND_PORTS), "C&C")
        .when(F.col("_leak") & (F.col("bytes_sent") > 1_000_000) & (F.col("bytes_received") < 10_000), "Data Exfiltration")
        .when(F.col("_scan"), "Port Scanning")
    )
    labelled = connections.join(flags, F.lit(True)).select(*connections.columns, kind.isNotNull().alias("is_suspicious"), kind.alias("threat_type"))
    return flood, labelled
