"""Processes and connections found in memory images: row rules and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.paths import contains_any

#: Words in process names, known names, ports and addresses.
BAD_WORDS = ("malware", "trojan", "virus", "backdoor", "keylogger", "ransomware", "spyware", "rootkit", "inject", "hack")
INJECTION_WORDS = ("inject", "malware", "trojan", "backdoor", "keylog", "ransom", "spyware", "rootkit")
MALWARE = ("malware.exe", "trojan.exe", "backdoor.exe", "keylogger.exe", "ransomware.exe", "spyware.exe")
ROOTKITS = ("rootkit.sys", "hidden.exe", "stealth.exe", "cloak.dll")
ATTACK_PORTS = (4444, 1337, 6667, 31337, 1433, 3389)
RISKY_PORTS = (135, 139, 445, 1433, 3389, 5900, 8080)
BAD_IPS = (0x0A000001, 0xC0A801FE, 0x7F000001)
#: Known rootkits, with what they do and how they show.
KNOWN_ROOTKITS = (
    ("Adore", "Linux rootkit that hides files, processes, and network connections", "Check for /dev/.adore directory and adore module in kernel"),
    ("Beast", "Windows rootkit that hides processes and files", "Check for Beast registry entries and loaded drivers"),
    ("Diamorphine", "Linux LKM rootkit that hides processes, files, and network activity", "Check for diamorphine module and /proc/diamorphine_hidden_inodes"),
    ("Duckroot", "Windows rootkit that hides files and processes", "Check for Duckroot registry keys and loaded modules"),
    ("Flea", "Linux rootkit that hides files and processes", "Check for /etc/ld.so.preload modifications and hidden files"),
    ("Knark", "Linux rootkit that hides processes and files", "Check for knark module and /proc/knark directory"),
    ("Moodnt", "Windows rootkit that hides network connections", "Check for Moodnt registry entries and loaded drivers"),
    ("Ni4", "Linux rootkit that hides files and processes", "Check for ni4 module and /dev/.ni4 directory"),
    ("Orcus", "Windows rootkit and RAT", "Check for Orcus registry keys and processes"),
    ("Reptile", "Linux rootkit that hides files, processes, and network connections", "Check for reptile module and /reptile directory"),
    ("Suckit", "Linux rootkit that replaces system binaries", "Check for modified system binaries and /dev/.sk directory"),
    ("Torn", "Linux rootkit that hides files and processes", "Check for /dev/.torn directory and torn module"),
    ("Xzibit", "Windows rootkit that hides files and processes", "Check for Xzibit registry entries and loaded modules"),
)
#: Image formats by extension, with name and description.
FORMATS = {
    ".raw": ("Raw", "Raw memory dump"), ".dmp": ("Crash Dump", "Windows crash dump"), ".lime": ("LiME", "LiME (Linux Memory Extractor) format"),
    ".avml": ("AVML", "Azure Virtual Machine Memory"), ".vmss": ("VMware Snapshot", "VMware snapshot file"), ".vmsn": ("VMware Memory", "VMware memory file"),
}


def dump_format(path: Column, head: Column) -> Column:
    """Format name by extension, else by the first bytes; Unknown below 4 bytes."""
    named = F.create_map(*(F.lit(x) for ext, (name, _) in FORMATS.items() for x in (ext, name)))[F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1))]
    by_head = F.when(F.hex(F.substring(head, 1, 4)) == "50414745", "LiME").when(F.octet_length(head) >= 4, "Raw").otherwise("Unknown")
    return F.coalesce(named, by_head, F.lit("Unknown"))


def format_description(name: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in FORMATS.values() for x in pair))[name], F.lit("Unknown memory dump format"))


def _verdict(df: DataFrame, kind: Column, confidence: Column) -> DataFrame:
    return df.select("*", kind.isNotNull().alias("is_suspicious"), kind.alias("threat_type"), F.coalesce(confidence, F.lit(0.0)).alias("confidence"))


def process_behaviour(processes: DataFrame, words: tuple[str, ...] = BAD_WORDS, threads: int = 100, address_space: int = 1_000_000_000) -> DataFrame:
    """A suspicious name goes before many threads, these before a large address space."""
    name = contains_any(F.col("process_name"), words)
    many, large = F.col("thread_count") > threads, F.col("virtual_size") > address_space
    named = F.col("process_name").isNotNull()
    kind = F.when(named & name, "Suspicious Process Name").when(named & many, "Unusual Thread Count").when(named & large, "Large Virtual Memory")
    return _verdict(processes, kind, F.when(named & name, 0.9).when(named & many, 0.7).when(named & large, 0.6))


def known_malware(name: Column, names: tuple[str, ...] = MALWARE) -> Column:
    """The known name that a process has, case ignored, else null."""
    return F.when(F.lower(name).isin(*names), F.lower(name))


def known_rootkit(name: Column, is_suspicious: Column, confidence: Column, names: tuple[str, ...] = ROOTKITS, least: float = 0.8) -> Column:
    return F.when(F.lower(name).isin(*names), F.lower(name)).when(is_suspicious & (confidence > least), "Potential Rootkit")


def _private(ip: Column) -> Column:
    return (ip.bitwiseAND(0xFF000000) == 0x0A000000) | (ip.bitwiseAND(0xFFF00000) == 0xAC100000) | (ip.bitwiseAND(0xFFFF0000) == 0xC0A80000)


def connection_behaviour(connections: DataFrame, ports: tuple[int, ...] = ATTACK_PORTS) -> DataFrame:
    """An attack port goes before a public address that reaches a private one, this
    before a protocol that is neither TCP nor UDP."""
    port = F.col("remote_port").isin(*ports)
    reach = ~_private(F.col("local_ip")) & _private(F.col("remote_ip"))
    odd = ~F.col("protocol").isin(6, 17)
    kind = F.when(port, "Connection to malicious port").when(reach, "Connection to private network from public IP").when(odd, "Unusual protocol")
    return _verdict(connections, kind, F.when(port, 0.9).when(reach, 0.7).when(odd, 0.6))


def listed_connections(connections: DataFrame, addresses: DataFrame | None = None, ports: tuple[int, ...] = RISKY_PORTS) -> DataFrame:
    """With bad_ip and risky_port; ``addresses`` (remote_ip) is any table, by default
    the few fixed ones."""
    risky = F.col("remote_port").isin(*ports).alias("risky_port")
    if addresses is None:
        return connections.select("*", F.col("remote_ip").isin(*BAD_IPS).alias("bad_ip"), risky)
    known = addresses.select("remote_ip").distinct().withColumn("_listed", F.lit(True))
    return connections.join(known, "remote_ip", "left").select(*connections.columns, F.coalesce("_listed", F.lit(False)).alias("bad_ip"), risky)


def injection_count(processes: DataFrame) -> DataFrame:
    """(simple, full): processes with one of two words; and one for any of the words
    plus one for a large address space with a small working set."""
    name = F.coalesce(F.col("process_name"), F.lit(""))
    sparse = (F.col("virtual_size") > 1_000_000_000) & (F.col("working_set_size") < 10_000_000)
    return processes.agg(F.count_if(contains_any(name, ("inject", "malware"))).alias("simple"), (F.count_if(contains_any(name, INJECTION_WORDS)) + F.count_if(sparse)).alias("full"))


def rootkit_activity(processes: DataFrame, connections: DataFrame, many_processes: int = 3, many_connections: int = 5) -> DataFrame:
    """(suspicious_processes, suspicious_connections, nameless, detected) of rows
    with is_suspicious: over 3 and over 5 of them, or any process without name."""
    p = processes.agg(F.count_if("is_suspicious").alias("suspicious_processes"), F.count_if(F.coalesce("process_name", F.lit("")) == "").alias("nameless"))
    c = connections.agg(F.count_if("is_suspicious").alias("suspicious_connections"))
    both = p.join(F.broadcast(c), F.lit(True))  # one row each
    return both.withColumn("detected", ((F.col("suspicious_processes") > many_processes) & (F.col("suspicious_connections") > many_connections)) | (F.col("nameless") > 0))
