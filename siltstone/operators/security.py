"""Permission findings, vulnerability matches, policies and the audit score.

Permissions: path, is_directory, owner_id, group_name, mode.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import modes
from siltstone.functions.paths import contains_any

#: Substrings of sensitive paths, and privileged groups.
SENSITIVE_EXTENSIONS = (".key", ".pem", ".priv", ".private", ".secret", ".pass", ".password")
SENSITIVE_FILES = ("shadow", "passwd", "sudoers", "ssh", "ssl", "cert")
SYSTEM_FILES = ("shadow", "passwd", "sudoers", "ssh_config", "sshd_config")
DISCLOSING = ("config", "conf", "settings", "database", "db", "credentials", "creds", "secret", "key", "cert", "pem", "log", "debug")
PRIVILEGED_GROUPS = ("root", "wheel", "admin", "sudo")
#: Texts of the enumerations.
SEVERITIES = ("Low", "Medium", "High", "Critical")
AUDIT_LEVELS = ("Basic", "Standard", "Detailed", "Compliance")
PERMISSION_TYPES = ("File", "Directory", "Registry", "Service", "Process")
POLICY_TYPES = ("Password", "Account", "Audit", "Privilege", "Network", "Encryption")


def enumeration(number: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in enumerate(names) for x in pair))[number], F.lit("Unknown"))


def _chain(*rules: tuple[Column, str, str]) -> tuple[Column, Column]:
    """(issue, severity) of the first rule that holds; null and Low if none does."""
    issue, severity = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for test, text, level in rules:
        issue, severity = issue.when(test, text), severity.when(test, level)
    return issue, severity.otherwise("Low")


_MODE, _PATH = "mode", "path"


def _bits():
    m = F.col(_MODE)
    return {
        "world_write": modes.has(m, modes.WORLD_WRITE), "world_read": modes.has(m, modes.WORLD_READ), "special": modes.has(m, modes.SUID | modes.SGID), "suid": modes.has(m, modes.SUID),
        "sticky": modes.has(m, modes.STICKY), "group_write": modes.has(m, modes.GROUP_WRITE), "group_read": modes.has(m, modes.GROUP_READ), "file": ~F.col("is_directory"),
    }


def analyse_permissions(permissions: DataFrame) -> DataFrame:
    """``permissions`` with issue and severity: world-writable, then set-id of
    others than root, then a sensitive name that all can read."""
    b = _bits()
    issue, severity = _chain(
        (b["world_write"], "World-writable permissions pose security risk", "High"),
        (b["special"] & (F.col("owner_id") != 0), "SUID/SGID bit set on non-root owned file", "Critical"),
        (b["world_read"] & contains_any(F.col(_PATH), SENSITIVE_EXTENSIONS), "Sensitive file with world-readable permissions", "Critical"),
    )
    return permissions.select("*", issue.alias("issue"), severity.alias("severity"), issue.isNotNull().alias("is_insecure"))


def insecure_patterns(permissions: DataFrame) -> DataFrame:
    """The longer chain: also sticky files and sensitive names that a group may change."""
    b = _bits()
    path = F.col(_PATH)
    issue, severity = _chain(
        (b["world_write"], "World-writable permissions pose security risk", "High"),
        (b["special"], "SUID/SGID bit set, potential privilege escalation risk", "Critical"),
        (b["sticky"] & b["file"], "Sticky bit set on file, unusual configuration", "Medium"),
        (b["group_write"] & b["group_read"] & contains_any(path, SENSITIVE_FILES), "Sensitive file with group read-write permissions", "High"),
        (b["world_read"] & contains_any(path, SENSITIVE_EXTENSIONS), "Sensitive file with world-readable permissions", "Critical"),
    )
    return permissions.select("*", issue.alias("issue"), severity.alias("severity"), issue.isNotNull().alias("is_insecure"))


def permission_risks(permissions: DataFrame) -> DataFrame:
    """``permissions`` with the single risks, true or false, that need no second row."""
    b = _bits()
    path = F.col(_PATH)
    return permissions.select(
        "*", (b["special"] | (b["world_write"] & ~b["file"])).alias("escalation"), (b["world_read"] & contains_any(path, DISCLOSING)).alias("disclosure"),
        (b["world_write"] | (b["group_write"] & contains_any(path, SYSTEM_FILES))).alias("unauthorized_access"), (b["file"] & b["suid"]).alias("bypass"),
        F.coalesce(b["group_write"] & F.col("group_name").isin(*PRIVILEGED_GROUPS), F.lit(False)).alias("group_risk"),
    )


def inheritance_violations(permissions: DataFrame) -> DataFrame:
    """(path, parent): world-writable files in directories that are not."""
    b = _bits()
    files = permissions.where(b["file"] & b["world_write"]).select(_PATH, F.regexp_extract(_PATH, r"^(.*)[/\\][^/\\]*$", 1).alias("parent"))
    folders = permissions.where(F.col("is_directory") & ~b["world_write"]).select(F.col(_PATH).alias("parent")).distinct()
    return files.distinct().join(folders, "parent", "left_semi").select(_PATH, "parent")


#: Patterns, and characters of them in all, that are looked for in one pass.
PATTERNS, PATTERN_CHARS = 100_000, 4_000_000


def find_patterns(rows: DataFrame, key: str, text: str, patterns: DataFrame) -> DataFrame:
    """(key, pattern, offset): the patterns (column ``pattern``) that each text holds,
    with the place, from 0, where it first does.

    An automaton finds all patterns in one walk over a text, so that no text is
    compared with each pattern.  Patterns are a stated set, taken in blocks that
    bound the automaton.  Null texts and patterns match nothing, an empty
    pattern stands at 0 of every text.
    """
    import ahocorasick

    kind = rows.schema[key].dataType.simpleString()
    asked = patterns.select("pattern").where("pattern is not null").distinct()
    n, chars = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()
    blocks = max(1, -(-n // PATTERNS), -(-chars // PATTERN_CHARS))
    out = None
    for k in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k) if blocks > 1 else asked
        words = sorted(r["pattern"] for r in part.collect())  # a block of the stated patterns

        def run(batches: Iterator[pa.RecordBatch], words: list[str] = words) -> Iterator[pa.RecordBatch]:
            machine = ahocorasick.Automaton()
            for w in words:
                if w:
                    machine.add_word(w, w)
            machine.make_automaton()
            for batch in batches:
                at, found, offsets = [], [], []
                for i, value in enumerate(batch.column(1).to_pylist()):
                    first: dict[str, int] = {"": 0} if value is not None and "" in words[:1] else {}
                    for end, w in machine.iter(value) if value and len(machine) else ():
                        first.setdefault(w, end - len(w) + 1)
                    at += [i] * len(first)
                    found += first
                    offsets += first.values()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string()), pa.array(offsets, pa.int32())], names=[key, "pattern", "offset"])

        one = rows.select(key, text).mapInArrow(run, f"{key} {kind}, pattern string, offset int")
        out = one if out is None else out.unionByName(one)
    return out


def match_vulnerabilities(components: DataFrame, database: DataFrame) -> DataFrame:
    """(name, vulnerability_id, confidence): a component matches software whose name
    its own contains."""
    names = components.select("name", F.col("name").alias("_text")).where("name is not null").distinct()
    found = find_patterns(names, "name", "_text", database.select(F.col("affected_software").alias("pattern")))
    known = database.select("vulnerability_id", F.col("affected_software").alias("pattern")).distinct()
    return found.join(known, "pattern").select("name", "vulnerability_id", F.lit(0.8).alias("confidence"))


def assess_vulnerabilities(vulnerabilities: DataFrame) -> DataFrame:
    """``vulnerabilities`` with exploit_details and patch_details, which say so where
    nothing is known: columns is_exploitable, exploitability, patch_url."""
    return vulnerabilities.withColumns({
        "exploit_details": F.coalesce("exploitability", F.lit("No exploit information available")), "patch_details": F.coalesce("patch_url", F.lit("No patch information available")),
        "is_patch_available": F.col("patch_url").isNotNull(),
    })


def policies_from_templates(templates: DataFrame) -> DataFrame:
    """(type, name, description, is_compliant, violation_details, recommended_action,
    severity) of policies made from templates, none of them looked at yet."""
    text = lambda c, other: F.coalesce(c, F.lit(other))
    return templates.select(
        "type", text("template_name", "Unknown Template").alias("name"), text("description", "Template-based policy").alias("description"), F.lit(False).alias("is_compliant"),
        F.lit("Policy not yet evaluated").alias("violation_details"), text("recommended_setting", "No recommendation").alias("recommended_action"), F.col("severity_if_violated").alias("severity"),
    )


def prioritise(vulnerabilities: DataFrame, n: int | None = None) -> DataFrame:
    """By severity, then score, then whether an exploit is known, then identifier."""
    level = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    ordered = vulnerabilities.orderBy(level.desc(), F.col("cvss_score").desc(), F.col("is_exploitable").desc(), "vulnerability_id")
    return ordered if n is None else ordered.limit(n)


def compare_to_baseline(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(type, name, status, score): policies of both sides, as ``match``, ``changed``,
    ``missing`` or ``extra``."""
    a = baseline.select("type", "name", F.col("value").alias("expected"), F.lit(True).alias("_in_baseline"))
    b = current.select("type", "name", F.col("value").alias("found"), F.lit(True).alias("_in_current"))
    status = F.when(F.col("_in_current").isNull(), "missing").when(F.col("_in_baseline").isNull(), "extra").when(F.col("expected").eqNullSafe(F.col("found")), "match").otherwise("changed")
    return a.join(b, ["type", "name"], "full").select("type", "name", status.alias("status"), F.when(status == "match", 1.0).otherwise(0.0).alias("score"))


def valid_policy(policies: DataFrame) -> DataFrame:
    """``policies`` with the first part that is missing, or null."""
    def missing(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("")) == ""

    error = F.when(missing("name"), "Policy name is missing").when(missing("description"), "Policy description is missing").when(missing("type"), "Policy type is missing")
    return policies.select("*", error.alias("validation_error"))


def remediation_plan(compliance: DataFrame) -> DataFrame:
    """(name, action, effort) of policies that are not met."""
    return compliance.where("not is_compliant").select("name", F.concat(F.lit("Remediate "), F.col("name")).alias("action"), F.when(F.col("severity") == "High", "Medium").otherwise("Low").alias("effort"))


def audit_score(permissions: DataFrame, vulnerabilities: DataFrame, policies: DataFrame) -> DataFrame:
    """One row: counts and the mean of three scores, 1 if there is nothing to check.

    ``permissions`` carry is_insecure, ``vulnerabilities`` severity, ``policies`` is_compliant.
    """
    p = permissions.agg(F.count(F.lit(1)).alias("permissions"), F.count_if("is_insecure").alias("insecure"))
    v = vulnerabilities.agg(F.count(F.lit(1)).alias("vulnerabilities"), F.count_if(F.col("severity") == "Critical").alias("critical"))
    q = policies.agg(F.count(F.lit(1)).alias("policies"), F.count_if(~F.col("is_compliant")).alias("violations"))
    one = p.join(F.broadcast(v), F.lit(True)).join(F.broadcast(q), F.lit(True))  # one row each
    score = (1 - F.col("insecure") / F.col("permissions") + 1 - F.col("critical") / (F.col("vulnerabilities") + 1) + 1 - F.col("violations") / (F.col("policies") + 1)) / 3
    return one.withColumn("score", F.when(F.col("permissions") > 0, score).otherwise(1.0))


def scan_rules(files: DataFrame, rules: DataFrame, key: str, text: str, exclude: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """(key, rule, severity, offset): places, from 0, where a file first holds a
    rule's pattern.  Rules are a stated set: enabled ones only.  Files whose
    ``path`` contains one of ``exclude`` are left out."""
    if exclude and path:
        files = files.where(~F.coalesce(contains_any(F.col(path), exclude), F.lit(False)))
    live = rules.where("enabled").select("rule", "pattern", "severity").distinct()
    return find_patterns(files, key, text, live).join(live, "pattern").select(key, "rule", "severity", "offset")


def rule_severity(severity: Column) -> Column:
    """Text of a severity from 1 to 10, two to a step."""
    step = F.least(F.greatest(severity, F.lit(1)), F.lit(10))
    return F.when(step <= 2, "Low").when(step <= 4, "Moderate").when(step <= 6, "High").when(step <= 8, "Very high").otherwise("Critical")
