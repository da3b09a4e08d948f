"""One surviving record for each group of duplicates, field by field.

For each field the members whose value says something are ranked by trust,
recency and identifier in a window, and the first one's value survives.  Spark
limits a rank-1 window within each partition before it shuffles, so that a
group of very many members sends one row per task and field.

``surviving_records`` builds the record itself: the surviving value of every
field in one row, on the base of the most complete member.  The same order is
taken as a least structure, which every task combines before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Texts that stand in for a missing value, in lower case.
STAND_INS = (
    "", "-", "--", "?", "(none)", "(null)", "(unknown)", "<none>", "<null>", "<unknown>", "[null]", "[unknown]", "missing", "n/a", "na", "nil", "none",
    "not available", "null", "tbd", "undefined", "unknown",
)
#: Years in which a file time is believable.
YEARS = (1980, 2025)


def says(text: Column) -> Column:
    """Whether a text is a value and not a blank or a stand-in."""
    return text.isNotNull() & ~F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))).isin(*STAND_INS)


def believable(time: Column) -> Column:
    """Whether a time lies in ``YEARS``, in UTC whatever the session's zone."""
    first, after = (f"timestamp '{y}-01-01 00:00:00 UTC'" for y in (YEARS[0], YEARS[1] + 1))
    return time.isNotNull() & (time >= F.expr(first)) & (time < F.expr(after))


def survivors(members: DataFrame, group: str, ident: str, trust: str, recency: str, fields: dict[str, Column]) -> DataFrame:
    """Rows (group, field_name, ident): the member whose value of each field survives.

    ``fields`` gives for each field whether a member's value says something.
    Among those members the lowest ``trust`` goes first (null last), then the
    newest ``recency`` (null last), then the lowest ``ident``.  A field about
    which no member says anything has no row, nor have rows with a null group
    or ident; repeated members count once.
    """
    named = F.explode(F.filter(F.array(*(F.when(ok, F.lit(name)) for name, ok in fields.items())), lambda x: x.isNotNull())).alias("field_name")
    told = members.where(F.col(group).isNotNull() & F.col(ident).isNotNull()).select(group, ident, F.col(trust).alias("_trust"), F.col(recency).alias("_recency"), named)
    order = Window.partitionBy(group, "field_name").orderBy(F.col("_trust").asc_nulls_last(), F.col("_recency").desc_nulls_last(), F.col(ident))
    return told.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").select(group, "field_name", ident)


def surviving_records(members: DataFrame, group: str, ident: str, trust: str, recency: str, fields: dict[str, Column]) -> DataFrame:
    """One record of each group: group, members, base, complete, and for each field
    its surviving value, null where no member's says anything.

    Values survive as in ``survivors``.  ``base`` is the ident of the member of
    which most fields say something, ``complete`` their number; ties go by
    trust, recency and ident.  Repeated members count once; rows with a null
    group or ident are left out.
    """
    live = members.where(F.col(group).isNotNull() & F.col(ident).isNotNull())
    # Ascending, with what is missing last: the newest time is the least negative one.
    newest = -F.unix_micros(F.col(recency)) if dict(members.dtypes)[recency] == "timestamp" else -F.col(recency)
    order = (F.col(trust).isNull(), F.col(trust), F.col(recency).isNull(), newest, F.col(ident))
    order = [c.alias(f"o{k}") for k, c in enumerate(order)]
    said = sum((ok.cast("int") for ok in fields.values()), F.lit(0))
    best = [F.min(F.when(ok, F.struct(*order, F.col(name).alias("value"))))["value"].alias(name) for name, ok in fields.items()]
    base = F.min(F.struct((-said).alias("less"), *order))
    out = live.groupBy(group).agg(F.count_distinct(ident).alias("members"), base.alias("_base"), *best)
    return out.select(group, "members", F.col("_base.o4").alias("base"), (-F.col("_base.less")).alias("complete"), *fields)


def _members(groups: DataFrame, hosts: DataFrame, hosts_rows: int) -> tuple[DataFrame, dict[str, Column]]:
    """Members of ``duplicate_group`` rows with trust and believable time, and
    whether each field's value says something."""
    known = hosts.select("host_id", "trust_rank").dropDuplicates(["host_id"])
    if hosts_rows <= 100_000:
        known = F.broadcast(known)
    members = groups.select("group_id", F.inline("files")).select("group_id", "file_id", "host_id", "full_path", "last_write_time", "owner_name", "mode").join(known, "host_id", "left")
    fields = {
        "full_path": says(F.col("full_path")),
        "last_write_time": believable(F.col("last_write_time")),
        "owner_name": says(F.col("owner_name")),
        "mode": F.col("mode").isNotNull() & (F.col("mode") != 0),
    }
    return members.withColumn("_newest", F.when(fields["last_write_time"], F.col("last_write_time"))), fields


def duplicate_group_records(groups: DataFrame, hosts: DataFrame, hosts_rows: int) -> DataFrame:
    """The surviving record of each group of ``duplicate_group`` rows."""
    members, fields = _members(groups, hosts, hosts_rows)
    return surviving_records(members, "group_id", "file_id", "trust_rank", "_newest", fields)


def duplicate_group_survivors(groups: DataFrame, hosts: DataFrame, hosts_rows: int) -> DataFrame:
    """Survivors (group_id, field_name, file_id) of ``duplicate_group`` rows.

    Empty and null lists give no rows; members on an unknown host come last.
    """
    members, fields = _members(groups, hosts, hosts_rows)
    return survivors(members, "group_id", "file_id", "trust_rank", "_newest", fields)
