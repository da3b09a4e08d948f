import datetime as dt

from pyspark.sql import functions as F

from siltstone.llm.survivor import duplicate_group_survivors, surviving_records

GROUPS = "group_id long, files array<struct<file_id long, volume_id long, host_id int, full_path string, size_logical long, last_write_time timestamp, owner_name string, mode int>>, potential_savings long"
HOSTS = "host_id int, trust_rank int"
T = [dt.datetime(2020 + k, 1, 1) for k in range(5)]


def member(file_id, host, path="/a", time=T[0], owner="ops", mode=33188):
    return (file_id, 1, host, path, 1, time, owner, mode)


def run(spark, groups, hosts=((1, 1), (2, 2), (3, 2))):
    out = duplicate_group_survivors(spark.createDataFrame(groups, GROUPS), spark.createDataFrame(list(hosts), HOSTS), len(hosts))
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got))
    return {(g, f): i for g, f, i in got}


def test_trust_then_recency_then_identifier(spark):
    files = [member(5, 2, time=T[1]), member(4, 2, time=T[2]), member(3, 3, time=T[2]), member(9, 1, path="n/a", owner=" Unknown ", mode=0, time=dt.datetime(2107, 12, 31))]
    assert run(spark, [(1, files, 0)]) == {(1, "full_path"): 3, (1, "last_write_time"): 3, (1, "owner_name"): 3, (1, "mode"): 3}


def test_fields_survive_from_different_members(spark):
    files = [member(1, 1, path=None, owner="x", time=None, mode=None), member(2, 2, path="/b", owner="(null)", time=T[0], mode=5)]
    assert run(spark, [(1, files, 0)]) == {(1, "full_path"): 2, (1, "last_write_time"): 2, (1, "owner_name"): 1, (1, "mode"): 2}


def test_nothing_to_say_gives_no_row(spark):
    files = [member(1, 1, path="", owner="-", time=dt.datetime(1970, 1, 1), mode=0), member(2, 9, path="(unknown)", owner=None, time=None, mode=None)]
    assert run(spark, [(1, files, 0), (2, [], 0), (3, None, 0), (None, [member(1, 1)], 0)]) == {}


def test_unknown_host_last_repeats_and_boundary_years(spark):
    files = [member(1, 77, time=T[4]), member(2, 3, time=dt.datetime(1979, 12, 31, 23, 59, 59)), member(2, 3, time=dt.datetime(1979, 12, 31, 23, 59, 59)), member(3, 3, time=dt.datetime(2025, 12, 31, 23, 59, 59))]
    got = run(spark, [(1, files, 0), (1, files, 0)])
    assert got == {(1, "full_path"): 3, (1, "last_write_time"): 3, (1, "owner_name"): 3, (1, "mode"): 3}


def test_empty_table_long_text_and_clashing_columns(spark):
    assert run(spark, []) == {}
    groups = spark.createDataFrame([(1, [member(1, 1, path="x" * 200_000)], 0, 5, "t")], GROUPS + ", trust_rank int, field_name string")
    hosts = spark.createDataFrame([(1, 1, 3)], HOSTS + ", file_id long")
    assert len(duplicate_group_survivors(groups, hosts, 1).collect()) == 4


def test_records_of_complete_trusted_and_recent_members(spark):
    schema = "g long, i long, trust int, seen long, path string, owner string, extra int"
    rows = [
        (1, 1, 1, 5, None, "a", 0), (1, 2, 2, 9, "/p2", "b", 0), (1, 3, 2, 9, "/p3", "c", 0), (1, 3, 2, 9, "/p3", "c", 0), (1, 4, None, 99, "/p4", "d", 0),
        (2, 7, None, None, None, None, 0), (None, 1, 1, 1, "x", "y", 0), (3, None, 1, 1, "x", "y", 0), (4, 9, 1, None, "n", None, 0), (4, 8, 1, 1, "s", None, 0),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r.g: tuple(r)[1:] for r in surviving_records(df, "g", "i", "trust", "seen", {"path": F.col("path").isNotNull(), "owner": F.col("owner").isNotNull()}).collect()}
    assert got == {1: (4, 2, 2, "/p2", "a"), 2: (1, 7, 0, None, None), 4: (2, 8, 1, "s", None)}
    assert surviving_records(df.limit(0), "g", "i", "trust", "seen", {"path": F.lit(True)}).collect() == []
