"""The command line end to end, and functions registered for SQL."""

import pytest

from siltstone.cli import main
from siltstone.functions.registry import register
from siltstone.operators.rates import apply_conditions, deltas


@pytest.fixture(scope="module")
def scanned(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("cli")
    for name, data in (("a.txt", b"A" * 1024), ("b.txt", b"A" * 1024), ("c.txt", b"C" * 1024), ("x/old.tmp", b"1234\0"), ("x/skip.bin", b"")):
        p = root / "files" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    assert main(["scan", str(root / "files"), str(root / "catalog"), "--content", "--exclude", "skip"], spark) == 0
    return root


def run(spark, root, command, *args):
    target = root / f"out-{command}-{'-'.join(args).replace('/', '')}"
    main([command, str(root / "catalog"), str(target), *args], spark)
    return spark.read.parquet(str(target)).collect()


def test_commands(spark, scanned):
    rows = spark.read.parquet(str(scanned / "catalog"))
    assert rows.count() == 4
    one = rows.where("full_path like '%old.tmp'").first()
    told = (scanned / "files" / "x" / "old.tmp").stat()
    assert (one.mode, one.owner_id, one.inode, one.links) == (told.st_mode, told.st_uid, told.st_ino, 1) and not one.is_hidden
    assert one.accessed is not None and one.changed is not None and one.size_on_disk == told.st_blocks * 512
    groups = run(spark, scanned, "dedupe")
    assert [(r.size, r.n, r.savings) for r in groups] == [(1024, 2, 1024)]
    assert sorted(r.action for r in run(spark, scanned, "dedupe", "--action", "hardlink")) == ["hardlink", "keep"]
    assert len(run(spark, scanned, "similar")) == 2
    # The folder of the test may itself lie below /tmp, which makes the others cache files.
    plan = run(spark, scanned, "cleanup", "--as-of", "2100-01-01", "--days", "1")
    assert [r.full_path.rsplit("/", 1)[1] for r in plan if r.file_type == "temp"] == ["old.tmp"]
    assert sum(r.w * r.h for r in run(spark, scanned, "treemap", "--width", "2")) == pytest.approx(2)
    assert len(run(spark, scanned, "export")) == 4
    assert (scanned / "files" / "x" / "old.tmp").exists()


def test_unknown_choices_are_refused(spark, scanned):
    with pytest.raises(SystemExit):
        main(["burn", "a", "b"], spark)


def test_registered_functions(spark):
    assert "tlsh" in register(spark)
    assert spark.sql("SELECT byte_entropy(cast('aaaa' AS BINARY)) AS e, tlsh(cast(repeat('ab', 40) AS BINARY)) AS t").first().e == 0.0


def test_conditions_and_parameters(spark):
    df = spark.createDataFrame([(1, "it's"), (2, "x"), (3, None)], "k int, v string")
    rules = [{"name": "q", "condition": "v = :word", "action": "a", "parameters": {"word": "it's"}}, {"name": "n", "condition": "v is null", "action": "b", "priority": 3}, {"name": "off", "condition": "true", "action": "c", "enabled": False}]
    assert sorted(map(tuple, apply_conditions(df, rules, "k").collect())) == [(1, "q", "a", 0), (3, "n", "b", 3)]
    assert apply_conditions(df, [], "k").count() == 0


def test_deltas(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", 0), ("2024-01-01 00:00:10", 5), ("2024-01-01 00:00:20", 4)], "t string, n int").selectExpr("cast(t as timestamp) t", "n")
    got = [(r.n_change, r.n_rate, r.n_percent) for r in deltas(df, "t", ["n"]).orderBy("t").collect()]
    assert got == [(None, None, None), (5, 0.5, 100.0), (-1, -0.1, -20.0)]
