"""Commits by batch number: retried, half-done and repeated batches, and how much a batch writes."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trackstream.operators import manifests, quantiles, sinks
from trackstream.operators.manifests import FactTable, KeyedTable, Manifest, Published
from trackstream.sources import topics


def test_manifest_is_swapped_whole(spark, tmp_path):
    m = Manifest(spark, str(tmp_path))
    assert m.at() == (-1, {})
    for v in (3, 5, 9):
        m.commit(v, {"rows": {"1": f"data/{v}/rows/slice=1"}})
    assert m.at() == (9, {"rows": {"1": "data/9/rows/slice=1"}}) and m.at(3)[1]["rows"]["1"].startswith("data/3")
    with pytest.raises(FileExistsError):
        m.commit(9, {})
    m.vacuum(keep=1)
    assert m.versions() == [9]


def test_keyed_table_by_brute_force(spark, tmp_path):
    rng = random.Random(1)
    table, want = KeyedTable(spark, f"{tmp_path}/k", ["k"], ["at"], 8), {}
    for version in range(6):
        rows = [(rng.choice([None, *range(20)]), rng.randrange(50), f"{version}-{i}", rng.random() < 0.2) for i in range(12)]
        best = {}
        for k, at, v, gone in rows:
            if k not in best or at > best[k][0]:
                best[k] = (at, v, gone)
        rows = [(k, *r) for k, r in best.items()]  # one row a key: ties within a batch have no fixed winner
        for k, at, v, gone in rows:
            if k not in want or at > want[k][0]:
                want[k] = (at, v, gone)
        batch = spark.createDataFrame(rows, "k int, at int, v string, gone boolean")
        assert table.merge(batch, version, F.col("gone"))
        assert not table.merge(batch.withColumn("v", F.lit("again")), version)  # a retry
        got = {r.k: (r.at, r.v, r.gone) for r in table.read().collect()}
        assert got == {k: r for k, r in want.items() if not r[2]}
    assert not table.merge(batch, 2)  # long gone
    with pytest.raises(ValueError, match="buckets"):
        KeyedTable(spark, f"{tmp_path}/k", ["k"], ["at"], 9).merge(batch, 99)


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["k"], ["at"], 16)
    table.merge(spark.range(4000).selectExpr("id as k", "id as at", "cast(id as string) as v"), 0)
    before = dict(table.manifest.at()[1]["rows"])
    one = spark.createDataFrame([(7, 10_000, "new")], "k long, at long, v string")
    table.merge(one, 1)
    after = table.manifest.at()[1]["rows"]
    changed = [b for b in after if after[b] != before[b]]
    assert len(before) == 16 and len(changed) == 1
    wrote = sum(f.stat().st_size for f in Path(tmp_path).glob("data/000000000001-*/**/*.parquet"))
    whole = sum(f.stat().st_size for f in Path(tmp_path).glob("data/000000000000-*/**/*.parquet"))
    assert wrote < whole / 8 and table.read().where("k = 7").first().v == "new" and table.read().count() == 4000
    table.merge(one.withColumn("at", F.lit(10_001).cast("long")), 2)
    table.merge(one.withColumn("at", F.lit(10_002).cast("long")), 3)
    left = {f.parts[-4] + f.parts[-2] for f in Path(tmp_path).glob("data/*/*/*/*.parquet")}
    assert len([x for x in left if x.endswith(changed[0].join(["slice=", ""]))]) == 2  # older versions of the bucket are gone


def test_a_failed_merge_changes_nothing(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path), ["k"], ["at"], 4)
    rows = spark.createDataFrame([(1, 1), (2, 1)], "k long, at long")
    table.merge(rows, 0)
    commit = Manifest.commit
    monkeypatch.setattr(Manifest, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost driver")))
    with pytest.raises(OSError, match="lost"):
        table.merge(rows.withColumn("at", F.lit(5).cast("long")), 1)
    assert sorted(map(tuple, table.read().collect())) == [(1, 1), (2, 1)]
    monkeypatch.setattr(Manifest, "commit", commit)
    assert table.merge(rows.withColumn("at", F.lit(6).cast("long")), 1)
    assert sorted(map(tuple, table.read().collect())) == [(1, 6), (2, 6)]


def test_facts_move_between_dates(spark, tmp_path):
    rng = random.Random(4)
    table, want = FactTable(spark, str(tmp_path), "id", "day", ["v"], 4), {}
    for version in range(5):
        rows = {k: (k, rng.randrange(6), version * 10 + rng.randrange(-12, 8)) for k in rng.sample(range(30), 10)}
        for k, day, v in rows.values():
            if k not in want or v > want[k][1]:
                want[k] = (day, v)
        batch = spark.createDataFrame(list(rows.values()), "id long, day int, v int")
        before = dict(table.manifest.at()[1].get("facts", {}))
        assert table.merge(batch, version) and not table.merge(batch, version)
        assert {r.id: (r.day, r.v) for r in table.read().collect()} == want
        assert table.read().count() == len(want)
        after = table.manifest.at()[1]["facts"]
        touched = {str(r[1]) for r in rows.values()}
        assert all(after[d] == before[d] for d in before if d not in touched and d in after and before[d] == after[d])
    only = spark.createDataFrame([(999, 77, 1)], "id long, day int, v int")
    before = dict(table.manifest.at()[1]["facts"])
    table.merge(only, 9)
    assert {d: p for d, p in table.manifest.at()[1]["facts"].items() if d != "77"} == before  # no other date was written


def test_two_sinks_show_a_batch_together(spark, tmp_path, monkeypatch):
    out = Published(spark, str(tmp_path))
    rows = spark.createDataFrame([(i, None if i % 3 else "bad") for i in range(9)], "id long, reason string")

    def both(k):
        some = rows.where(f"id % 3 = {k} or id < 3")
        return {"valid": some.where("reason is null"), "letters": some.where("reason is not null")}

    def counts():
        return out.read("valid").count(), out.read("letters").count()

    assert out.write(both(0), 0)
    first = counts()
    assert not out.write(both(0), 0) and counts() == first
    with pytest.raises(Exception, match="lost"):  # fails between the two
        out.write({"valid": both(1)["valid"], "letters": spark.range(1).select(F.raise_error(F.lit("lost")).alias("id"))}, 1)
    assert counts() == first
    assert out.write(both(1), 1)
    assert counts() == (first[0] + both(1)["valid"].count(), first[1] + both(1)["letters"].count())


def test_database_sink_takes_a_batch_once(spark, tmp_path, monkeypatch):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.createDataFrame([(i, i * 0.5) for i in range(700)], "id long, v double")
    real, failures = sinks._transaction, [1, 1]

    def flaky(*a):
        if failures:
            failures.pop()
            raise OSError("connection lost")
        return real(*a)

    monkeypatch.setattr(sinks, "_transaction", flaky)
    for number in (0, 0, 1, 1):
        sinks.to_jdbc_once(rows.withColumn("id", F.col("id") + 1000 * number), url, "facts", number, **driver)
    got = topics.jdbc(spark, url, "facts", "ID", 0, 2000, 4, **driver)
    assert got.count() == 1400 and got.select("id").distinct().count() == 1400
    failures += [1] * 9
    with pytest.raises(OSError):
        sinks.to_jdbc_once(rows, url, "facts", 2, retries=1, **driver)
    assert topics.jdbc(spark, url, "facts", "ID", 0, 2000, 4, **driver).count() == 1400


def test_null_keys_are_inserted_once(spark, tmp_path):
    rows = spark.createDataFrame([(None, 5), (1, 5), (1, None)], "driver_id long, event_ms long")
    for _ in range(3):
        sinks.insert_ignore(rows, f"{tmp_path}/n", ["driver_id", "event_ms"], "event_ms")
    assert spark.read.parquet(f"{tmp_path}/n").count() == 3


def test_newest_takes_the_greatest_row(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (None, 1, "c")], "k long, at long, v string")
    assert sorted(map(tuple, manifests.newest(rows, ["k"], ["at"]).collect()), key=str) == sorted([(1, 2, "b"), (None, 1, "c")], key=str)


def test_hourly_sketches_merge_into_long_quantiles(spark):
    """Exact up to ``k`` values; beyond, ranks within the bound, whatever the hours that were merged."""
    rng = random.Random(12)
    rows = [(k, h * quantiles.HOUR_MS + i, int(rng.lognormvariate(8, 1.2))) for k, n in ((1, 60), (2, 1500)) for h in range(20) for i in range(n // (1 + h % 3))]
    df = spark.createDataFrame([*rows, (1, 5, None), (None, 7, 3)], "k int, at long, v long")
    for k in (200, 4000):
        told = quantiles.merged(quantiles.hourly(df, ["k"], "at", "v", k), ["k"], {"median": 0.5, "p95": 0.95}, k=k)
        got = {r.k: r for r in told.collect()}
        assert got[None].p95 == 3
        for key in (1, 2):
            values = sorted(v for x, _, v in rows if x == key)
            assert got[key]["values"] == len(values)
            for name, share in (("median", 0.5), ("p95", 0.95)):
                low, high = sum(v < got[key][name] for v in values), sum(v <= got[key][name] for v in values)
                error = 0 if len(values) <= k else quantiles.rank_error(k)
                assert high >= (share - error) * len(values) - 1e-9 and low <= (share + error) * len(values) + 1e-9
    few = quantiles.merged(quantiles.hourly(df, ["k"], "at", "v"), ["k"], {"p95": 0.95}, quantiles.HOUR_MS, 3 * quantiles.HOUR_MS)
    assert {r.k: r["values"] for r in few.collect()} == {1: 30 + 20, 2: 750 + 500}
