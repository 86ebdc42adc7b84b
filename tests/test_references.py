"""Checks of references on many rows."""

from trackstream.operators import orders


def test_partitions_of_orphans_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(orders, "PART_ROWS", 1_000)
    child, parent = spark.range(20_000).selectExpr("id as line", "if(id % 7 = 0, null, id div 2) as k"), spark.range(10_000).where("id % 100 <> 3")
    few = spark.range(3)
    found = orders.orphans(child, "k", parent.unionByName(parent), "id")
    assert sorted(r.line for r in found.collect()) == [i for i in range(20_000) if i % 7 and i // 2 % 100 == 3]
    assert found.rdd.getNumPartitions() == 20 * 6 // 7
    assert orders.orphans(child.selectExpr("line", "line % 4 as k"), "k", few, "id").count() == 5_000
