"""Change messages: tasks follow the rows, values are made once, and only the topics asked for are read."""

import re

from tests.conftest import SF
from trackstream.operators import cdc
from trackstream.plans import catalogue
from trackstream.sources import tables as t


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def made(text):
    """How often values are made in a plan."""
    return len(re.findall(r"StructsToJsonEvaluator|to_json\(", text))


def test_tasks_follow_rows(spark):
    n = t.table(spark, SF, "orders").count()
    assert t.spread(t.table(spark, SF, "orders"), "o_orderkey", 100).rdd.getNumPartitions() == -(-n // 100) > 1
    assert t.order_messages(spark, "/root/testdata/sf0.1").rdd.getNumPartitions() == 8  # 150,000 orders in one small file


def test_values_are_made_once_and_outside_generators(spark):
    rows = plan(cdc.changes(cdc.normalise(t.order_messages(spark, SF))))
    assert made(rows) == 1 and rows.count("from_json") == 1
    assert not re.search(r"Generate explode\([^\n]*(StructsToJson|to_json|from_json)", rows)
    assert made(plan(catalogue.captured(spark, SF, ("deliveries",)))) == 1


def test_captured_tables_come_from_their_topics(spark):
    for query in (catalogue.terminal_deliveries, catalogue.captured_events):
        read = re.findall(r"ReadSchema: (\S+)", query(spark, SF)._jdf.queryExecution().executedPlan().toString())
        assert read and not [r for r in read if "l_orderkey" in r or "o_totalprice" in r], read


def test_one_trail_puts_only_its_own_changes_in_order(spark):
    text = plan(catalogue.one_trail(spark, SF))
    assert text.index("Window") < text.index("LeftSemi")  # the join is below the window
    assert text.count("Window") == 1 == text.count("Aggregate")


def test_order_of_changes_moves_no_images(spark):
    for query in ("illegal_transitions", "cdc_captured_events", "cdc_dedup"):
        window = next(line for line in plan(catalogue.QUERIES[query](spark, SF)).splitlines() if "Window [" in line)
        assert "before#" not in window and "after#" not in window
        below = plan(catalogue.QUERIES[query](spark, SF)).split("Window [", 1)[1].splitlines()[1]
        assert not re.search(r"AS (before|after|raw)#", below), below


def test_samples_are_spread_and_made_outside_generators(spark):
    rows = t.location_messages(spark, "/root/testdata/sf0.1")
    assert rows.rdd.getNumPartitions() == 3  # 100,000 events in one small file
    assert made(plan(rows)) == 1 and not re.search(r"Generate explode\([^\n]*(StructsToJson|to_json)", plan(rows))
