"""Groupings, catalog tables, aggregators and table functions: odd rows and the plans they rely on."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from millrace.operators import custom
from millrace.operators.cubes import cube_sets, grouping_sets, rollup_sets
from millrace.operators.custom import CELL_LINES, CellParser, WeightedMedian, aggregate_with, apply_table_function
from millrace.sources.catalog import save_bucketed, save_partitioned

SF_DIR = "/root/testdata/sf0.001"


def plan(df, capsys):
    df.explain("formatted")
    return capsys.readouterr().out


@pytest.mark.parametrize("sets", [[("a", "b"), ("b",), ()], [("a",)], cube_sets(["a", "b"]), rollup_sets(["a", "b"])])
def test_grouping_sets(spark, sets):
    draw = random.Random(len(sets))
    rows = [(draw.choice([1, None, 2]), draw.choice(["x", None]), draw.choice([None, *range(6)]), draw.choice([None, 1, 2])) for _ in range(200)]
    df = spark.createDataFrame(rows, "a int, b string, v int, q int")
    want = []
    for names in sets:
        level = 2 * ("a" not in names) + ("b" not in names)
        groups = {}
        for a, b, v, q in rows:
            groups.setdefault((a if "a" in names else None, b if "b" in names else None), []).append((v, q))
        for (a, b), members in groups.items():
            known = [q for _, q in members if q is not None]
            want.append((a, b, level, len(members), sum(known) if known else None, len({v for v, _ in members if v is not None})))
    got = grouping_sets(df, ["a", "b"], sets, {"total": "q"}, ("values", "v"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert grouping_sets(df, ["a", "b"], sets).columns == ["a", "b", "level", "rows"]


def test_grouping_sets_of_nothing(spark):
    df = spark.createDataFrame([], "a int, v int")
    assert grouping_sets(df, ["a"], [("a",), ()], distinct=("values", "v")).filter("rows > 0").collect() == []
    # The distinct column may be a key.
    one = spark.createDataFrame([(1, 1), (1, 2), (3, 1)], "a int, v int")
    assert grouping_sets(one, ["a"], [()], distinct=("values", "a")).select("values").collect() == [(2,)]
    with pytest.raises(ValueError):
        grouping_sets(one, ["a"], [("v",)])


def test_groupings_read_once_and_count_in_two_steps(spark, capsys):
    text = plan(queries()["cube_counts"](spark, SF_DIR), capsys)
    assert text.count("Scan parquet") == 2  # once in the tree, once in the details
    # In the tree, printed from the top: put together before rows are copied, dealt by group and value before the count.
    tree = text[: text.index("\n\n")]
    below = tree[tree.index("Expand") :]
    assert below.count("HashAggregate") == 2 and tree[: tree.index("Expand")].count("Exchange") >= 2


def test_bucketed_tables_join_without_a_shuffle(spark, capsys):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = queries()["bucketed_join"](spark, SF_DIR)
        text = plan(joined, capsys)
        assert "SortMergeJoin" in text and "Exchange" not in text
        assert joined.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_saved_tables_keep_all_rows_and_are_replaced(spark, tmp_path):
    rows = [(None, "x"), (1, None), (1, "y"), (2, "z")] * 3
    df = spark.createDataFrame(rows, "k int, v string")
    for i in range(2):
        kept = save_bucketed(df.limit(100), "kept_buckets", ["k"], 3, str(tmp_path / "b"))
        assert Counter(map(tuple, kept.collect())) == Counter(rows)
        parts = save_partitioned(df.limit(100), "kept_parts", ["k"], str(tmp_path / "p"), sort=["v"])
        assert Counter(map(tuple, parts.select("k", "v").collect())) == Counter(rows)
    for name in ("kept_buckets", "kept_parts"):
        spark.sql(f"DROP TABLE {name}")


def test_only_wanted_partitions_are_read(spark, capsys):
    joined = queries()["pruned_join"](spark, SF_DIR)
    assert "dynamicpruning" in plan(joined, capsys).lower()
    assert joined.count() > 0


def test_aggregators_over_odd_keys(spark, monkeypatch):
    monkeypatch.setattr(custom, "GROUPS", 3)

    class Pairs:
        """Counts rows."""

        def start(self):
            return 0

        def add(self, state, value):
            return state + 1

        def merge(self, state, other):
            return state + other

        def finish(self, state):
            return state

    draw = random.Random(1)
    rows = [(draw.choice([None, "", "a", "b", "c", "hot", "hot", "hot"]), draw.choice([None, 1.0, -0.0]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, d double, state int").repartition(7)
    got = aggregate_with(df, ["k", "d"], Pairs(), ["state"], "n", "bigint")
    assert got.columns == ["k", "d", "n"]
    assert Counter({(r.k, r.d): r.n for r in got.collect()}) == Counter((k, d) for k, d, _ in rows)
    assert aggregate_with(df, [], Pairs(), ["state"], "n", "bigint").collect() == [(500,)]
    assert aggregate_with(df.limit(0), ["k"], Pairs(), ["state"], "n", "bigint").collect() == []


def test_weighted_median(spark):
    rows = [("a", 1.0, 1), ("a", 2.0, 1), ("a", 9.0, 2), ("b", 5.0, None), ("b", None, 3), ("b", 4.0, 0), ("c", 7.0, 1), (None, 3.0, 1)]
    df = spark.createDataFrame(rows, "k string, v double, w int")
    got = aggregate_with(df, ["k"], WeightedMedian(), ["v", "w"], "median", "double")
    assert dict(map(tuple, got.collect())) == {"a": 2.0, "b": None, "c": 7.0, None: 3.0}


def test_states_are_made_before_the_shuffle(spark, capsys):
    text = plan(queries()["weighted_median"](spark, SF_DIR), capsys)
    tree = text[: text.index("(1)")] if "(1)" in text else text
    assert text.count("MapInArrow") >= 2 and "Exchange" in text
    first, last = text.rindex("MapInArrow", 0, text.index("\n\n")), text.index("MapInArrow")
    # In the tree, printed from the top, one stands above the exchange and one below.
    assert last < text.index("Exchange") < first, tree


def test_table_function_keeps_state_within_a_group(spark):
    rows = [(1, 0, "a\n%x\nb\nc"), (1, 1, None), (2, 0, "%x\n%y"), (None, 0, "z"), (1, 2, "d")]
    cells = spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string")
    got = apply_table_function(cells, CellParser, CELL_LINES, ["conv_id"], ["turn"]).collect()
    assert sorted(((r.conv_id, r.turn, r.line, r.chunk, r.kind) for r in got), key=repr) == sorted(
        [
            (1, 0, 0, 1, "code"),
            (1, 0, 1, 2, "command"),
            (1, 0, 2, 3, "code"),
            (1, 0, 3, 3, "code"),
            (1, 1, 0, 4, "code"),
            (1, 2, 0, 5, "code"),
            (2, 0, 0, 1, "command"),
            (2, 0, 1, 2, "command"),
            (None, 0, 0, 1, "code"),
        ],
        key=repr,
    )
    assert apply_table_function(cells.filter(F.lit(False)), CellParser, CELL_LINES, ["conv_id"]).collect() == []
