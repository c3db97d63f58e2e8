"""The plans that the operators rely on."""

import pytest

from __spark_entry__ import queries

SF_DIR = "/root/testdata/sf0.001"


def plan(spark, capsys, name):
    queries()[name](spark, SF_DIR).explain("formatted")
    return capsys.readouterr().out


@pytest.mark.parametrize(
    "name,pushed",
    [
        ("typed_filter_count", "GreaterThanOrEqual(l_quantity,2.0)"),
        ("id_range_fetch", "GreaterThanOrEqual(o_orderkey,500)"),
        ("id_point_fetch", "EqualTo(o_orderkey,77)"),
        ("keyword_line_filter", "StringContains(text,The)"),
        ("blacklist_reject", "In(event_type, [error,purchase])"),
    ],
)
def test_filters_reach_the_scan(spark, capsys, name, pushed):
    assert pushed in plan(spark, capsys, name)


@pytest.mark.parametrize("name", ["statement_sequence", "blacklist_accept", "tag_reconcile", "rendered_table"])
def test_no_cross_joins(spark, capsys, name):
    text = plan(spark, capsys, name)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["retain_last_n", "log_tail"])
def test_small_slices_are_cut_before_the_shuffle(spark, capsys, name):
    assert "WindowGroupLimit" in plan(spark, capsys, name)


@pytest.mark.parametrize("name", ["frame_clean", "cell_split", "error_split", "tokenize_words", "json_rows"])
def test_no_shuffle(spark, capsys, name):
    assert "Exchange" not in plan(spark, capsys, name)


def test_scans_read_only_what_is_used(spark, capsys):
    assert "ReadSchema: struct<text:string>" in plan(spark, capsys, "word_count")
