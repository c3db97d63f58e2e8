"""Typed tables and JSON views of rows, and the reply documents around them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREVIEW_SIZE = 10

# Type tags by the variant type's leading word.
TAGS = {
    "VOID": "NULL_TYPE",
    "BOOLEAN": "BOOLEAN_TYPE",
    "STRING": "STRING_TYPE",
    "BIGINT": "BIGINT_TYPE",
    "DECIMAL": "DOUBLE_TYPE",
    "DOUBLE": "DOUBLE_TYPE",
    "FLOAT": "DOUBLE_TYPE",
    "ARRAY": "ARRAY_TYPE",
    "OBJECT": "MAP_TYPE",
}
# Messages of the renderer.
ROW_CONFLICT = "table rows have different types"
CELL_CONFLICT = "value has inconsistent types"
TEXT_MIME = "text/plain"


def type_tag(value: Column) -> Column:
    """Type tag of a variant. JSON integers are BIGINT_TYPE, all fractions DOUBLE_TYPE."""
    table = F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv])
    # The type's leading word; what follows it in brackets is that of the elements.
    word = F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)
    return F.coalesce(F.try_element_at(table, word), F.lit("STRING_TYPE"))


def _row_variant(json: Column) -> Column:
    """A JSON row as a variant array or object; a scalar row becomes an array of one."""
    shaped = F.when(json.rlike(r"^\s*[\[{]"), json).otherwise(F.concat(F.lit("["), json, F.lit("]")))
    return F.parse_json(shaped)


def json_cells(df: DataFrame, json_col: str, *keep: str) -> DataFrame:
    """One row per cell of semi-structured JSON rows: ``keep..., name, cell``.

    Objects give their keys, arrays their positions, and a scalar the single name ``0``.
    """
    rows = df.select(*keep, _row_variant(F.col(json_col)).alias("_row"))
    cells = rows.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_row").outer()))
    name = F.coalesce("key", F.col("pos").cast("string"))
    return cells.select(*keep, name.alias("name"), F.col("value").alias("cell"))


def _column_tags(df: DataFrame, json_col: str) -> DataFrame:
    """Smallest and largest non-null tag, and whether there is a null, per column name. Three
    values per column and task are shuffled, whatever the number of rows."""
    tag = type_tag(F.col("cell"))
    cells = json_cells(df, json_col).select("name", tag.alias("tag"))
    typed = F.when(F.col("tag") != "NULL_TYPE", F.col("tag"))
    return cells.groupBy("name").agg(
        F.min(typed).alias("low"),
        F.max(typed).alias("high"),
        F.max(F.col("tag") == "NULL_TYPE").alias("nulls"),
    )


def inferred_headers(df: DataFrame, json_col: str) -> DataFrame:
    """``name, type``: the header of the table. A null yields to any other tag; a column
    with two other tags has no type (see :func:`type_conflicts`). Names are sorted, positions of
    array rows by number."""
    tags = _column_tags(df, json_col)
    # One row per distinct column name, so the global order is over the table's width.
    number = F.col("name").try_cast("bigint")
    rows = tags.select(
        "name",
        F.when(F.col("low").isNull(), "NULL_TYPE")
        .when(F.col("low") == F.col("high"), F.col("low"))
        .alias("type"),
    )
    return rows.orderBy(number.asc_nulls_last(), "name")


def type_conflicts(df: DataFrame, json_col: str, strict: bool = False) -> DataFrame:
    """``name, error`` for columns whose rows differ in type, and for columns with a collection whose elements do.
    With ``strict`` a null is a type."""
    differs = F.col("low") != F.col("high")
    if strict:
        differs = differs | (F.col("nulls") & F.col("low").isNotNull())
    rows = _column_tags(df, json_col).filter(differs).select("name", F.lit(ROW_CONFLICT).alias("error"))
    return rows.unionByName(mixed_cells(df, json_col).select("name", F.lit(CELL_CONFLICT).alias("error")).distinct())


def mixed_cells(df: DataFrame, json_col: str, *keep: str) -> DataFrame:
    """``keep..., name`` of cells that hold an array or object whose elements differ in type."""
    cells = json_cells(df, json_col, *keep).withColumn("_text", F.to_json("cell"))
    nested = cells.filter(F.col("_text").rlike(r"^[\[{]"))
    return nested.filter(~is_uniform(F.col("_text"))).select(*keep, "name")


def is_uniform(json_text: Column) -> Column:
    """Whether all elements of a JSON array, or all values of an object, have one type tag, also in collections
    inside it, however deep; empty collections, scalars and null are uniform, and a null beside a value is not.

    Text that is no JSON gives null; a null text is uniform. Expressions have a fixed depth, so the
    texts go to a batch function that walks them with a stack of its own; texts nested deeper than the parser of the
    standard library goes are read token by token.
    """

    @F.pandas_udf("boolean")
    def uniform(texts: pd.Series) -> pd.Series:
        import json
        import re

        token = re.compile(
            r'[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null)|([\[\]{}:,]))'
        )
        after = {"[": ("value", "]"), "{": ("key", "}")}

        def whole(digits: str) -> int | float:
            number = int(digits)
            return number if -(2**63) <= number < 2**63 else float(digits)

        def one_type(text: str) -> bool | None:
            try:
                todo = [json.loads(text, parse_int=whole)]
            except RecursionError:
                return by_tokens(text)
            except ValueError:
                return None
            while todo:
                value = todo.pop()
                items = value if type(value) is list else list(value.values()) if type(value) is dict else ()
                if len(set(map(type, items))) > 1:
                    return False
                if items and type(items[0]) in (list, dict):
                    todo += items
            return True

        def by_tokens(text: str) -> bool | None:
            # What may come next, and for each open collection its bracket, its elements' types by key or place, and the key.
            text = text.rstrip(" \t\n\r")
            at, wanted, opened, alike = 0, {"value"}, [], True
            while at < len(text):
                found = token.match(text, at)
                if found is None:
                    return None
                at = found.end()
                string, number, word, mark = found.groups()
                if string is not None and "key" in wanted:
                    opened[-1][2] = json.loads(string)
                    wanted = {":"}
                    continue
                if mark in (":", ",") and mark in wanted:
                    wanted = {"value"} if mark == ":" or opened[-1][0] == "[" else {"key"}
                    continue
                if mark in ("]", "}") and mark in wanted:
                    alike &= len(set(opened.pop()[1].values())) <= 1
                elif "value" not in wanted or mark in ("]", "}", ":", ","):
                    return None
                else:
                    kind = str if string is not None else mark if mark is not None else type(json.loads(word or number, parse_int=whole))
                    if opened:
                        held = opened[-1]
                        held[1][held[2] if held[0] == "{" else len(held[1])] = kind
                    if mark is not None:
                        opened.append([mark, {}, None])
                        wanted = set(after[mark])
                        continue
                wanted = {",", after[opened[-1][0]][1]} if opened else set()
            return None if opened or wanted else alike

        return pd.Series([text is None or one_type(text) for text in texts], dtype="boolean")

    return uniform(json_text)


def collection_uniformity(df: DataFrame, json_col: str, *keep: str) -> DataFrame:
    """``keep..., uniform`` for a column of JSON values; null where the text is no JSON."""
    return df.select(*keep, is_uniform(F.col(json_col)).alias("uniform"))


def _cell(field: T.StructField) -> Column:
    """A typed column as a variant; dates, timestamps, decimals and binaries as strings."""
    c, t = F.col(f"`{field.name}`"), field.dataType
    if isinstance(t, (T.StructType, T.MapType, T.ArrayType)):
        return F.to_variant_object(c)
    plain = (T.BooleanType, T.IntegralType, T.FloatType, T.DoubleType, T.StringType)
    return (c if isinstance(t, plain) else c.cast("string")).cast("variant")


def table_rows(df: DataFrame, *keep: str) -> DataFrame:
    """``keep..., row``: each row as a JSON array of its values, columns sorted by name."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    return df.select(*keep, F.to_json(F.array(*[_cell(f) for f in fields])).alias("row"))


def rendered_table(
    df: DataFrame, json_col: str, order: list[str], n: int = PREVIEW_SIZE, strict: bool = False
) -> DataFrame:
    """One row: the first ``n`` semi-structured rows as a table document, or why there is none.

    ``document`` is ``{"headers": [{"type", "name"}], "data": [[...]]}``; rows are padded with nulls
    for names they lack. ``error`` is set instead when a cell holds a collection of mixed types, or when a
    column has two types; with ``strict`` a null beside a value is one too. Only these ``n`` rows are looked at,
    as for any display.
    """
    # Ranked before the limit: at most n rows reach the expressions below.
    shown = (
        df.select(*order, F.col(json_col).alias("_doc"))
        .orderBy(*order)
        .limit(n)
        .agg(F.sort_array(F.collect_list(F.struct(*order, "_doc"))).alias("_docs"))
        .select(F.posexplode_outer("_docs").alias("_row", "_d"))
        .select("_row", F.col("_d._doc").alias("_doc"))
    )
    by_name = F.struct(F.col("name").try_cast("bigint").alias("n"), "name", "type")
    headers = inferred_headers(shown, "_doc").agg(
        F.sort_array(F.collect_list(by_name)).alias("_heads"),
        F.coalesce(F.max(F.col("type").isNull()), F.lit(False)).alias("_mixed"),
    )
    variant = _row_variant(F.col("_doc"))
    items = F.try_variant_get(variant, "$", "array<variant>")
    at = F.transform(F.sequence(F.lit(0), F.size(items) - 1), lambda i: i.cast("string"))
    positional = F.when(F.size(items) > 0, F.map_from_arrays(at, items))
    cells = F.coalesce(F.try_variant_get(variant, "$", "map<string,variant>"), positional)
    data = shown.filter(F.col("_doc").isNotNull()).agg(
        F.sort_array(F.collect_list("_row")).alias("_order"),
        F.map_from_entries(F.collect_list(F.struct("_row", cells.alias("cells")))).alias("_cells"),
    )
    mixed = headers.select("_mixed")
    if strict:
        mixed = type_conflicts(shown, "_doc", strict=True).filter(F.col("error") == ROW_CONFLICT).agg(F.count("*") > 0)
    joined = data.withColumns(
        {
            "_heads": headers.select("_heads").scalar(),
            "_mixed": mixed.scalar(),
            "_cell": mixed_cells(shown.filter(F.col("_doc").isNotNull()), "_doc").agg(F.count("*") > 0).scalar(),
        }
    )
    names = F.transform("_heads", lambda h: h["name"])
    rows = F.transform(
        "_order",
        lambda r: F.transform(names, lambda c: F.try_element_at(F.try_element_at("_cells", r), c)),
    )
    tags = F.transform("_heads", lambda h: F.struct(h["type"].alias("type"), h["name"].alias("name")))
    doc = F.to_json(F.struct(tags.alias("headers"), rows.alias("data")))
    return joined.select(
        F.when(~F.col("_mixed") & ~F.col("_cell"), doc).alias("document"),
        F.when(F.col("_cell"), CELL_CONFLICT).when(F.col("_mixed"), ROW_CONFLICT).alias("error"),
    )


def json_rows(df: DataFrame, order: list[str], n: int | None = PREVIEW_SIZE) -> DataFrame:
    """``json``: the first ``n`` rows (all with ``None``) as JSON documents that keep nulls."""
    rows = df if n is None else df.orderBy(*order).limit(n)
    doc = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return rows.select(doc.alias("json"))


def envelope(
    count: Column, kind: Column, data: Column, ename: Column, evalue: Column, traceback: Column
) -> Column:
    """The JSON reply of a statement.

    ``kind`` is ``ok`` (reply holds ``data``, a map of MIME type to value), ``error`` (reply holds
    name, value and traceback), ``incomplete`` or ``aborted`` (``evalue`` is the last message).
    """
    none = F.array().cast("array<string>")
    good = F.struct(F.lit("ok").alias("status"), count.alias("execution_count"), data.alias("data"))

    def bad(name: Column, value: Column, trace: Column) -> Column:
        return F.to_json(
            F.struct(
                F.lit("error").alias("status"),
                count.alias("execution_count"),
                name.alias("ename"),
                value.alias("evalue"),
                trace.alias("traceback"),
            )
        )

    return (
        F.when(kind == "ok", F.to_json(good))
        .when(kind == "incomplete", bad(F.lit("Error"), F.lit("incomplete statement"), none))
        .when(
            kind == "aborted",
            bad(F.lit("Error"), F.concat(F.lit("Interpreter died:\n"), evalue), none),
        )
        .otherwise(bad(ename, evalue, F.coalesce(traceback, none)))
    )
