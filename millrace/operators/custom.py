"""Aggregators and table functions of a user's own, over Arrow batches."""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DataType, StructField, StructType

# Classes of this module travel to the executors with their jobs, which need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Groups whose states a task holds at a time.
GROUPS = 10_000


class Aggregator(Protocol):
    """How values of a group become one. States are pickled between tasks, so they should stay small."""

    def start(self) -> Any:
        """The state of no rows."""

    def add(self, state: Any, *values: Any) -> Any:
        """The state after one more row's values."""

    def merge(self, state: Any, other: Any) -> Any:
        """The state of the rows of both."""

    def finish(self, state: Any) -> Any:
        """The group's value."""


def aggregate_with(df: DataFrame, keys: Sequence[str], aggregator: Aggregator, columns: Sequence[str], name: str, kind: str | DataType) -> DataFrame:
    """``keys`` and ``name``, the value that ``aggregator`` makes of ``columns`` in each group, of type ``kind``.

    Each task first makes partial states of its own rows, ``GROUPS`` groups at a time; only states are shuffled, and merged group by
    group as they come in order, so a hot group sends a few states a task and is never held row by row. Null keys are keys.
    """
    n = len(keys)
    schema = StructType([df.schema[k] for k in keys])
    result = StructType().add(name, kind) if not isinstance(kind, str) else StructType.fromDDL(f"`{name}` {kind}")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, list] = {}
        types = None

        def flush() -> pa.RecordBatch:
            arrays = [pa.array([row[i] for row, _ in states.values()], types[i]) for i in range(n)]
            arrays.append(pa.array([pickle.dumps(s) for _, s in states.values()], pa.binary()))
            states.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[f"k{i}" for i in range(n)] + ["state"])

        for batch in batches:
            types = [c.type for c in batch.columns[:n]]
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                # Told apart by type as well, for 1, 1.0 and true are equal in Python.
                key = tuple((type(v), repr(v) if isinstance(v, (list, dict)) else v) for v in row[:n])
                held = states.get(key)
                if held is None:
                    if len(states) >= GROUPS:
                        yield flush()
                    held = states[key] = [row[:n], aggregator.start()]
                held[1] = aggregator.add(held[1], *row[n:])
        if states:
            yield flush()

    whole = StructType(schema.fields + result.fields)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, done = to_arrow_schema(whole), []
        now, last, state = None, [], None

        def flush() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in done], f.type) for i, f in enumerate(arrow)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        for batch in batches:
            for *key, held in zip(*[c.to_pylist() for c in batch.columns]):
                told = repr(key)
                if told != now:
                    if now is not None:
                        done.append([*last, aggregator.finish(state)])
                    now, last, state = told, key, pickle.loads(held)
                else:
                    state = aggregator.merge(state, pickle.loads(held))
            if len(done) >= 1024:
                yield flush()
        if now is not None:
            done.append([*last, aggregator.finish(state)])
        yield flush()

    names = [f"k{i}" for i in range(n)]
    inner = StructType([StructField(name, f.dataType) for name, f in zip(names, schema.fields)] + [StructField("state", BinaryType())])
    chosen = df.select(*[F.col(k).alias(name) for k, name in zip(keys, names)], *columns)
    states = chosen.mapInArrow(partial, inner)
    if not keys:
        return states.repartition(1).mapInArrow(merged, whole)
    return states.repartition(*names).sortWithinPartitions(*names).mapInArrow(merged, whole)


class WeightedMedian:
    """The least value that at least half of the weight lies at or below; null without any positive weight.

    The state is the weight of each different value. Rows with a null, or without positive weight, do not count.
    """

    def start(self) -> dict:
        return {}

    def add(self, state: dict, value: Any, weight: Any) -> dict:
        if value is not None and weight is not None and weight > 0:
            state[value] = state.get(value, 0) + weight
        return state

    def merge(self, state: dict, other: dict) -> dict:
        for value, weight in other.items():
            state[value] = state.get(value, 0) + weight
        return state

    def finish(self, state: dict) -> Any:
        half, below = sum(state.values()) / 2, 0
        for value in sorted(state):
            below += state[value]
            if below >= half:
                return value
        return None


def apply_table_function(df: DataFrame, handler: type, returns: str, partition_by: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """The rows that a table function makes of ``df``, group by group.

    ``handler`` is a class with ``eval(row)``, called for each row of a group in order, and, if it likes, ``terminate()`` at its
    end; both yield tuples of ``returns``. A new one is made for each group, so what it keeps in itself is the group's. Rows
    are streamed to it; a group is one task's, so give keys whose groups a task can walk through. Null keys are a group.
    """
    argument = df.asTable().partitionBy(*partition_by)
    if order_by:
        argument = argument.orderBy(*order_by)
    return F.udtf(handler, returnType=returns, useArrow=True)(argument)


class CellParser:
    """Cells of a session in order, line by line: a line that starts with ``%`` is a command and a chunk of its own, lines between
    are a chunk of code. Chunks are numbered through the session; a cell never continues the chunk of the one before."""

    def __init__(self) -> None:
        self.chunk = 0

    def eval(self, row):
        code = False
        for number, line in enumerate((row["text"] or "").split("\n")):
            command = line.startswith("%")
            if command or not code:
                self.chunk += 1
            code = not command
            yield row["conv_id"], row["turn"], number, self.chunk, "command" if command else "code", line


CELL_LINES = "conv_id bigint, turn bigint, line int, chunk int, kind string, text string"
