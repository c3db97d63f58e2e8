"""Repair of conversations whose turns are blank, repeated, cut off or out of order.

A conversation becomes a *shape*, one symbol a row: the initial of its role and its first fault. The cheapest
edits that leave role initials ``(s?(ua)+)?`` are a shortest path through four states of that grammar, so a symbol is a
min-plus matrix from state to state whose entries hold a cost and an audit, the initials of the edits. Equal shapes are solved
once. Re-Pair replaces frequent pairs of symbols by new ones, over all shapes; each rule's matrix is the product of
its two parts, made once, bottom up, and used wherever the rule stands in any conversation.

Audits are ropes: a product joins two entries without copying. Of equal costs the ASCII-least audit counts; that may be
decided part by part, because audits of equal cost that cover the same rows are never a prefix of one another: what is left of
the longer one could only be insertions, which cost.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from millrace.llm.graph import written
from millrace.plans.spread import CHUNK, chunked, spread_join

#: Costs of the edits, and of a cut-off row that stays.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: Symbols by fault: none, cut off, blank, repeated; in each the initials s, u, a and any other.
SYMBOLS = {"": "suao", "truncated": "SUAO", "blank": "1234", "duplicate": "5678"}
INITIALS = {symbol: "suao"[i] for part in SYMBOLS.values() for i, symbol in enumerate(part)}
LEGAL = ("su", "ua", "au")
#: States of the grammar: nothing yet, after s, after u, after a; those a conversation may end in.
STATES = range(4)
ENDS = (0, 3)
#: Rows of a conversation that one task orders and solves in one piece.
ROWS_PER_CHUNK = 65_536
#: Rules made at a time, rounds of it, and the fewest places a rule must stand at. The expansion of a rule at most
#: doubles from round to round. They change the work, not the result.
RULES_PER_ROUND = 64
ROUNDS = 5
LEAST = 4
#: Rules are written as characters from here on.
_FIRST_RULE = 0x4E00
#: The characters that are no content, as a SQL literal.
_SPACE = "' \\u0009\\u000a\\u000b\\u000c\\u000d'"


def next_role(state: int) -> tuple[str, int]:
    """The role that an inserted or renamed row takes, and the state after it."""
    return ("assistant", 3) if state == 2 else ("user", 2)


def keep_state(state: int, initial: str) -> int | None:
    """The state after a kept row, where the grammar lets it stay."""
    if initial == "s":
        return 1 if state == 0 else None
    if initial == "u":
        return 2 if state != 2 else None
    return 3 if initial == "a" and state == 2 else None


class Rope:
    """A text put together of two ropes; spelled out when first asked for."""

    __slots__ = ("_parts", "_text")

    def __init__(self, text: str | None = None, parts: tuple[Rope, Rope] | None = None) -> None:
        self._text, self._parts = text, parts

    def __add__(self, other: Rope) -> Rope:
        if self._text == "":
            return other
        return self if other._text == "" else Rope(parts=(self, other))

    @property
    def text(self) -> str:
        if self._text is None:
            out, todo = [], [self]
            while todo:
                rope = todo.pop()
                if rope._text is None:
                    todo += (rope._parts[1], rope._parts[0])
                else:
                    out.append(rope._text)
            self._text, self._parts = "".join(out), None
        return self._text


#: From state to state: a cost and a rope, or None where there is no way.
Matrix = list[list[tuple[int, Rope] | None]]


def better(a: tuple[int, Rope] | None, b: tuple[int, Rope] | None) -> tuple[int, Rope] | None:
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if a[1].text <= b[1].text else b


def product(left: Matrix, right: Matrix) -> Matrix:
    """The min-plus product; ``left`` may have fewer rows than there are states."""
    out = []
    for row in left:
        made = []
        for j in STATES:
            best, least = None, None
            for way, tail in zip(row, right):
                last = tail[j]
                if way is None or last is None:
                    continue
                cost = way[0] + last[0]
                if least is not None and cost > least:
                    continue
                entry = (cost, way[1] + last[1])
                best = entry if least is None or cost < least else better(best, entry)
                least = cost
            made.append(best)
        out.append(made)
    return out


def insertions() -> Matrix:
    """No insertion, one or two: more never lead to another state."""
    out: Matrix = [[None] * 4 for _ in STATES]
    for state in STATES:
        at, cost, audit = state, 0, ""
        for _ in range(3):
            out[state][at] = better(out[state][at], (cost, Rope(audit)))
            at, cost, audit = next_role(at)[1], cost + INSERT, audit + "I"
    return out


def symbol_matrix(symbol: str) -> Matrix:
    """Insertions, then the row itself kept, renamed or deleted."""
    fault = next(name for name, part in SYMBOLS.items() if symbol in part)
    row: Matrix = [[None] * 4 for _ in STATES]
    for state in STATES:
        row[state][state] = (DELETE, Rope("D"))
        if fault in ("blank", "duplicate"):
            continue
        extra = CUT_OFF if fault == "truncated" else 0
        kept, renamed = keep_state(state, INITIALS[symbol]), next_role(state)[1]
        row[state][renamed] = better(row[state][renamed], (REROLE + extra, Rope("R")))
        if kept is not None:
            row[state][kept] = better(row[state][kept], (extra, Rope("K")))
    return product(insertions(), row)


def rule_symbol(place: int) -> str:
    return chr(_FIRST_RULE + place)


def compressed(shape: str, rules: list[str]) -> str:
    """The shape with each pair of ``rules``, in their order, replaced by the rule's own symbol."""
    for place, pair in enumerate(rules):
        shape = shape.replace(pair, rule_symbol(place))
    return shape


def matrices(rules: list[str]) -> dict[str, Matrix]:
    """The matrix of each symbol and, bottom up, of each rule."""
    made = {symbol: symbol_matrix(symbol) for symbol in INITIALS}
    for place, (left, right) in enumerate(rules):
        made[rule_symbol(place)] = product(made[left], made[right])
    return made


def shape_matrix(shape: str, rules: list[str], made: dict[str, Matrix], starts: int) -> Matrix:
    """The matrix of a shape from the first ``starts`` states, by a balanced product over its compressed symbols."""
    if not shape:
        return [[(0, Rope("")) if i == j else None for j in STATES] for i in range(starts)]
    parts = [made[c] for c in compressed(shape, rules)]
    parts[0] = parts[0][:starts]
    while len(parts) > 1:
        joined = [product(a, b) for a, b in zip(parts[::2], parts[1::2])]
        parts = joined + parts[len(joined) * 2 :]
    return parts[0]


def learn_rules(shapes: DataFrame) -> list[str]:
    """Pairs of symbols for Re-Pair, most frequent first. Each round counts pairs over all shapes, added up before the
    shuffle, and only the ``RULES_PER_ROUND`` most frequent come to the driver."""
    rules: list[str] = []
    for _ in range(ROUNDS):
        known = list(rules)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                seen: Counter[str] = Counter()
                for shape in batch.column(0).to_pylist():
                    text = compressed(shape, known)
                    found = Counter(map("".join, zip(text, text[1:])))
                    for pair in found:
                        # Overlapping pairs of one symbol cannot all be replaced.
                        seen[pair] += text.count(pair) if pair[0] == pair[1] else found[pair]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pair", "n"]
                )

        pairs = shapes.select("shape").mapInArrow(count, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
        best = pairs.filter(F.col("n") >= LEAST).orderBy(F.col("n").desc(), "pair").limit(RULES_PER_ROUND).collect()
        if not best:
            break
        rules += [row.pair for row in best]
    return rules


def _solved(shapes: DataFrame, rules: list[str]) -> DataFrame:
    """``shape, entries``: the ways from the states that a part of a conversation may start in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = matrices(rules)
        entry = pa.list_(pa.struct({"start": pa.int32(), "stop": pa.int32(), "cost": pa.int64(), "audit": pa.string()}))
        for batch in batches:
            out = []
            for shape, cut in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ways = shape_matrix(shape, rules, made, 4 if cut else 1)
                out.append(
                    [
                        {"start": i, "stop": j, "cost": way[0], "audit": way[1].text}
                        for i, row in enumerate(ways)
                        for j, way in enumerate(row)
                        if way is not None
                    ]
                )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, entry)], names=["shape", "entries"])

    fields = "shape string, entries array<struct<start: int, stop: int, cost: bigint, audit: string>>"
    return shapes.select("shape", "cut").mapInArrow(run, fields)


def _joined_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of a conversation in order to its cheapest audit."""
    last = insertions()
    for batch in batches:
        costs, audits, shapes = [], [], []
        for parts in batch.column(1).to_pylist():
            ways: Matrix = [[(0, Rope("")), None, None, None]]
            for part in parts:
                matrix: Matrix = [[None] * 4 for _ in STATES]
                for e in part["entries"]:
                    matrix[e["start"]][e["stop"]] = (e["cost"], Rope(e["audit"]))
                ways = product(ways, matrix)
            row = product(ways, last)[0]
            best = None
            for end in ENDS:
                best = better(best, row[end])
            costs.append(best[0])
            audits.append(best[1].text)
            shapes.append("".join(p["shape"] for p in parts))
        arrays = [batch.column(0), pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(shapes, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "cost", "audit", "shape"])


def _core(text: str) -> Column:
    """The text without white space at its end."""
    return F.expr(f"trim(TRAILING {_SPACE} FROM {text})")


def _read(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` with nulls of role and text read as one space, and the text's ``digest``."""
    copies = F.col("copies").cast("bigint") if "copies" in turns.columns else F.lit(1).cast("bigint")
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        copies.alias("copies"),
    )
    return rows.withColumn("digest", F.md5(F.col("text").cast("binary")))


def audits(turns: DataFrame) -> DataFrame:
    """``conv_id, cost, audit, shape`` for each conversation of ``turns``.

    Rows of a conversation are ordered by turn, nulls first, then role, then digest of the text. Equal rows are added
    up before the shuffle and stand one after the other. Long conversations are cut into chunks that are solved apart.
    """
    rows = _read(turns).withColumn("core", _core("text"))
    fault = (
        F.when(F.col("core") == "", "blank")
        .when(F.right("core", F.lit(1)).isin(".", "!", "?"), "")
        .otherwise("truncated")
    )
    same = ["conv_id", "turn", "role", "digest"]
    rows = written(rows.withColumn("fault", fault).groupBy(*same, "fault").agg(F.sum("copies").alias("copies")), "turns")
    earlier = (
        rows.filter("fault != 'blank'")
        .groupBy("conv_id", "role", "digest")
        .agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("turns"))
        .filter("turns > 1")
    )
    marked = spread_join(rows, earlier, ["conv_id", "role", "digest"], ["turn"])
    again = F.col("first").isNotNull() & (F.struct("turn") > F.col("first"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")

    def symbol(fault: str) -> Column:
        return F.translate(kind, "suao", SYMBOLS[fault])

    first = (
        F.when(F.col("fault") == "blank", symbol("blank"))
        .when(again, symbol("duplicate"))
        .when(F.col("fault") == "truncated", symbol("truncated"))
        .otherwise(symbol(""))
    )
    rest = F.when(F.col("fault") == "blank", symbol("blank")).otherwise(symbol("duplicate"))
    marked = marked.select(*same, F.concat(first, F.repeat(rest, (F.col("copies") - 1).cast("int"))).alias("symbols"))
    order = ["turn", "role", "digest"]
    cut = chunked(marked, ["conv_id"], order, rows_per_chunk=ROWS_PER_CHUNK).withColumnsRenamed({CHUNK: "chunk", "_hot": "cut"})
    parts = cut.groupBy("conv_id", "chunk", "cut").agg(F.array_sort(F.collect_list(F.struct(*order, "symbols"))).alias("rows"))
    parts = written(parts.select("conv_id", "chunk", "cut", F.array_join("rows.symbols", "").alias("shape")), "parts")
    shapes = written(parts.groupBy("shape").agg(F.max("cut").alias("cut")), "shapes")
    solved = _solved(shapes, learn_rules(shapes))
    known = spread_join(parts, solved, ["shape"], ["conv_id", "chunk"], how="inner")
    whole = known.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "shape", "entries"))).alias("parts"))
    return whole.mapInArrow(_joined_parts, parts_schema(turns, "cost bigint, audit string, shape string"))


def parts_schema(turns: DataFrame, fields: str) -> str:
    return f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {fields}"


class Walk:
    """One conversation, followed row by row beside its audit."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.cost, self.audit, self.shape = conv_id, 0, "", ""
        self.at, self.state = 0, 0
        self.turn, self.first, self.turns = None, None, 0

    def inserted(self) -> Iterator[str]:
        while self.audit[self.at : self.at + 1] == "I":
            role, self.state = next_role(self.state)
            self.at += 1
            yield role

    def row(self, turn, role: str, copies: int) -> Iterator[tuple[str, str, bool]]:
        """What stays of a row and stands before it: edit, role, and whether the row's text goes with it."""
        if turn is not None and turn != self.turn:
            self.turn, self.turns = turn, self.turns + 1
            self.first = turn if self.first is None else self.first
        for _ in range(copies):
            for new in self.inserted():
                yield "I", new, False
            edit = self.audit[self.at]
            self.at += 1
            if edit == "R":
                role, self.state = next_role(self.state)
            elif edit == "K":
                self.state = keep_state(self.state, role[:1])
            if edit != "D":
                yield edit, role, True

    def counts(self) -> list[int]:
        """gaps, blank, duplicate, truncated, illegal, cost."""
        gaps = 0 if self.first is None else self.turn - self.first + 1 - self.turns
        tally = Counter(self.shape)
        faults = [sum(tally[c] for c in SYMBOLS[name]) for name in ("blank", "duplicate", "truncated")]
        initials = "".join(map(INITIALS.get, self.shape))
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
        return [gaps, *faults, illegal, self.cost]


def _walked(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Each conversation's name, its audit and its rows, one after the other in one partition. The rows are streamed, so
    a long conversation takes its task time but no memory. Equal rows of a batch are put together before the shuffle."""
    rows = _read(turns)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = ["conv_id", "turn", "role", "digest"]
            once = pa.Table.from_batches([batch]).group_by(keys, use_threads=False)
            table = once.aggregate([("text", "min"), ("copies", "sum")]).select([*keys, "text_min", "copies_sum"])
            yield from table.rename_columns([*keys, "text", "copies"]).to_batches()

    names = ["conv_id", "turn", "role", "digest", "text", "copies"]
    fields = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    rows = rows.select(*names).mapInArrow(combine, fields).withColumn("kind", F.lit(2))
    heads = ids.select("conv_id").distinct().withColumn("kind", F.lit(0))
    found = audits(turns).select("conv_id", F.col("audit").alias("text"), F.col("shape").alias("role"), F.col("cost").alias("copies"))
    both = heads.unionByName(found.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return (
        both.unionByName(rows, allowMissingColumns=True)
        .select("conv_id", "kind", "turn", "role", "text", "copies", "digest")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
        .drop("digest")
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(i).to_pylist() for i in range(6)])


def repair_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, place, turn, role, text, edit``: the repaired conversations, with places from 0 and ``edit`` K (kept), R
    (role changed) or I (inserted, without turn, empty text). Deleted rows are gone.

    A null role or text is one space, a null turn comes first, a null ``conv_id`` is a conversation like any other, and equal
    rows are copies of which the first may stay. Further columns are not looked at (``copies``, if given, repeats a row). An
    empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, place, out = None, 0, []

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_pylist(out, schema=arrow)
            out.clear()
            return done

        def add(turn, role, text, edit) -> None:
            nonlocal place
            out.append({"conv_id": walk.conv_id, "place": place, "turn": turn, "role": role, "text": text, "edit": edit})
            place += 1

        def finish() -> None:
            if walk is not None:
                for role in walk.inserted():
                    add(None, role, "", "I")

        for conv_id, kind, turn, role, text, copies in _rows(batches):
            if kind == 0:
                finish()
                walk, place = Walk(conv_id), 0
            elif kind == 1:
                walk.audit, walk.shape, walk.cost = text, role, copies
            else:
                for edit, name, own in walk.row(turn, role, copies):
                    add(turn if own else None, name, text if own else "", edit)
            if len(out) >= 4096:
                yield flush()
        finish()
        yield flush()

    turn_type = turns.schema["turn"].dataType.simpleString()
    fields = parts_schema(turns, f"place bigint, turn {turn_type}, role string, text string, edit string")
    arrow = to_arrow_schema(StructType.fromDDL(fields))
    return _walked(turns, turns).mapInArrow(run, fields)


def repair_digest(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row for each conversation of ``ids`` (of ``turns``, if not given): ``conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256``.

    ``gaps`` counts turn numbers missing between the smallest and the largest; the others count rows by their first
    fault, and neighbouring rows whose role initials are not su, ua or au. The hash is that of the repaired rows, ``role:text``
    joined by newlines. Conversations without rows have zeros, an empty audit and the hash of nothing. Odd rows are taken
    as in :func:`repair_turns`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, digest, lines, out = None, None, 0, []

        def line(role: str, text: str) -> None:
            nonlocal lines
            digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
            lines += 1

        def finish() -> None:
            if walk is not None:
                for role in walk.inserted():
                    line(role, "")
                out.append([walk.conv_id, *walk.counts(), walk.audit, digest.hexdigest()])

        def flush() -> pa.RecordBatch:
            columns = [pa.array([row[i] for row in out], type=f.type) for i, f in enumerate(arrow)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        for conv_id, kind, turn, role, text, copies in _rows(batches):
            if kind == 0:
                finish()
                if len(out) >= 1024:
                    yield flush()
                walk, digest, lines = Walk(conv_id), hashlib.sha256(), 0
            elif kind == 1:
                walk.audit, walk.shape, walk.cost = text, role, copies
            else:
                for _, name, own in walk.row(turn, role, copies):
                    line(name, text if own else "")
        finish()
        yield flush()

    longs = ", ".join(f"{n} bigint" for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    fields = parts_schema(turns, f"{longs}, audit string, repaired_sha256 string")
    arrow = to_arrow_schema(StructType.fromDDL(fields))
    return _walked(turns, turns if ids is None else ids).mapInArrow(run, fields)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in by the row's hash, for trying the repair: ``conv_id, turn, role, text, copies``."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return (
        conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name.cast("binary")) % 20).alias("fate"))
        .filter("fate != 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
            F.when(F.col("fate") == 3, 2).otherwise(1).alias("copies"),
        )
    )
