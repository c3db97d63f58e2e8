"""Repair of conversations against a plain search over edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from millrace.llm import turn_repair
from millrace.llm.turn_repair import damaged, learn_rules, matrices, repair_digest, repair_turns, shape_matrix
from millrace.tables import table

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
CORE = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """rows of (role, must go, cut off) to (cost, audit) and the repaired (role, place or None)."""

    def after(state, c):
        new = state + c
        return new if re.fullmatch(r"s?(ua)*u?", new) else None

    # The state is what the grammar still needs to know: the roles so far, cut to the last pair.
    def short(roles):
        return roles if len(roles) < 3 else ("" if not roles.startswith("s") else "s") + "ua" + roles[roles.rfind("ua") + 2 :]

    @lru_cache(None)
    def best(i, roles, inserted):
        ways = []
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            ways.append((0, "", ()))
        if inserted < 3:
            for role in ("user", "assistant"):
                new = after(roles, role[0])
                if new is not None:
                    ways += [(c + 5, "I" + a, ((role, None),) + t) for c, a, t in best(i, short(new), inserted + 1)]
        if i < len(rows):
            role, gone, cut = rows[i]
            ways += [(c + 2, "D" + a, t) for c, a, t in best(i + 1, roles, 0)]
            if not gone:
                new = after(roles, role[:1])
                if new is not None and role[:1]:
                    ways += [(c + 5 * cut, "K" + a, ((role, i),) + t) for c, a, t in best(i + 1, short(new), 0)]
                for name in ("user", "assistant"):
                    new = after(roles, name[0])
                    if new is not None:
                        ways += [(c + 1 + 5 * cut, "R" + a, ((name, i),) + t) for c, a, t in best(i + 1, short(new), 0)]
        return [min(ways)] if ways else []

    return best(0, "", 0)[0]


def brute(rows):
    """(conv_id, turn, role, text) rows, undamaged, to what the query returns."""
    groups = {}
    for conv_id, turn, role, text in rows:
        keep = groups.setdefault(conv_id, [])
        name = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        fate = zlib.crc32(name.encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        keep += [(turn, role, text)] * (2 if fate == 3 else 1)
    out = []
    for conv_id, turns in groups.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, marked, tally = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in turns:
            core = CORE.findall(text)
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                tally[fault] += 1
            marked.append((role, fault in ("blank", "duplicate"), fault == "truncated"))
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, lines = cheapest(tuple(marked))
        repaired = "\n".join(f"{role}:{'' if i is None else turns[i][2]}" for role, i in lines)
        digest = hashlib.sha256(repaired.encode()).hexdigest()
        out.append((conv_id, gaps, tally["blank"], tally["duplicate"], tally["truncated"], illegal, cost, audit, digest))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, repair_digest(damaged(df), df).collect()), key=repr)


@pytest.fixture(scope="module")
def odd_turns(spark):
    draw = random.Random(4)
    texts = ["Yes.", "No!", "Why?", "cut off", " ", "", None, "Yes. \n\t", "Done.\x0b\x0c\r ", "Oh no!f", "é…", "Same words."]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "u", "Assistant"]
    rows = []
    for conv in [*range(120), None]:
        for turn in range(draw.randint(0, 9)):
            t = draw.choice([turn, turn, turn, None, turn * 3])
            rows.append((conv, t, draw.choice(roles), draw.choice(texts)))
    rows += [(500, None, "user", "a."), (500, None, "user", "a."), (501, 4, "user", "x" * 40_000 + ".")] + [(502, 1, "user", "Hi.")] * 40
    rows += [(600 + i, 0, "system", "s.") for i in range(30)]
    return rows


def test_repair_matches_the_search(spark, odd_turns):
    df = spark.createDataFrame(odd_turns, SCHEMA)
    for i, name in enumerate(["kind", "copies_sum", "chunk", "shape", "cut", "digest", "audit"]):
        df = df.selectExpr("*", f"{i} AS {name}")
    assert found(df) == brute(odd_turns)


def test_repair_of_long_conversations_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "ROWS_PER_CHUNK", 16)
    draw = random.Random(8)
    rows = []
    for conv, n in ((1, 200), (2, 90), (3, 5), (None, 150)):
        for turn in range(n):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "other"])
            rows.append((conv, turn, role, draw.choice(["a.", "b", "c!", " ", f"{turn}.", f"{turn}?", f"{turn}"])))
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_repair_of_the_given_table(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(empty) == [] and repair_turns(empty).collect() == []


def test_repaired_rows_agree_with_the_digest(spark, odd_turns):
    turns = damaged(spark.createDataFrame(odd_turns, SCHEMA))
    lines = {}
    for r in sorted(repair_turns(turns).collect(), key=lambda r: r.place):
        assert (r.edit == "I") == (r.turn is None and r.text == "") or r.turn is None
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in repair_digest(turns).collect():
        own = lines.get(r.conv_id, [])
        assert hashlib.sha256("\n".join(own).encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in own))


def test_rules_change_nothing(spark):
    draw = random.Random(2)
    shapes = ["".join(draw.choice("uaUA5uas1o") for _ in range(draw.randint(0, 40))) for _ in range(60)] + ["ua" * 300, "5" * 99]
    rules = learn_rules(spark.createDataFrame([(s,) for s in shapes], "shape string"))
    assert len(rules) > 20 and any(ord(c) > 255 for r in rules for c in r)

    def spelled(matrix):
        return [[None if e is None else (e[0], e[1].text) for e in row] for row in matrix]

    for shape in shapes:
        assert spelled(shape_matrix(shape, rules, matrices(rules), 4)) == spelled(shape_matrix(shape, [], matrices([]), 4))
