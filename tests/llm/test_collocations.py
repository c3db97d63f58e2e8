"""Phrases against brute force and SQL."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from oracle import compare, connect

from millrace.llm import collocations as module
from millrace.llm.collocations import COLLOCATIONS_SQL, collocations, combined, subtree_counts, tokens
from millrace.tables import table

SCHEMA = "doc_id bigint, text string, lang string"


def brute(rows, least, top):
    grams, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, 5):
                    if i + k <= len(words):
                        grams.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in grams.items():
        found = []
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in often.items():
            inside = any(
                100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in often.items()
                if len(q) > len(p)
            )
            if not inside:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(6)
    words = ["the", "of", "New", "york", "City", "hall", "é", "a|b", "x" * 300, "ſ", "end", "\x85", "\x00"]
    rows = []
    for _ in range(400):
        out = []
        for _ in range(draw.randint(0, 30)):
            out.append(draw.choice([draw.choice(words), "new york", "New York city hall", "of the", "w%d" % draw.randrange(200)]))
        text = "".join(w + draw.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!", "\x0b"]) for w in out)
        rows.append((text, draw.choice(["en", "en", "en", "de", None, ""])))
    rows += [(None, "en"), ("", None), (" . ;\n", "fr"), ("ja ja ja ja ja " * 9_000, "long"), ("x" * 70_000, "en")] + [("Same old story here", "en")] * 50
    return rows


def frame(spark, rows):
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], SCHEMA)
    for i, name in enumerate(["n", "a", "h1", "part", "score", "word", "rank", "phrase"]):
        df = df.selectExpr("*", f"{i} AS {name}")
    return df


@pytest.mark.parametrize("least, top, budget", [(30, 2000, 2_000_000), (5, 2000, 300), (3, 20, 40)])
def test_collocations_match_brute_force(spark, texts, least, top, budget):
    want = brute(texts, least, top)
    assert len(want) > 10
    got = collocations(frame(spark, texts), least=least, top=top, budget=budget)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == want


def test_collocations_with_a_small_bitmap(spark, texts, monkeypatch):
    """Bits shared with other words change nothing."""
    monkeypatch.setattr(module, "MOST_BITS", 1 << 17)
    monkeypatch.setattr(module, "BITS_EACH", 0)
    monkeypatch.setattr(module, "_HELD", 50)
    got = collocations(frame(spark, texts), least=4)
    assert sorted(map(tuple, got.collect())) == brute(texts, 4, 2000)


def test_collocations_of_nothing(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations(spark.createDataFrame([(1, None, None), (2, " .", "en")], SCHEMA)).collect() == []


def test_a_new_seed_where_words_collide(spark, texts, monkeypatch):
    real = module.word_hash
    monkeypatch.setattr(module, "word_hash", lambda lang, word, seed: real(lang, word, seed) if seed else 7)
    assert sorted(map(tuple, collocations(frame(spark, texts), least=30).collect())) == brute(texts, 30, 2000)


def test_counts_of_subtrees():
    draw = np.random.default_rng(3)
    rows = [tuple(int(x) for x in draw.integers(1, 4, 3)) + (int(draw.integers(0, 3)),) for _ in range(500)]
    columns = [np.array(c, np.uint64) for c in zip(*rows)]
    distinct, n = combined(columns)
    order = np.lexsort(distinct[::-1])
    nodes, total = subtree_counts([c[order] for c in distinct], n[order], 5)
    want = Counter(r for r in rows if r[3]) + Counter((*r[:3], 0) for r in rows)
    assert dict(zip(zip(*[c.tolist() for c in nodes]), total.tolist())) == {k: v for k, v in want.items() if v >= 5}


def test_words_and_pieces():
    assert tokens("A b\tC.d,,É!\r\nz\x1c y".encode()) == [b"a", b"b", b"c", b".", b"d", b".", b".", "É".encode(), b".", b".", b".", b"z\x1c", b"y"]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_collocations_match_sql(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    assert compare(connect(sf_dir), COLLOCATIONS_SQL, collocations(table(spark, sf_dir, "documents"))) is None
