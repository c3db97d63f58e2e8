"""The similarity join, decontamination and packing against brute force."""

import random

from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
from oracle import compare, connect
from millrace.llm.batches import WordHashes, word_hashes
from millrace.llm.decontaminate import CONTAMINATED_SQL, contaminated, sketch_length, without_leaks
from millrace.llm.graph import components
from millrace.llm.packing import _bits, best_fit, pack
from millrace.llm.signature_join import (
    Tree,
    fingerprints,
    keys_of_sets,
    leaf_pairs,
    near_clusters,
    one_of_each,
    part_keys,
    search,
    shingle_sets,
    shingles,
    similar_documents,
    spare,
)
from millrace.tables import table

SF_DIR = "/root/testdata/sf0.001"


def grams(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_components(rows):
    """(id, text) rows to a list of (id, set size, component)."""
    sets = [grams(t) for _, t in rows]
    own = list(range(len(rows)))

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                own[root(i)] = root(j)
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        least[root(i)].append(key)
    name = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return sorted(((k, len(sets[i]), name[root(i)] if sets[i] else k) for i, (k, _) in enumerate(rows)), key=repr)


def test_similar_documents_match_brute_force(near_docs):
    rows = [(r.doc_id, r.text) for r in near_docs.collect()]
    want = brute_components(rows)
    assert len({c for _, _, c in want}) < len(rows)
    assert sorted(map(tuple, similar_documents(near_docs).collect()), key=repr) == want


def test_similar_documents_at_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, similar_documents(odd_docs).collect()), key=repr) == brute_components(rows)
    assert similar_documents(no_docs).collect() == []


def test_similar_sets_share_a_key():
    draw = np.random.default_rng(3)
    for _ in range(600):
        n = int(draw.integers(1, 400))
        common = draw.integers(0, 2**63, n).astype(np.uint64)
        left = int(draw.integers(0, n // 4 + 1))
        right = int(draw.integers(0, n // 4 + 1))
        a = np.unique(np.concatenate((common, draw.integers(0, 2**63, left).astype(np.uint64))))
        b = np.unique(np.concatenate((common, draw.integers(0, 2**63, right).astype(np.uint64))))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            shared = Counter((np.intersect1d(part_keys(a), part_keys(b)) & np.uint64(63)).tolist())
            assert any(k >= 32 or c >= 1 + spare(2**k) for k, c in shared.items())


def odd_texts():
    draw = random.Random(11)
    word = lambda: bytes(draw.choice(b"abcXYZ\xc3\xa9\x00") for _ in range(draw.choice((1, 2, 7, 8, 9, 16, 63, 64, 65, 200))))
    gaps = [bytes([c]) for c in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)] + [b"  \n"]
    texts = [b"", b" \t", b"a", b"a\x00 a a\x00\x00", b"one two three four", b"Aa BB aa bb cc", b"a b c d e " * 9]
    return texts + [b"".join(word() + draw.choice(gaps) for _ in range(draw.randint(0, 30))) for _ in range(120)]


def test_words_of_many_texts_are_hashed_alike():
    texts = odd_texts()
    hashes, counts = word_hashes(texts)
    words = [t.lower().split() for t in texts]
    assert counts.tolist() == [len(w) for w in words]
    pairs = set(zip([w for text in words for w in text], hashes.tolist()))
    assert len({w for w, _ in pairs}) == len({h for _, h in pairs}) == len(pairs)
    assert [len(x) for x in word_hashes([])] == [0, 0]


def test_sets_of_many_texts_are_those_of_each_text():
    texts = odd_texts()
    grams, sizes = shingle_sets(texts)
    words = [t.lower().split() for t in texts]
    want = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    assert sizes.tolist() == [len(x) for x in want]
    each = [shingle_sets([t])[0] for t in texts]
    assert np.array_equal(np.concatenate(each), grams) and all(np.array_equal(x, np.unique(x)) for x in each)
    names = fingerprints(grams, sizes).tolist()
    assert names == [fingerprints(x, np.array([len(x)]))[0] for x in each]
    assert len(set(names)) == len({frozenset(x) for x in want})
    keys, owners = keys_of_sets(grams, sizes)
    for i, one in enumerate(each):
        assert sorted(keys[owners == i].tolist()) == sorted(part_keys(one).tolist())


def test_repeated_rows_put_together_come_back(spark):
    rows = [(1, "a b c d e f g h"), (None, "a b c d e f g h"), (2, ""), (2, None), (3, "x y")]
    rows = rows * 7 + [rows[0]] * 500
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(map(tuple, similar_documents(docs).collect()), key=repr) == brute_components(rows)
    named = spark.createDataFrame([(f"d{k}", t) for k, t in rows], "doc_id string, text string")
    assert {r.doc_id: r.component_id for r in similar_documents(named).collect()} == {"d1": "d1", "dNone": "d1", "d2": "d2", "d3": "d3"}


def random_sets(families, copies, edits, seed):
    draw = random.Random(seed)
    hashes, out = WordHashes(), []
    for family in range(families):
        base = [f"w{family}x{k}" for k in range(draw.randint(30, 90))]
        for _ in range(copies):
            words = list(base)
            for _ in range(draw.randint(0, edits)):
                words[draw.randrange(len(words))] = f"v{draw.randrange(10**6)}"
            out.append(shingles(" ".join(words).encode(), hashes))
    return out


def groups(n, links):
    own = list(range(n))
    for a, b in links:
        a, b = own[a], own[b]
        own = [min(a, b) if x in (a, b) else x for x in own]
    return own


def test_trees_connect_all_that_is_similar():
    sets = random_sets(8, 60, 4, 2)
    content = [set(g.tolist()) for g in sets]
    similar = [
        (a, b) for a in range(len(sets)) for b in range(a) if 100 * len(content[a] & content[b]) >= 80 * len(content[a] | content[b])
    ]
    want = groups(len(sets), similar)
    member = lambda i, c=None: {"set": i, "component": i if c is None else c, "grams": sets[i].tobytes()}
    whole = Tree([member(i) for i in range(len(sets))])
    found = search(whole, whole)
    assert {tuple(sorted(x)) for x in found} <= {tuple(sorted(x)) for x in similar}
    assert groups(len(sets), found) == want and len(found) == len(sets) - len(set(want))
    # In two blocks: links within each, then those between them; what is known to be connected is not told again.
    halves = [[i for i in range(len(sets)) if i % 2 == h] for h in (0, 1)]
    trees = [Tree([member(i) for i in h]) for h in halves]
    inner = search(trees[0], trees[0]) + search(trees[1], trees[1])
    known = groups(len(sets), inner)
    x, y = (Tree([member(i, known[i]) for i in h]) for h in halves)
    between = search(x, y)
    assert groups(len(sets), inner + between) == want and len(between) == len(set(known)) - len(set(want))
    # Unlike families are told apart above the leaves.
    assert len(list(leaf_pairs(whole, whole))) < len(whole.levels[0][1]) * (len(whole.levels[0][1]) + 1) / 2


def test_links_of_a_large_group_in_many_blocks(spark, monkeypatch):
    import millrace.llm.signature_join as module

    monkeypatch.setattr(module, "BLOCK", 10)
    draw = random.Random(4)
    rows = []
    base = [f"w{k}" for k in range(80)]
    for i in range(150):
        words = list(base)
        for _ in range(draw.randint(0, 4)):
            words[draw.randrange(80)] = f"v{draw.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, similar_documents(docs).collect()), key=repr) == brute_components(rows)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_one_of_each_group_stays(near_docs, odd_docs):
    for docs in (near_docs, odd_docs):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        want = Counter(c for _, n, c in brute_components(rows) if n)
        kept = one_of_each(docs)
        assert kept.columns == docs.columns
        got = [r.doc_id for r in kept.select("doc_id", "text").collect() if grams(r.text)]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_contaminated_matches_sql(spark):
    got = contaminated(table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "benchmark"))
    assert compare(connect(SF_DIR), CONTAMINATED_SQL, got) is None


def test_contaminated_by_index_and_by_join_at_odd_rows(spark, odd_docs, no_docs):
    text = odd_docs.filter("doc_id = 7").first().text.split()
    items = [
        (1, " ".join(text[5000:5030])),
        (1, " ".join(text[5000:5030])),
        (2, " ".join(text[100:130] + ["unseen"] * 3)),
        (3, "one"),
        (4, "ONE TWO"),
        (5, None),
        (6, ""),
        (None, " ".join(text[70:90])),
        (8, "nowhere to be found in any of them"),
        (9, " ".join(text[40_000:40_003])),
        (10, " ".join(text[50_000:50_004])),
    ]
    bench = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS item", "2 AS place", "3 AS grams")
    want = []
    for d in odd_docs.select("doc_id", "text").collect():
        for key, words in set(items):
            g = grams(words)
            # An item of fewer words than a shingle is looked for at its own width.
            own, size = (d.text or "").encode().lower().split(), len((words or "").split())
            n = len(g & (grams(d.text) if size >= 5 else {tuple(own[k : k + size]) for k in range(len(own) - size + 1)}))
            if g and n >= 0.8 * len(g):
                want.append((d.doc_id, key, n, len(g), n / len(g)))
    assert len(want) > 4
    for limit in (10**6, 0):
        got = contaminated(odd_docs, bench, sent_shingles=limit)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
        assert contaminated(no_docs, bench, sent_shingles=limit).collect() == []
        assert contaminated(odd_docs, bench.limit(0), sent_shingles=limit).collect() == []
        clean = without_leaks(odd_docs, bench, sent_shingles=limit)
        assert clean.columns == odd_docs.columns
        assert clean.count() == odd_docs.count() - len([1 for d in odd_docs.select("doc_id").collect() if d.doc_id in {w[0] for w in want}])


def test_short_items_are_found_inside_texts(spark):
    texts = ["What is the Capital of\nFrance today then", "capital of\tFrance", "the capital is of France", "of france", "a b c d e f", None, "capital of francec", "x capital of France"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "capital of france"), (2, "e"), (3, "B c D e"), (4, "what is the capital of france today then")], "item_id bigint, text string")
    want = {(0, 1), (1, 1), (7, 1), (4, 2), (4, 3), (0, 4)}
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("benchmark", bench.toPandas())
    for limit in (10**6, 0):
        got = contaminated(docs, bench, sent_shingles=limit)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want
        assert compare(con, CONTAMINATED_SQL, got) is None
    assert sorted(r.doc_id for r in without_leaks(docs, bench).collect()) == [2, 3, 5, 6]


def test_sketch_length():
    assert [sketch_length(n) for n in (1, 4, 5, 10, 50)] == [1, 1, 2, 3, 11]


def naive_best_fit(sizes, sources, clusters, capacity):
    bins, out = [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        fits = [b for b in bins if b["room"] >= size and not b["sources"] & source and not b["clusters"] & cluster]
        if fits:
            b = min(fits, key=lambda x: x["room"])
        else:
            b = {"room": capacity, "sources": 0, "clusters": 0, "name": len(bins)}
            bins.append(b)
        out.append((b["room"] - size, capacity - b["room"]))
        b["room"] -= size
        b["sources"] |= source
        b["clusters"] |= cluster
    return out, len(bins)


def test_best_fit_takes_the_tightest_compatible_bin():
    draw = np.random.default_rng(1)
    for capacity, n in ((50, 400), (200, 900)):
        sizes = draw.integers(1, capacity + 1, n)
        sources = np.uint64(1) << draw.choice(12, n, p=[0.34] + [0.06] * 11).astype(np.uint64)
        clusters = np.uint64(1) << draw.integers(0, 64, n).astype(np.uint64)
        bins, offsets = best_fit(sizes, sources, clusters, capacity)
        want, made = naive_best_fit(sizes.tolist(), map(int, sources), map(int, clusters), capacity)
        # Ties between equally tight bins may fall either way, so room and offset are compared.
        if n == 400:
            assert abs(len(set(bins)) - made) <= 0.02 * made
        for b in set(bins):
            at = np.flatnonzero(bins == b)
            assert sizes[at].sum() <= capacity
            assert len(set(sources[at])) == len(set(clusters[at])) == len(at)
            assert sorted(offsets[at]) == [0, *np.cumsum(sizes[at][np.argsort(offsets[at])])[:-1]]
        assert want[0] == (capacity - sizes[0], 0)


def test_many_sources_share_no_conflict():
    """Tightest compatible bins by the ids themselves, with more sources and clusters than bits."""
    draw = np.random.default_rng(2)
    n, capacity = 600, 300
    sizes = np.sort(draw.integers(1, 60, n))[::-1]
    sources, clusters = draw.integers(0, 150, n), draw.integers(0, 260, n)
    bits = _bits(pd.Series(sources), 32), _bits(pd.Series(clusters), 32)
    bins, _ = best_fit(sizes, *bits, capacity, sources, clusters, 32)
    want, made = naive_best_fit(sizes.tolist(), [1 << int(x) for x in sources], [1 << int(x) for x in clusters], capacity)
    assert abs(len(set(bins)) - made) <= 0.02 * made
    for b in set(bins):
        at = np.flatnonzero(bins == b)
        assert sizes[at].sum() <= capacity and len(set(sources[at])) == len(set(clusters[at])) == len(at)
    once = pd.Series(np.arange(200))
    bins, offsets = best_fit(np.ones(200, np.int64), _bits(once, 32), _bits(once, 32), 1000, np.arange(200), np.arange(200), 32)
    assert set(bins) == {0} and sorted(offsets) == list(range(200))
    # Two of each source, so that no bit is left out.
    twice = pd.Series(np.repeat(np.arange(200), 2))
    bins, _ = best_fit(np.ones(400, np.int64), _bits(twice, 32), _bits(twice, 32), 1000, twice.to_numpy(), twice.to_numpy(), 32)
    assert Counter(bins) == {0: 200, 1: 200}


def test_near_copies_share_no_bin(spark, odd_docs):
    draw = random.Random(8)
    sentence = lambda: [f"w{draw.randrange(10**9)}" for _ in range(60)]
    base = sentence()
    rows = [(i, " ".join([*base[:10], f"changed{i}", *base[11:]]), "en", f"s{i}", 0) for i in range(4)]
    rows += [(10 + i, " ".join(sentence()), "en", f"t{i}", 0) for i in range(4)]
    docs = spark.createDataFrame(rows, odd_docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    bins = {r.doc_id: r.bin_id for r in pack(docs, capacity=1000, clusters=near_clusters(docs)).collect()}
    assert len({bins[i] for i in range(4)}) == 4 and len({bins[10 + i] for i in range(4)}) == 1
    # Repeated rows, null ids and texts without words.
    some = odd_docs.select("doc_id", "text", "source")
    assert len(pack(some, capacity=100_000, clusters=near_clusters(some)).collect()) == odd_docs.count()


def test_pack_keeps_every_word(odd_docs, no_docs):
    rows = pack(odd_docs, capacity=100, shard=4).collect()
    words = Counter()
    for d in odd_docs.select("doc_id", "text").collect():
        words[d.doc_id] += len((d.text or "").encode().split())
    packed, bins = Counter(), defaultdict(list)
    for r in rows:
        packed[r.doc_id] += r.n_words
        if r.bin_id is None:
            assert r.n_words == 0 and r.bin_offset is None
        else:
            bins[r.bin_id].append(r)
    assert packed == words
    source = {r.doc_id: r.source for r in odd_docs.select("doc_id", "source").collect()}
    for held in bins.values():
        held.sort(key=lambda r: r.bin_offset)
        assert sum(r.n_words for r in held) <= 100
        assert len({source[r.doc_id] for r in held}) == len(held)
        assert all(a.bin_offset + a.n_words == b.bin_offset for a, b in zip(held, held[1:]))
    assert pack(no_docs).collect() == []
