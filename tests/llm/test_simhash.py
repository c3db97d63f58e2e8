"""Near duplicates by fingerprints against brute force."""

import random

import numpy as np
import pytest
import xxhash

from millrace.llm import simhash
from millrace.llm.simhash import RING, STARTS, chain_keys, chain_masks, links, near_fingerprints, within

SCHEMA = "doc_id bigint, text string"


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    own = list(range(len(rows)))

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                own[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        known = least.setdefault(root(i), key)
        if known is None or (key is not None and key < known):
            least[root(i)] = key
    return sorted(((k, f"{fps[i]:016x}", least[root(i)]) for i, (k, _) in enumerate(rows)), key=repr)


def found(df):
    return sorted(map(tuple, near_fingerprints(df).collect()), key=repr)


def test_near_fingerprints_match_brute_force(near_docs):
    rows = [(r.doc_id, r.text) for r in near_docs.collect()]
    want = brute(rows)
    assert len({c for _, _, c in want}) < len({f for _, f, _ in want}) < len(rows)
    assert found(near_docs) == want


def test_near_fingerprints_at_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert found(odd_docs) == brute(rows)
    assert near_fingerprints(odd_docs).columns == ["doc_id", "fingerprint", "component_id"]
    assert found(no_docs) == []


@pytest.mark.parametrize("length", [2, 3, 4, 5])
def test_pairs_at_the_limit_share_a_key_and_keep_the_budgets(length):
    draw = np.random.default_rng(length)
    a = draw.integers(0, 2**64, 4000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        # Bits close together as well as spread out.
        width = int(draw.choice([6, 13, 30, 64]))
        first = int(draw.integers(0, 64))
        for bit in draw.choice(width, min(4, width), replace=False):
            b[i] ^= np.uint64(1 << ((first + int(bit)) % 64))
    assert (np.bitwise_count(a ^ b) == 4).all()
    (left, begin), (right, _) = chain_keys(a, length), chain_keys(b, length)
    same = left == right
    assert same.any(1).all()
    # From the start of a key that they share, or from another one, every budget holds.
    kept = np.zeros(len(a), bool)
    for column in range(same.shape[1]):
        rows = np.nonzero(same[:, column])[0]
        kept[rows[within(a[rows], b[rows], np.full(len(rows), begin[column]))]] = True
    assert kept.all()


def test_budgets_leave_nothing_beyond_the_limit():
    draw = np.random.default_rng(1)
    a = draw.integers(0, 2**64, 20_000, dtype=np.uint64)
    b = a ^ (np.uint64(1) << draw.integers(0, 64, len(a), dtype=np.uint64))
    for _ in range(5):
        b ^= np.where(draw.random(len(a)) < 0.7, np.uint64(1) << draw.integers(0, 64, len(a), dtype=np.uint64), np.uint64(0))
    for start in range(RING):
        kept = within(a, b, np.full(len(a), start, np.int8))
        assert (np.bitwise_count(a[kept] ^ b[kept]) <= 4).all()


def test_masks():
    assert [len(chain_masks(0, n)) for n in range(1, 6)] == [1, 2, 5, 14, 42]
    for start in range(RING):
        first = (1 << STARTS[start + 1]) - (1 << STARTS[start])
        assert all(mask & first == first for mask in chain_masks(start, RING))


@pytest.mark.parametrize("group, hubs", [(1024, 16), (40, 16), (40, 1)])
def test_links_of_large_families(spark, monkeypatch, group, hubs):
    """Families too large for one piece, with stragglers and strangers in the same groups."""
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "HUBS", hubs)
    draw = random.Random(group + hubs)
    fps = set()
    for _ in range(3):
        centre = draw.getrandbits(64)
        for _ in range(150):
            fps.add(centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 3))))
        far = centre
        for _ in range(12):
            far ^= sum(1 << b for b in draw.sample(range(64), 4))
            fps.add(far)
    # Strangers that share the first two segments with a family, in two clusters of their own.
    for tail in (draw.getrandbits(38), draw.getrandbits(38)):
        for _ in range(60):
            fps.add((centre >> 38 << 38) ^ tail ^ sum(1 << b for b in draw.sample(range(38), draw.randint(0, 2))))
    fps |= {draw.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    pairs = links(spark.createDataFrame([(s,) for s in signed], "fp bigint")).collect()
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in pairs)

    def classes(edges):
        own = {f: f for f in signed}

        def root(x):
            while own[x] != x:
                own[x] = own[own[x]]
                x = own[x]
            return x

        for a, b in edges:
            own[root(a)] = root(b)
        groups = {}
        for f in signed:
            groups.setdefault(root(f), set()).add(f)
        return sorted(map(sorted, groups.values()))

    want = classes((a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    assert classes(pairs) == want
