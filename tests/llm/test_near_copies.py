"""Near copies by five-word shingles, candidates by two fingerprints."""

import collections

import numpy as np
import pytest

pytest.importorskip("lumeset.llm.simhash_tiles")

from lumeset.llm import simhash_tiles as tiles


def words_of(text):
    return (text or "").encode().lower().split()


def shingle_set(text):
    w = words_of(text)
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 0))} or ({tuple(w)} if w else set())


def share(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def prints(text):
    h = tiles.word_hashes(text)
    return int(tiles.majority(np.unique(h)), 16), int(tiles.majority(tiles.distinct_shingles(h)), 16)


def groups(texts, linked):
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and linked(i, j):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), int(rng.integers(3, 9)))) for _ in range(2000)]
    prose = lambda n: list(rng.choice(vocabulary, n))
    out = [prose(int(rng.integers(60, 400))) for _ in range(60)]
    for base, copies, most in ((0, 40, 6), (1, 25, 14), (2, 6, 2)):  # the second group has copies less alike than the bound
        for _ in range(copies):
            edited = list(out[base])
            for at in rng.integers(0, len(edited), int(rng.integers(1, most))):
                edited[at] = rng.choice(vocabulary)
            out.append(edited)
    out = [" ".join(w) for w in out]
    return [*out, out[3], out[3].upper(), out[4].replace(" ", "\n"), None, "", " \t", "one two", "one two", "one two three", "ä ö ü ß é", "word " * 5000, "word " * 30]


def test_near_copies_against_brute_force(spark, texts):
    fps = [prints(t) for t in texts]
    near = lambda i, j: (fps[i][0] ^ fps[j][0]).bit_count() <= tiles.COPY_RADIUS and (fps[i][1] ^ fps[j][1]).bit_count() <= tiles.FINE_RADIUS
    want = groups(texts, lambda i, j: near(i, j) and share(texts[i], texts[j]) >= 0.8)
    every = groups(texts, lambda i, j: share(texts[i], texts[j]) >= 0.8)
    assert len(set(want)) - len(set(every)) <= 1  # what the radii miss
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    for most in (1, 4):  # few at first: several rounds
        rows = tiles.near_copies(docs, most=most).collect()
        of = {r.doc_id: r.root for r in rows}
        assert len(rows) == len(texts)
        found = [[i for i in of if of[i] == r] for r in sorted(set(of.values()))]
        assert sorted(map(sorted, found)) == sorted([i for i in range(len(texts)) if want[i] == r] for r in set(want))
    kept = tiles.keep_one_copy(docs)
    assert kept.columns == ["doc_id", "text"] and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_slices_of_large_buckets_find_the_same(spark, texts):
    fps = sorted({prints(t) for t in texts})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(a), signed(b)) for a, b in fps], "words long, fine long").selectExpr("*", "concat_ws('/', words, fine) AS grp")
    pairs = []
    for bucket in (16_384, 6):
        buckets = tiles.copy_buckets(nodes, bucket).join(nodes, ["words", "fine"])
        pairs.append({(r.a, r.b) for r in tiles.candidate_pairs(buckets, 1000).where("b is not null").collect()})
    name = lambda p: f"{p[0]:016x}{p[1]:016x}"
    want = {(name(p), name(q)) for i, q in enumerate(fps) for p in fps[:i] if (p[0] ^ q[0]).bit_count() <= tiles.COPY_RADIUS and (p[1] ^ q[1]).bit_count() <= tiles.FINE_RADIUS}
    assert pairs[0] == pairs[1] == want and want


@pytest.mark.parametrize("n, most, tile", [(1, 2, 4), (40, 2, 8), (300, 3, 64), (700, 5, 256)])
def test_nearest_others(n, most, tile):
    rng = np.random.default_rng(n)
    words, fine = (rng.integers(0, 1 << 16, n).astype(np.uint64) for _ in range(2))
    group = rng.integers(0, n, n)
    i, j, cut = tiles.nearest_others(words, fine, group, most, tile)
    x, y = (np.bitwise_count(v[:, None] ^ v[None]).astype(int) for v in (words, fine))
    near = (x <= tiles.COPY_RADIUS) & (y <= tiles.FINE_RADIUS) & (group[:, None] != group[None])
    d = np.where(near, x + y, 1000)
    for r in range(n):
        got = sorted(d[r, j[i == r]])
        assert got == sorted(d[r])[: min(most, int(near[r].sum()))] and (r in cut) == (near[r].sum() > most)


def test_odd_rows_of_near_copies(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, fp long")
    assert tiles.keep_one_copy(empty).count() == 0 and tiles.keep_one_copy(empty).columns == empty.columns
    a, b = "one two three four five six", "red green blue black white grey"
    rows = [(None, a, 1), (None, b, 1), (None, b, 2), (7, "x y z", 1), (7, "x y z", 1), (7, a, 1), (8, None, 1), (9, "", 1)]
    kept = tiles.keep_one_copy(spark.createDataFrame(rows, "doc_id long, text string, root long")).collect()
    assert collections.Counter((r.doc_id, r.text) for r in kept) == collections.Counter({(7, a): 1, (None, b): 1, (7, "x y z"): 1, (8, None): 1})
