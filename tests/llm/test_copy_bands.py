"""Near copies from buckets of least hashes: no pair is lost to fingerprints, few pairs are compared, tables of the way are deleted."""

import os

import numpy as np
import pytest

pytest.importorskip("lumeset.llm.simhash_tiles")

from lumeset.llm import simhash_tiles as tiles
from lumeset.llm import suffix_repeats
from lumeset.session import shared_folder


def sets_of(texts):
    return [tiles.distinct_shingles(tiles.word_hashes(t)) for t in texts]


def share(a, b):
    both = len(np.intersect1d(a, b))
    return both / (len(a) + len(b) - both)


@pytest.fixture(scope="module")
def far_pairs():
    """Pairs that share 0.8 though their fingerprints lie further apart than COPY_RADIUS or FINE_RADIUS bits."""
    rng = np.random.default_rng(11)
    out = []
    while len(out) < 6:
        words = [f"w{x}" for x in rng.integers(0, 10_000, 60)]
        edited = [*words[:30], "changed", *words[31:]]
        a, b = " ".join(words), " ".join(edited)
        x, y = (tiles.word_hashes(t) for t in (a, b))
        apart = [(int(tiles.majority(f(x)), 16) ^ int(tiles.majority(f(y)), 16)).bit_count() for f in (np.unique, tiles.distinct_shingles)]
        if apart[0] > tiles.COPY_RADIUS or apart[1] > tiles.FINE_RADIUS:
            assert share(*sets_of([a, b])) >= 0.8
            out += [a, b]
    return out


def test_copies_whose_fingerprints_lie_far_apart_are_found(spark, far_pairs):
    docs = spark.createDataFrame(list(enumerate(far_pairs)), "doc_id long, text string")
    assert sorted(r.doc_id for r in tiles.keep_one_copy(docs).collect()) == [0, 2, 4]


def test_bound_drops_no_pair():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 400, np.uint64)
    sets = [np.unique(np.concatenate([base[rng.permutation(400)[: int(rng.integers(330, 400))]], rng.integers(0, 1 << 63, int(rng.integers(0, 60)), np.uint64)])) for _ in range(120)]
    n, odd, group = np.array([len(s) for s in sets]), np.stack([tiles.parities(s).view(np.uint64) for s in sets]), rng.integers(0, 40, 120)
    near = {(i, j) for i in range(120) for j in range(120) if group[i] != group[j] and share(sets[i], sets[j]) >= 0.8}
    assert 100 < len(near) < 120 * 119
    for most, tile, width in ((1000, 7, 11), (1000, 64, 4096)):
        i, j, cut = tiles.open_pairs(n, odd, group, most, 0.8, tile, width)
        assert {(min(p), max(p)) for p in near} <= {(min(p), max(p)) for p in zip(i.tolist(), j.tolist(), strict=True)} and not len(cut)
    i, j, cut = tiles.open_pairs(n, odd, group, 2, 0.8, 7, 11)
    assert len(cut) and np.bincount(i).max() == 2 and all(group[i] != group[j])
    assert tiles.band_keys(sets[0][:0]).size == 0 and tiles.parities(sets[0][:0]).sum() == 0


def test_slices_of_large_buckets_join_the_same(spark):
    rng = np.random.default_rng(8)
    words = [f"w{x}" for x in range(120)]
    texts = []
    for _ in range(80):
        edited = list(words)
        for at in rng.integers(0, 120, int(rng.integers(1, 5))):
            edited[at] = f"x{rng.integers(1_000_000)}"
        texts.append(" ".join(edited))
    sets = sets_of(texts)
    root = list(range(80))
    for i in range(80):
        for j in range(i):
            if share(sets[i], sets[j]) >= 0.8:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert 1 < len(set(root)) < 80
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for bucket_nodes in (16_384, 10):
        rows = tiles.near_copies(docs, most=1, bucket_nodes=bucket_nodes).collect()
        least = {}
        for r in sorted(rows):
            least.setdefault(r.root, r.doc_id)
        assert [least[r.root] for r in sorted(rows)] == root


def test_tables_stored_on_the_way_are_deleted(spark, far_pairs):
    folder = shared_folder(spark).removeprefix("file://") + "/lumeset"
    stored = lambda: {f"{d}/{name}" for d in os.listdir(folder) for name in os.listdir(f"{folder}/{d}")} if os.path.isdir(folder) else set()
    docs = spark.createDataFrame(list(enumerate([*far_pairs, *["a passage of words " * 40 + x for x in "ab"]])), "doc_id long, text string")
    for keep, left in ((tiles.keep_one_copy, ["found"]), (lambda d: suffix_repeats.keep_rest(d), ["changed"])):
        before = stored()
        kept = keep(docs)
        assert sorted(x.split("/")[1] for x in stored() - before) == left
        assert kept.count() > 0


def test_sets_that_share_enough_have_a_key_in_common():
    rng = np.random.default_rng(21)
    for size in [*range(1, 40), 63, 64, 65, 127, 128, 200, 255, 256, 257, 500, 1023, 1024, 3000]:
        for similarity in (0.8, 0.5):
            for _ in range(12):
                new = lambda n: rng.integers(0, 1 << 63, int(n), np.uint64) * np.uint64(2)
                both = new(size)
                differ = int(size * (1 / similarity - 1) + 1e-9)  # as many as leave them alike enough
                one = int(rng.integers(0, differ + 1)) if rng.random() < 0.7 else 0
                x, y = np.unique(np.concatenate([both, new(one)])), np.unique(np.concatenate([both, new(differ - one)]))
                assert share(x, y) >= similarity - 1e-9
                assert len(np.intersect1d(tiles.band_keys(x, similarity), tiles.band_keys(y, similarity))), (size, similarity)
    x, y = (np.unique(new(500)) for _ in range(2))
    assert not len(np.intersect1d(tiles.band_keys(x), tiles.band_keys(y)))


def test_copies_that_agree_in_no_band_of_least_hashes_are_found(spark):
    """A copy edited at a least hash of each of the 32 bands of four, by which candidates were once found."""
    turns, factors = np.random.default_rng(42).integers(0, 1 << 63, (2, 128, 1), np.uint64) * np.uint64(2) + np.uint64(1)
    least = lambda s: ((s[None] ^ turns) * factors).min(axis=1).reshape(32, 4)
    words = [f"w{k}" for k in np.random.default_rng(4).integers(0, 1_000_000, 3000)]
    edited = list(words)
    for _ in range(64):
        x, y = sets_of([" ".join(words), " ".join(edited)])
        same = np.flatnonzero((least(x) == least(y)).all(axis=1))
        if not len(same):
            break
        hashes = tiles.word_hashes(" ".join(words))
        at = 4 * same[0]
        wanted = x[((x ^ turns[at]) * factors[at]).argmin()]
        k = next(k for k in range(len(words) - 4) if tiles.distinct_shingles(hashes[k : k + 5])[0] == wanted)
        edited[k + 2] = f"edited{k}"
    assert not len(same) and share(x, y) >= 0.8
    docs = spark.createDataFrame([(5, " ".join(words)), (6, " ".join(edited)), (7, "another text of seven words it is")], "doc_id long, text string")
    assert sorted(r.doc_id for r in tiles.keep_one_copy(docs).collect()) == [5, 7]
