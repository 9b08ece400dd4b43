"""SimHash near-duplicates by tiled exact comparison.

A document's fingerprint is taken from the hashes of its word shingles. Documents with equal fingerprints are one
node. Two fingerprints within r bits agree in at least b - r of any b blocks of bits, so each node is sent to
one bucket for every choice of b - r blocks; b follows the number of nodes, so buckets stay small at any size. A bucket is
compared in tiles: nodes are sorted by their bit counts, tiles are compared with exclusive-or and bit counts in numpy, and tile
pairs whose bit counts differ by more than the radius are skipped. What a bucket returns is a forest of its links, at most one row per
node, never its pairs; the forests are joined to components by star contraction.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructType

from lumeset.llm.common import distilled, materialise
from lumeset.llm.graph import components

SHINGLE, RADIUS, SEED = 3, 2, 42
TILE = 1024
#: A bucket of more nodes is split by further blocks before it is compared.
BUCKET_NODES = 16_384
#: Near copies: five-word shingles, the share of them, bits in which fingerprints of words and of shingles may differ, candidates of a text met first.
COPY_SHINGLE, COPY_SIMILARITY, COPY_RADIUS, FINE_RADIUS, NEAREST = 5, 0.8, 8, 18, 4
#: Their candidates: parts of a set for each that may differ, parts at least and at most, and classes of shingles whose parities bound a difference.
PARTS, LEAST_PARTS, LARGEST_PARTS, ODD_BITS = 1.25, 16, 1 << 40, 1024


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text, as a signed integer: A-Z in lower case, words between ASCII white space, XXH64 of each shingle."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: both work on ASCII only
    if not words:
        return 0
    one = xxhash.xxh64_intdigest
    shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else (b" ".join(words),)
    hashes = np.fromiter((one(x, SEED) for x in shingles), np.uint64, max(1, len(words) - shingle + 1))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[k : k + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


@F.pandas_udf(LongType())
def fingerprint_of(texts: pd.Series) -> pd.Series:
    """Fingerprint of each text; null and empty texts have 0."""
    return pd.Series(np.fromiter(map(fingerprint, texts), np.int64, len(texts)))


def blocks_for(nodes: int, radius: int = RADIUS) -> int:
    """Number of blocks at which a bucket of evenly spread nodes has about 16 or less: b - r of b blocks hold 64 (b - r) / b bits."""
    b = radius + 1
    while b < 8 and 64 * (b - radius) // b < np.log2(max(nodes, 2)) - 4:
        b += 1
    return b


def block_masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """A 64-bit mask for every choice of blocks - radius blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    return [sum(block[k] for k in chosen) for chosen in itertools.combinations(range(blocks), blocks - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(nodes: np.ndarray, radius: int = RADIUS, tile: int = TILE) -> np.ndarray:
    """Links (i, j) of a forest over all pairs of nodes within the radius, by tiles of nodes sorted by bit count."""
    bits = np.bitwise_count(nodes)
    order = np.argsort(bits, kind="stable")
    nodes, bits = nodes[order], bits[order].astype(np.int64)
    group = np.arange(len(nodes))  # rows of one number are linked already
    links = []
    for a in range(0, len(nodes), tile):
        for b in range(a, len(nodes), tile):
            if bits[b] - bits[min(a + tile, len(nodes)) - 1] > radius:
                break  # all later tiles have larger bit counts
            near = np.bitwise_count(nodes[a : a + tile, None] ^ nodes[None, b : b + tile]) <= radius
            near = np.triu(near, 1) if a == b else near
            for i in np.flatnonzero(near.any(axis=1)):
                others = b + np.flatnonzero(near[i])
                # one link to each group that the row is near to and not in
                apart, first = np.unique(group[others], return_index=True)
                new = apart != group[a + i]
                if new.any():
                    links += [(order[a + i], order[j]) for j in others[first[new]]]
                    group[np.isin(group, apart)] = group[a + i]
    return np.asarray(links, np.int64).reshape(-1, 2)


def links_within(nodes: DataFrame, radius: int = RADIUS, bucket_nodes: int = BUCKET_NODES) -> DataFrame:
    """Links (a, b) that connect every two of the distinct ``fp`` in nodes within the radius, directly or by way of others."""
    n = nodes.count()
    blocks = blocks_for(n, radius)
    done = []
    waiting = nodes.select("fp", F.lit(0).cast("long").alias("mask"), F.lit(0).cast("long").alias("key"))
    while True:
        masks = [signed(m) for m in block_masks(blocks, radius)]
        mask = F.explode(F.array(*map(F.lit, masks))).alias("more")
        dealt = waiting.select("fp", "mask", mask).select("fp", F.col("mask").bitwiseOR(F.col("more")).alias("mask")).distinct()
        dealt = dealt.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        sizes = dealt.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        sized = materialise(dealt.join(sizes, ["mask", "key"]), "buckets")
        done.append(compare_buckets(sized.where(F.col("n") <= bucket_nodes), radius))
        large = sized.where(F.col("n") > bucket_nodes)
        if large.isEmpty() or blocks >= 16:
            done.append(compare_tiles(large, radius))
            break
        waiting, blocks = large.select("fp", "mask", "key"), blocks * 2
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out


def compare_buckets(sized: DataFrame, radius: int) -> DataFrame:
    """Forests of buckets (mask, key, fp) that fit a task."""

    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        fp = bucket["fp"].to_numpy()
        links = forest(fp.view(np.uint64), radius)
        return pd.DataFrame({"a": fp[links[:, 0]], "b": fp[links[:, 1]]})

    def pairs_or_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come sorted by bucket; a bucket may be cut by the end of a batch
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            change = (b["mask"].to_numpy()[1:] != b["mask"].to_numpy()[:-1]) | (b["key"].to_numpy()[1:] != b["key"].to_numpy()[:-1])
            starts = np.concatenate([[0], np.flatnonzero(change) + 1])
            rest = b.iloc[starts[-1] :]
            yield from whole(b.iloc[: starts[-1]], starts)
        if rest is not None and len(rest):
            yield run(rest)

    def whole(b: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        if not len(b):
            return
        fp = b["fp"].to_numpy()
        lengths = np.diff(starts)
        two = starts[:-1][lengths == 2]  # most buckets: compared in one go
        x, y = fp[two], fp[two + 1]
        near = np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= radius
        yield pd.DataFrame({"a": x[near], "b": y[near]})
        for s, n in zip(starts[:-1][lengths > 2], lengths[lengths > 2], strict=True):
            links = forest(fp[s : s + n].view(np.uint64), radius)
            if len(links):
                yield pd.DataFrame({"a": fp[s + links[:, 0]], "b": fp[s + links[:, 1]]})

    return sized.select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInPandas(pairs_or_groups, "a long, b long")


def compare_tiles(large: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Forests of buckets that no further block splits, a task for each pair of tiles instead of one for the bucket."""
    bits = F.bit_count("fp")
    # tiles are runs of one bit count and one hash slice, so their number of rows is bounded and no bucket is ranked as a whole
    slices = F.greatest(F.lit(1), F.ceil(F.col("n") / tile)).cast("int")
    dealt = large.select("mask", "key", "fp", bits.alias("bits"), F.pmod(F.xxhash64("fp"), slices).cast("int").alias("s"), slices.alias("slices"))
    # a pair of tiles is named by its lower bit count, the higher one, and both slices in order
    others = F.explode(F.flatten(F.transform(F.sequence(F.lit(-radius), F.lit(radius)), lambda d: F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda t: F.struct((F.col("bits") + d).alias("bits"), t.alias("s"))))))
    pairs = dealt.select("mask", "key", "fp", F.struct("bits", "s").alias("own"), others.alias("other"))
    pairs = pairs.select("mask", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")

    def run(b: pd.DataFrame) -> pd.DataFrame:
        fp = np.unique(b["fp"].to_numpy())
        links = forest(fp.view(np.uint64), radius)
        return pd.DataFrame({"a": fp[links[:, 0]], "b": fp[links[:, 1]]})

    return pairs.groupBy("mask", "key", "low", "high").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable) and root (smallest fp reachable) of docs (doc_id, text).

    Null and empty texts have fingerprint 0 and are linked like any others. Rows of one doc_id are documents of their
    own that share a component only if their fingerprints do; a null doc_id is never a component_id unless it stands alone. Components that
    share a smallest doc_id, or have none, differ in their root. An empty table gives an empty result.
    """
    marked = materialise(docs.select(F.col("doc_id").cast("long"), fingerprint_of("text").alias("fp")), "fingerprints")
    nodes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    tree = components(links_within(nodes.select("fp"), radius))
    # components are over fingerprints; their ids are the smallest doc_id in each
    rooted = nodes.join(tree, nodes["fp"] == tree["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialise(rooted.join(least, "root").select("fp", "component_id", "root"), "components")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id", "root")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each component, that with the smallest doc_id (a null one only if there is no other), with all its columns; of repeated rows of this doc_id, one."""
    return least_of_each(docs, materialise(near_duplicates(docs.select("doc_id", "text"), radius), "found"), fingerprint_of("text"))


def least_of_each(docs: DataFrame, found: DataFrame, mark: Column) -> DataFrame:
    """The rows of docs that stand for the components of found (doc_id, fp, root); mark computes fp from a row of docs."""
    least = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("least"))
    kept = least.select(F.col("least.doc_id").alias("_id"), F.col("least.fp").alias("_fp"))
    if found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["_id"]), "left_semi")
    # some doc_id stands in several rows: the fingerprint, which is in one component only, tells which of them is meant
    marked = docs.select(F.col("doc_id").cast("long").alias("_own"), mark.alias("_own_fp"), F.struct(*docs.columns).alias("doc"))
    return marked.join(kept, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_own_fp") == F.col("_fp"))).dropDuplicates(["_own_fp"]).select("doc.*")


# --- near copies by the words of a text ---


def word_hashes(text: str | None) -> np.ndarray:
    """XXH64 of each word, A-Z in lower case."""
    import xxhash

    words = (text or "").encode().lower().split()
    return np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))


def distinct_shingles(hashes: np.ndarray, shingle: int = COPY_SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of words given by theirs: a polynomial in the words' hashes, mixed; fewer words are one shingle, no words none."""
    runs = min(shingle, len(hashes))
    if not runs:
        return hashes
    mixed = np.zeros(len(hashes) - runs + 1, np.uint64)
    for k in range(runs):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(mixed)]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return np.unique(mixed ^ (mixed >> np.uint64(31)))


def majority(hashes: np.ndarray) -> str:
    """16 hexadecimal digits of the bits set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[k : k + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes().hex()


SKETCH = StructType().add("fp", StringType()).add("n", IntegerType()).add("odd", BinaryType())


@F.pandas_udf(SKETCH)
def sketch_of(texts: pd.Series) -> pd.DataFrame:
    """Of the set of five-word shingles of each text: its name (128 bits), its size and its parities by class."""
    import xxhash

    rows = []
    for text in texts:
        s = distinct_shingles(word_hashes(text))
        rows.append((xxhash.xxh3_128_hexdigest(s.tobytes()), len(s), parities(s).tobytes()))
    return pd.DataFrame(rows, columns=["fp", "n", "odd"])


def keys_of(text: str, similarity: float) -> Column:
    """band_keys of the set of five-word shingles of a text (none for no words)."""

    @F.pandas_udf(ArrayType(LongType()))
    def keys(texts: pd.Series) -> pd.Series:
        return pd.Series([band_keys(distinct_shingles(word_hashes(t)), similarity).view(np.int64) for t in texts], dtype=object)

    return keys(text)


@F.pandas_udf(ArrayType(LongType()))
def shingles_of(texts: pd.Series) -> pd.Series:
    """Distinct hashes of the five-word shingles of each text."""
    return pd.Series([distinct_shingles(word_hashes(t)).view(np.int64) for t in texts], dtype=object)


def parities(shingles: np.ndarray) -> np.ndarray:
    """A bit for each of ODD_BITS classes: whether it holds an odd number of shingles. Two sets differ in at least as many shingles as their parities in bits."""
    counts = np.bincount((shingles >> np.uint64(64 - ODD_BITS.bit_length() + 1)).astype(np.int64), minlength=ODD_BITS)
    return np.packbits((counts & 1).astype(bool))


def band_keys(shingles: np.ndarray, similarity: float = COPY_SIMILARITY) -> np.ndarray:
    """Keys of a sorted set, of which any two sets that share ``similarity`` have one in common.

    Such sets differ in at most (1 - similarity) / (1 + similarity) of their joint size. Sets are compared as those of the class (by powers of two) of the larger one, so a set has
    keys in its own class and in those that larger ones may be in. In a class the hashes are cut into fixed parts. Each shingle by which sets differ spoils one part at
    most, so of all parts taken in one order, those of most shingles first, one more than may be spoilt are enough: the first part that agrees is among them in both sets.
    """
    n, share, keys = len(shingles), (1 - similarity) / (1 + similarity), [shingles[:0]]
    most = int(n / similarity + 1e-9)
    mixed = (shingles ^ (shingles >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed ^ (mixed >> np.uint64(32)), dtype=np.uint64)])
    for size in range(n.bit_length(), most.bit_length() + 1) if n else ():
        largest = (1 << size) - 1
        parts = max(LEAST_PARTS, int(PARTS * (int(2 * share * largest + 1e-9) + 1)))
        part = ((shingles >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        counts = np.bincount(part.astype(np.int64), minlength=parts)
        ends = np.concatenate([[0], np.cumsum(counts)])
        key = sums[ends[1:]] - sums[ends[:-1]] + np.arange(size * LARGEST_PARTS, size * LARGEST_PARTS + parts, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        key = (key ^ (key >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        key ^= key >> np.uint64(31)
        keys.append(key[np.lexsort((key, -counts))[: int(share * (n + min(largest, most)) + 1e-9) + 1]])
    return np.concatenate(keys)


def nearest_others(words: np.ndarray, fine: np.ndarray, group: np.ndarray, most: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row its ``most`` nearest rows of another group within both radii: rows i and j, and the rows that had more.

    Tiles of rows sorted by the bit counts of their words are compared; tile pairs whose bit counts differ by more than the radius are skipped.
    """
    none = np.zeros(0, np.int64)
    if len(words) <= 256 and np.count_nonzero(np.bitwise_count(words[:, None] ^ words[None]) <= COPY_RADIUS) == len(words):
        return none, none, none  # each is near itself alone
    bits = np.bitwise_count(words).astype(np.int64)
    order = np.argsort(bits, kind="stable")
    words, fine, group, bits = words[order], fine[order], group[order], bits[order]
    one, two, cut = [], [], []
    for a in range(0, len(words), tile):
        e = min(a + tile, len(words))
        low, high = np.searchsorted(bits, bits[a] - COPY_RADIUS), np.searchsorted(bits, bits[e - 1] + COPY_RADIUS, side="right")
        i, j, d = [], [], []
        for b in range(low, high, tile):
            x = np.bitwise_count(words[a:e, None] ^ words[None, b : min(b + tile, high)])
            near = np.nonzero(x <= COPY_RADIUS)
            y = np.bitwise_count(fine[a + near[0]] ^ fine[b + near[1]])
            open_ = (y <= FINE_RADIUS) & (group[a + near[0]] != group[b + near[1]])
            i, j, d = [*i, a + near[0][open_]], [*j, b + near[1][open_]], [*d, x[near][open_].astype(np.int64) + y[open_]]
            i, j, d = map(np.concatenate, (i, j, d))
            by = np.lexsort((j, d, i))
            i, j, d = i[by], j[by], d[by]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            i, j, d = [i[rank <= most]], [j[rank <= most]], [d[rank <= most]]  # one more than asked for tells that there are more
        i, j = i[0], j[0]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        one.append(order[i[rank < most]])
        two.append(order[j[rank < most]])
        cut.append(order[i[rank == most]])
    whole = lambda x: np.concatenate([none, *x])
    return whole(one), whole(two), whole(cut)


def copy_buckets(nodes: DataFrame, bucket_nodes: int = BUCKET_NODES) -> DataFrame:
    """Buckets (mask, key, low, high, words, fine) of nodes (words, fine).

    Two fingerprints of words within the radius share a bucket for some choice of blocks. A bucket of more than bucket_nodes rows is dealt to slices
    that meet in pairs, so no task holds more than about that many.
    """
    blocks = COPY_RADIUS + (2 if nodes.count() > 4096 else 1)
    masks = F.array(*(F.lit(signed(m)) for m in block_masks(blocks, COPY_RADIUS)))
    dealt = nodes.select("words", "fine", F.posexplode(masks).alias("mask", "bits")).select("words", "fine", "mask", F.col("words").bitwiseAND(F.col("bits")).alias("key"))
    large = dealt.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > bucket_nodes)
    large = materialise(large.select("mask", "key", F.ceil(2 * F.col("n") / bucket_nodes).cast("int").alias("slices")), "large")
    if large.isEmpty():
        return dealt.select("mask", "key", F.lit(0).alias("low"), F.lit(0).alias("high"), "words", "fine")
    dealt = dealt.join(large, ["mask", "key"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = F.pmod(F.xxhash64("words", "fine"), F.col("slices")).cast("int")
    met = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    return met.select("mask", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "words", "fine")


def candidate_pairs(buckets: DataFrame, most: int) -> DataFrame:
    """Rows (a, b, cut) of buckets with a group: nodes near each other, and nodes with more of them than were named (b null)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None  # rows come sorted by bucket; a bucket may be cut by the end of a batch
        for part in batches:
            part = part if rest is None else pd.concat([rest, part], ignore_index=True)
            starts = bucket_starts(part)
            rest = part.iloc[starts[-1] :].reset_index(drop=True)
            yield from named(part, starts)
        if rest is not None and len(rest):
            yield from named(rest, np.array([0, len(rest)]))

    def named(part: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        words, fine = (part[c].to_numpy().view(np.uint64) for c in ("words", "fine"))
        group = pd.factorize(part["grp"])[0]
        name = lambda at: [f"{w:016x}{f:016x}" for w, f in zip(words[at].tolist(), fine[at].tolist(), strict=True)]
        several = np.flatnonzero(np.diff(starts) > 1)
        for s, e in zip(starts[several], starts[several + 1], strict=True):
            i, j, cut = nearest_others(words[s:e], fine[s:e], group[s:e], most)
            if len(i):
                a, b = name(s + i), name(s + j)
                low, high = [min(x) for x in zip(a, b, strict=True)], [max(x) for x in zip(a, b, strict=True)]
                yield pd.DataFrame({"a": low + name(s + cut), "b": high + [None] * len(cut)})

    def bucket_starts(part: pd.DataFrame) -> np.ndarray:
        key = part[["mask", "key", "low", "high"]].to_numpy()
        return np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1])

    by = ["mask", "key", "low", "high"]
    return buckets.select(*by, "words", "fine", "grp").repartition(*by).sortWithinPartitions(*by).mapInPandas(run, "a string, b string").distinct()


def open_pairs(n: np.ndarray, odd: np.ndarray, group: np.ndarray, most: int, similarity: float, tile: int = 64, width: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i and j of a bucket that may share ``similarity`` and are of two groups, and the rows that had more of them.

    Rows that are not of the bucket's largest group name their ``most`` nearest; of every two rows of different groups one is such a row.
    Sets that share so much differ in at most (1 - similarity) / (1 + similarity) of their joint size, and in no fewer shingles than parities (odd, as rows of 64-bit words).
    """
    none = np.zeros(0, np.int64)
    if (group == group[0]).all():
        return none, none, none
    choosing = np.flatnonzero(group != np.bincount(group).argmax())
    bound = (1 - similarity) / (1 + similarity) + 1e-9
    one, two, cut = [none], [none], [none]
    for a in range(0, len(choosing), tile):
        c = choosing[a : a + tile]
        i, j, d = none, none, np.zeros(0)
        for b in range(0, len(n), width):
            both = n[c, None] + n[None, b : b + width]
            differ = np.bitwise_count(odd[c, None] ^ odd[None, b : b + width]).sum(axis=2, dtype=np.int64)
            differ = np.maximum(differ, np.abs(n[c, None] - n[None, b : b + width]))
            x, y = np.nonzero((differ <= bound * both) & (group[c, None] != group[None, b : b + width]))
            i, j, d = np.concatenate([i, c[x]]), np.concatenate([j, b + y]), np.concatenate([d, differ[x, y] / both[x, y]])
            by = np.lexsort((j, d, i))
            i, j, d = i[by], j[by], d[by]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            i, j, d = i[rank <= most], j[rank <= most], d[rank <= most]  # one more than asked for tells that there are more
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        one.append(i[rank < most])
        two.append(j[rank < most])
        cut.append(i[rank == most])
    return np.concatenate(one), np.concatenate(two), np.concatenate(cut)


def open_candidates(cells: DataFrame, most: int, similarity: float) -> DataFrame:
    """Distinct rows (a, b, key) of cells (key, low, high, id, n, odd, grp): pairs a < b to be compared (key null), and buckets in which a row had more of them (a, b null)."""

    def named(part: pd.DataFrame) -> pd.DataFrame:
        ids = part["id"].to_numpy()
        odd = np.frombuffer(b"".join(part["odd"]), np.uint64).reshape(len(part), -1)
        i, j, cut = open_pairs(part["n"].to_numpy().astype(np.int64), odd, pd.factorize(part["grp"])[0], most, similarity)
        found = pd.DataFrame({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j]), "key": None})
        more = pd.DataFrame({"a": None, "b": None, "key": part["key"].iloc[:1]}) if len(cut) else found.iloc[:0]
        return pd.concat([x.astype("Int64") for x in (found, more)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # rows come sorted by cell; a cell may be cut by the end of a batch
        for part in batches:
            if not len(part):
                continue
            cell = part[["key", "low", "high"]].to_numpy()
            starts = np.concatenate([[0], np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1, [len(part)]])
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if held and (held[-1][["key", "low", "high"]].iloc[-1].to_numpy() != cell[s]).any():
                    yield named(pd.concat(held, ignore_index=True))
                    held = []
                held.append(part.iloc[s:e])
        if held:
            yield named(pd.concat(held, ignore_index=True))

    by = ["key", "low", "high"]
    return cells.repartition(*by).sortWithinPartitions(*by, "id").mapInPandas(run, "a long, b long, key long").distinct()


def near_copies(docs: DataFrame, similarity: float = COPY_SIMILARITY, most: int = NEAREST, bucket_nodes: int = BUCKET_NODES) -> DataFrame:
    """doc_id, fp (name of the set of five-word shingles, 32 hexadecimal digits) and root (one for each group of near copies) of docs (doc_id, text).

    Near copies share ``similarity`` of their distinct five-word shingles, or are joined by such. Sets that share so much have a key
    in common and so a bucket (see band_keys). Each set is compared with the first of a bucket; sets of a bucket that are not joined by then are compared with
    their ``most`` nearest of other groups, then with eight times as many each round, until no two of different groups are left that the bound of open_pairs does not
    tell apart. Shares are counted exactly. Equal sets are one; null texts and those without words are one group; a text of fewer than five words
    is one shingle. Repeated and null ids are as in near_duplicates. An empty table gives an empty result.
    """
    marked = docs.select(F.col("doc_id").cast("long"), text_of("text").alias("digest"), sketch_of("text").alias("s")).select("doc_id", "digest", "s.*")
    marked = materialise(marked, "fingerprints", compression="zstd")
    first = marked.groupBy("fp").agg(F.min("digest").alias("digest"), *(F.first(c).alias(c) for c in ("n", "odd")))
    nodes = materialise(first.withColumn("id", F.monotonically_increasing_id()), "nodes", compression="zstd")
    bucket = W.partitionBy("key")
    # keys are many: they are taken from the texts anew and not stored with what tells a set
    keyed = docs.select(text_of("text").alias("digest"), keys_of("text", similarity).alias("keys")).dropDuplicates(["digest"]).join(nodes.select("digest", "id"), "digest")
    dealt = keyed.select("id", F.explode("keys").alias("key")).select("id", F.bit_xor(F.xxhash64("id")).over(bucket).alias("key"), F.min("id").over(bucket).alias("head"), F.count("*").over(bucket).alias("size"))
    # buckets of the same sets are one: alike sets meet under many keys
    buckets = materialise(dealt.where("size > 1").groupBy("id", "key", "head", "size").agg(F.count("*").alias("times")), "buckets", compression="zstd")
    shingles = materialise(shingles_for(docs, nodes.join(buckets.select("id").distinct(), "id", "left_semi")), "shingles", compression="zstd")
    # the head that a node meets in most buckets
    heads = buckets.where("id > head").groupBy("head", "id").agg(F.sum("times").alias("times")).groupBy("id").agg(F.max_by("head", F.struct("times", "head")).alias("a"))
    tested = materialise(heads.select("a", F.col("id").alias("b")), "tested")
    tree, waiting = tree_of(similar(shingles, tested, similarity)), buckets
    while True:
        grouped = waiting.join(tree.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "size", F.coalesce("root", "id").alias("grp"))
        grouped = grouped.select("*", F.min("grp").over(bucket).alias("least"), F.max("grp").over(bucket).alias("largest")).where("least < largest")
        # a bucket of more than bucket_nodes is dealt to slices that meet in pairs, so no task holds more than about that many
        slices = F.when(F.col("size") > bucket_nodes, F.ceil(2 * F.col("size") / bucket_nodes)).otherwise(1).cast("int")
        met = grouped.select("key", "id", "grp", F.pmod(F.xxhash64("id"), slices).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("other"))
        cells = met.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "id", "grp").join(nodes.select("id", "n", "odd"), "id")
        found = materialise(open_candidates(cells, most, similarity), "candidates")
        pairs = materialise(found.where("key is null").select("a", "b").join(tested, ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            tree = tree_of(similar(shingles, pairs, similarity).union(tree.select("node", "root")))
        # only buckets with a row that had more candidates are looked at again
        left = found.where("key is not null").select("key").distinct()
        if left.isEmpty():
            break
        tested, waiting, most = tested.union(pairs), materialise(waiting.join(left, "key", "left_semi"), "waiting"), most * 8
    rooted = nodes.join(tree, nodes["id"] == tree["node"], "left").select("fp", F.coalesce("root", "id").alias("root"))
    return marked.join(rooted, "fp").select("doc_id", "fp", "root")


def tree_of(links: DataFrame) -> DataFrame:
    """Components of links (a, b), stored; what they take on the way is deleted."""
    return distilled(links.sparkSession, "tree", lambda: components(links))


def text_of(text: str) -> Column:
    """What tells a text from others; null is the empty text."""
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def shingles_for(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and shingles s of wanted (id, digest of a text)."""
    texts = docs.select(text_of("text").alias("digest"), "text").join(wanted.select("id", "digest"), "digest")
    return texts.select("id", "digest", "text").dropDuplicates(["digest"]).select("id", shingles_of("text").alias("s"))


def similar(shingles: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of ids whose shingles (id, s) agree enough, stored."""
    x = shingles.select(F.col("id").alias("a"), F.col("s").alias("x"))
    y = shingles.select(F.col("id").alias("b"), F.col("s").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", shared.alias("shared"), (F.size("x") + F.size("y")).alias("total"))
    return materialise(both.where(F.col("shared") >= similarity * (F.col("total") - F.col("shared"))).select("a", "b"), "links")


def keep_one_copy(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies (see near_copies), chosen as in keep_one."""
    found = distilled(docs.sparkSession, "found", lambda: near_copies(docs.select("doc_id", "text")))
    return least_of_each(docs, found, sketch_of("text")["fp"])


def op7_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
