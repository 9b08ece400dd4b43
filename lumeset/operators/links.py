"""Similarity joins: links between classes of equal rows, without meeting all pairs where the data allow it.

Hashes meet in buckets of equal blocks of bits, chosen by the number of hashes, and are compared in numpy; buckets too large for a task meet tile by tile. Vectors meet block by
block; blocks whose angles to common pivots rule a link out do not meet, and rows close around one pivot are a group whose members are all linked, which
is told by membership instead of pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumeset.operators.blocks import unit_rows
from lumeset.session import materialise

BUCKET, TILE = 2048, 4096  # hashes of a bucket that are compared in one task; of a tile
SEARCHED = 64  # times as many, if several masks are left by which they are found
MASKS, DEALT = 200, 50.0  # masks at most; what it costs to deal a hash out once, in comparisons
ROW, LINK = np.dtype([("h", "<u8"), ("class", "<i8"), ("n", "<i8")]), "a long, b long, distance int, n_a long, n_b long"
PIVOTS, CELL, BLOCK, BANDS = 512, 512, 2048, 16  # pivots at most; rows for each; rows of a block; bands of angles in a cell
SLACK = 1e-6  # of angles, for rounding
MEETINGS = 8  # pairs of blocks, for each block, that are joined by number
PAIRS, COUNTS = 1 << 18, 512  # links that a task tells at once; blocks whose counts it holds


def hash_classes(df: DataFrame, key: str, h: str) -> DataFrame:
    """h, class (the smallest key of the rows with this hash) and n (how many they are); rows without a hash are in none."""
    return df.where(F.col(h).isNotNull()).groupBy(F.col(h).alias("h")).agg(F.min(key).alias("class"), F.count("*").alias("n"))


def mask_groups(n: int, under: int) -> list[list[int]]:
    """Masks of bits such that any two of 64 bits that differ in fewer than ``under`` agree under one of them, those with the same first block together, after this block's own mask.

    The bits are cut into m blocks; under - 1 bits touch as many blocks at most, so the others agree: every choice of that many blocks is a mask. More blocks
    are more masks but smaller buckets; what is cheapest for n hashes is taken, if nothing else one bucket with all.
    """
    found = (n * n / 2, [[0, 0]])
    for m in range(under, under + 8):
        k = m - under + 1
        if m > 64 or math.comb(m, k) > MASKS:
            break
        cost = math.comb(m, k) * (n * DEALT + n * n / 2 / 2 ** (64 * k / m))
        if cost < found[0]:
            edges = [64 * i // m for i in range(m + 1)]
            blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
            found = (cost, [[blocks[i], *(blocks[i] | sum(c) for c in itertools.combinations(blocks[i + 1 :], k - 1))] for i in range(under)])
    return found[1]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(n: int, under: int) -> list[int]:
    """All masks of mask_groups, as signed numbers."""
    return [signed(x) for _, *masks in mask_groups(n, under) for x in masks]


def hamming_links(df: DataFrame, key: str, h: str, under: int, bucket: int = BUCKET, tile: int = TILE) -> DataFrame:
    """a, b, distance, n_a, n_b (a < b): classes of equal hashes whose hashes differ in fewer than ``under`` bits, and how many rows each has.

    Copies are never expanded into pairs: each row of a class is linked to each of the other, and the rows of one class to each other. A hash is dealt out once for each first
    block, with its class, and a bucket is searched mask by mask in its task; of the masks under which two hashes agree the first tells the link, so links are not
    dealt out again. Buckets of too many hashes are dealt out by each mask, and those that are still too large meet tile by tile.
    """
    classes = materialise(hash_classes(df, key, h).where("class is not null"), "classes")
    groups = mask_groups(classes.count(), under)
    masks = [x for _, *more in groups for x in more]
    numbers, at = [], 0
    for _, *more in groups:
        numbers.append(list(range(at, at + len(more))))
        at += len(more)
    under_mask = lambda i, m: F.struct(F.lit(i).alias("mask"), F.col("h").bitwiseAND(F.lit(signed(m))).alias("bits"))
    each = F.explode(F.array(*(under_mask(i, head) for i, (head, *_) in enumerate(groups)))).alias("e")
    several = len(masks) > len(groups)
    small, large = by_bucket(classes.select("h", "class", "n", each).select("h", "class", "n", "e.mask", "e.bits"), bucket * (SEARCHED if several else 1))
    found = near_in_buckets(small, under, masks, numbers)
    if several and large is not None:
        each = F.explode(F.get(F.array(*(F.array(*(under_mask(i, masks[i]) for i in own)) for own in numbers)), F.col("mask"))).alias("e")
        small, large = by_bucket(large.select("h", "class", "n", each).select("h", "class", "n", "e.mask", "e.bits"), bucket)
        found = found.union(near_in_buckets(small, under, masks, [[i] for i in range(len(masks))]))
    return found if large is None else found.union(tiled_links(large, under, masks, tile))


def by_bucket(dealt: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows (h, class, n, mask, bits) in buckets (mask, bits) of at most so many, and the others with ``size``, that of their bucket, if there are any."""
    sizes = materialise(dealt.groupBy("mask", "bits").agg(F.count("*").alias("size")).where(F.col("size") > most), "large")  # no more than a row for each ``most`` dealt
    if sizes.isEmpty():
        return dealt, None
    return dealt.join(F.broadcast(sizes), ["mask", "bits"], "left_anti"), dealt.join(F.broadcast(sizes), ["mask", "bits"])


def told(one: np.ndarray, two: np.ndarray, masks: list[int], mask: int) -> pd.DataFrame:
    """Links of near rows (h, class, n) that agree under no mask before this one."""
    x = one["h"] ^ two["h"]
    first = np.ones(len(x), bool)
    for m in masks[:mask]:
        first &= (x & np.uint64(m)) != 0
    one, two, x = one[first], two[first], x[first]
    swapped = one["class"] > two["class"]
    a, b = np.where(swapped, two, one), np.where(swapped, one, two)
    return pd.DataFrame({"a": a["class"], "b": b["class"], "distance": np.bitwise_count(x).astype(np.int32), "n_a": a["n"], "n_b": b["n"]})


def near_in_buckets(dealt: DataFrame, under: int, masks: list[int], numbers: list[list[int]]) -> DataFrame:
    """Links within buckets (mask, bits) of rows (h, class, n) that fit a task; numbers: of the masks under which a bucket's rows are compared, by its ``mask``."""

    def search(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for group, part in f.groupby("mask", sort=False):
            rows = np.empty(len(part), ROW)
            for c in ("h", "class", "n"):
                rows[c] = part[c].to_numpy()
            for number in numbers[group]:
                rows = rows[np.argsort(rows["h"] & np.uint64(masks[number]))]
                h, key = np.ascontiguousarray(rows["h"]), rows["h"] & np.uint64(masks[number])
                i, one, two, n = np.arange(len(h)), [], [], 0
                for d in range(1, len(h)):  # rows of one key are neighbours
                    i = i[: np.searchsorted(i, len(h) - d)]
                    i = i[key[i] == key[i + d]]
                    if not len(i):
                        break
                    near = i[np.bitwise_count(h[i] ^ h[i + d]) < under]
                    one, two, n = [*one, near], [*two, near + d], n + len(near)
                    if n > PAIRS:
                        yield told(rows[np.concatenate(one)], rows[np.concatenate(two)], masks, number)
                        one, two, n = [], [], 0
                if n:
                    yield told(rows[np.concatenate(one)], rows[np.concatenate(two)], masks, number)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # rows come sorted by bucket; a bucket may be cut by the end of a batch
        for f in batches:
            if not len(f):
                continue
            last = (f["mask"] == f["mask"].iloc[-1]) & (f["bits"] == f["bits"].iloc[-1])
            if not last.all() or held and (held[-1]["mask"].iloc[-1], held[-1]["bits"].iloc[-1]) != (f["mask"].iloc[-1], f["bits"].iloc[-1]):
                yield from search(pd.concat([*held, f[~last]], ignore_index=True))
                held = []
            held.append(f[last])
        if held:
            yield from search(pd.concat(held, ignore_index=True))

    rows = dealt.select("mask", "bits", F.col("h").cast("long"), F.col("class").cast("long"), "n")
    return rows.repartition("mask", "bits").sortWithinPartitions("mask", "bits").mapInPandas(meet, LINK)


def tiled_links(dealt: DataFrame, under: int, masks: list[int], tile: int) -> DataFrame:
    """Links within buckets (mask, bits) of rows (h, class, n; size: the bucket's): each two tiles of a bucket meet once, in numpy.

    Few meetings are joined by bucket and tile; where there are many, each part of the stored tiles is read beside each other part and nothing is dealt out.
    """

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        rows = np.empty(len(f), ROW)
        for c in ("h", "class", "n"):
            rows[c] = f[c].to_numpy()
        return f[["mask", "bits", "tiles", "p"]].iloc[:1].assign(hs=[rows.tobytes()])

    placed = dealt.withColumn("class", F.col("class").cast("long")).withColumn("tiles", F.ceil(F.col("size") / tile)).withColumn("p", F.pmod(F.xxhash64("h"), "tiles"))
    packed = materialise(placed.groupBy("mask", "bits", "p").applyInPandas(pack, "mask int, bits long, tiles long, p long, hs binary"), "tiles", **{"parquet.block.size": 4 << 20})
    many = packed.agg(F.coalesce(F.sum(F.col("tiles") + 1) > 2 * MEETINGS * F.count("*"), F.lit(False))).first()[0]
    if many:
        left = packed.select("mask", "bits", "p", F.col("hs").alias("h1")).hint("shuffle_replicate_nl")
        right = packed.select(F.col("mask").alias("mask2"), F.col("bits").alias("bits2"), F.col("p").alias("q"), F.col("hs").alias("h2"))
        both = left.join(right, (F.col("mask") == F.col("mask2")) & (F.col("bits") == F.col("bits2")) & (F.col("p") <= F.col("q")))
    else:
        left = packed.select("mask", "bits", "p", F.col("hs").alias("h1"), F.explode(F.sequence(F.col("p"), F.col("tiles") - 1)).alias("q"))
        right = packed.select("mask", "bits", F.col("p").alias("q"), F.col("hs").alias("h2"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("p"))).alias("p"))
        both = left.join(right, ["mask", "bits", "p", "q"])

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for r in f.itertuples(index=False):
                a, b = np.frombuffer(r.h1, ROW), np.frombuffer(r.h2, ROW)
                y = np.ascontiguousarray(b["h"])
                for s in range(0, len(a), 256):
                    part = a[s : s + 256]
                    x = np.ascontiguousarray(part["h"])
                    near = np.bitwise_count(x[:, None] ^ y[None]) < under
                    i, j = np.nonzero(near & (x[:, None] < y[None]) if r.p == r.q else near)
                    if len(i):
                        yield told(part[i], b[j], masks, r.mask)

    return both.select("mask", "p", "q", "h1", "h2").mapInPandas(meet, LINK)


# --- vectors ---


def vectors_of(df: DataFrame, key: str, vec: str) -> DataFrame:
    """class (the key) and v (floats as they are, else doubles) of rows with both."""
    kind = "array<float>" if dict(df.dtypes)[vec] == "array<float>" else "array<double>"
    return df.where(F.col(vec).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("class"), F.col(vec).cast(kind).alias("v"))


def vector_classes(df: DataFrame, key: str, vec: str) -> DataFrame:
    """v, class (the smallest key of the rows with this vector) and n; null vectors are in none."""
    return vectors_of(df, key, vec).groupBy("v").agg(F.min("class").alias("class"), F.count("*").alias("n"))


def thinned(x: np.ndarray, angle: float) -> np.ndarray:
    """Unit vectors without those closer than the angle to one before, so that a dense group has one pivot."""
    kept: list[int] = []
    for i in range(len(x)):
        if not kept or (np.arccos(np.clip(x[kept] @ x[i], -1, 1)) >= angle).all():
            kept.append(i)
    return x[kept]


def met_blocks(rows: DataFrame, at_least: float, grouped: bool, block: int, cell: int, pivots: int) -> tuple[DataFrame | None, DataFrame]:
    """Pairs of blocks of rows (class, n, v) that may hold a link, as one block has its columns (see ``linked``) with 1 and 2 after their names, and class, n and grp of all rows.

    Where blocks meet few others they are joined by number. Where they meet many, each part of the stored blocks is read beside each other part: nothing is
    dealt out then, so what lies on disk is the blocks alone, however many pairs there are.
    """
    spark = rows.sparkSession
    total = rows.count()
    if not total:
        return None, rows.select("class", "n", F.lit(None).cast("int").alias("grp"))
    kind, of = dict(rows.dtypes)["v"], "<f4" if dict(rows.dtypes)["v"] == "array<float>" else "<f8"
    widest = math.acos(max(-1.0, min(1.0, at_least)))
    asked = rows.where(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("class")).limit(max(1, min(pivots, total // cell))).select("v").collect()  # at most ``pivots`` rows
    heads = thinned(unit_rows(np.array([r["v"] for r in asked], float)), widest / 4) if asked else np.zeros((0, 1))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            x = unit_rows(np.stack(f["v"].to_numpy()).astype(float))
            angle = np.arccos(np.clip(x @ heads.T, -1, 1)) if len(heads) else np.zeros((len(x), 1))
            near = angle.argmin(1)
            least = angle[np.arange(len(x)), near]
            zero = ~x.any(axis=1)
            tight = grouped & ~zero & (least <= widest / 2 - SLACK)
            yield f.assign(cell=np.where(zero, -1, near).astype(np.int32), angle=least, grp=pd.array(np.where(tight, near, 0), "Int32").copy()).assign(grp=lambda t, k=tight: t["grp"].mask(~k))

    # cheap beside what is stored for it, so it is found anew where it is read
    placed = rows.select("class", "n", "v").mapInPandas(place, f"class long, n long, v {kind}, cell int, angle double, grp int")
    members = materialise(placed.select("class", "n", "grp", "cell", "angle"), "placed")
    cells = members.where("cell >= 0").groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("angle", [i / BANDS for i in range(1, BANDS)], 1000).alias("cuts")).collect()  # at most ``pivots`` rows
    members = members.select("class", "n", "grp")
    if not cells:
        return None, members
    table = spark.createDataFrame([(r["cell"], r["cuts"], -(-r["n"] // block)) for r in cells], "cell int, cuts array<double>, blocks long")
    bands = F.least(F.lit(BANDS), F.col("blocks"))
    band = F.floor(F.size(F.filter("cuts", lambda x: x < F.col("angle"))) * bands / BANDS)
    parts = F.ceil(F.col("blocks") / BANDS)
    dealt = placed.join(F.broadcast(table), "cell").withColumn("block", band * parts + F.pmod(F.xxhash64("class", "v"), parts)).select("cell", "block", "class", "n", "v", "grp")  # a row a cell

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(f["v"].to_numpy()).astype(of)
        angle = np.arccos(np.clip(unit_rows(v.astype(float)) @ heads.T, -1, 1))
        return f[["cell", "block"]].iloc[:1].assign(ids=[f["class"].to_numpy("<i8").tobytes()], ns=[f["n"].to_numpy("<i8").tobytes()], grps=[f["grp"].fillna(-1).to_numpy("<i4").tobytes()], vecs=[v.tobytes()], low=[angle.min(0)], high=[angle.max(0)])

    packed = dealt.groupBy("cell", "block").applyInPandas(pack, "cell int, block long, ids binary, ns binary, grps binary, vecs binary, low array<double>, high array<double>")
    packed = materialise(packed.withColumn("id", F.monotonically_increasing_id()), "blocks", **{"parquet.block.size": 4 << 20})
    # angles to all pivots: the least that vectors of the two blocks can be apart
    gap = F.array_max(F.zip_with(F.zip_with("low1", "high2", lambda a, b: a - b), F.zip_with("low2", "high1", lambda a, b: a - b), lambda a, b: F.greatest(a, b)))
    own = lambda i, j: F.get(f"low{j}", F.col(f"cell{i}")) - F.get(f"high{i}", F.col(f"cell{i}")) <= widest + SLACK  # noqa: E731  by its own pivot first: most is ruled out
    may = (F.col("id1") <= F.col("id2")) & own(1, 2) & own(2, 1) & (gap <= widest + SLACK)
    ends = ("cell", "low", "high")
    side = lambda i, *names: packed.select(*(F.col(c).alias(f"{c}{i}") for c in ("id", *names)))
    data = ("ids", "ns", "grps", "vecs")
    met = materialise(side(1, *ends).hint("shuffle_replicate_nl").join(side(2, *ends), may).select("id1", "id2"), "met")
    if met.count() <= MEETINGS * packed.count():
        return met.join(side(1, *data), "id1").join(side(2, *data), "id2").withColumn("of", F.lit(of)), members
    every = side(1, *ends, *data).hint("shuffle_replicate_nl").join(side(2, *ends, *data), may)
    return every.select("id1", "id2", *(f"{c}{i}" for i in (1, 2) for c in data), F.lit(of).alias("of")), members


def linked(r: tuple, at_least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes of two blocks (ids, ns: 64-bit numbers; grps: -1 for none; vecs: numbers of the type ``of``), and places and cosines of their links: of rows not in one group, each once."""
    a, b = np.frombuffer(r.ids1, "<i8"), np.frombuffer(r.ids2, "<i8")
    g, h = np.frombuffer(r.grps1, "<i4"), np.frombuffer(r.grps2, "<i4")
    x, y = (unit_rows(np.frombuffer(v, r.of).reshape(n, -1).astype(float)) for v, n in ((r.vecs1, len(a)), (r.vecs2, len(b))))
    cos = x @ y.T
    i, j = np.nonzero(cos >= min(at_least, 1 - 1e-9))
    keep = ((a[i] < b[j]) if r.id1 == r.id2 else (a[i] != b[j])) & ((g[i] != h[j]) | (g[i] < 0))
    i, j = i[keep], j[keep]
    c = cos[i, j]
    if len(close := np.flatnonzero(c > 1 - 1e-9)) and at_least <= 1:
        # equal vectors have a cosine of 1, whatever rounding makes of it
        number = np.unique(np.concatenate([x, y]).view(f"V{8 * x.shape[1]}"), return_inverse=True)[1].ravel()
        c[close[number[i[close]] == number[len(a) + j[close]]]] = 1.0
    hit = c >= at_least
    return a, b, i[hit], j[hit], c[hit]


def linked_pairs(met: DataFrame, at_least: float) -> DataFrame:
    """a, b, cosine (a < b) of the links in pairs of blocks."""

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for r in f.itertuples(index=False):
                a, b, i, j, cosine = linked(r, at_least)
                for s in range(0, len(i), PAIRS):
                    one, two = a[i[s : s + PAIRS]], b[j[s : s + PAIRS]]
                    yield pd.DataFrame({"a": np.minimum(one, two), "b": np.maximum(one, two), "cosine": cosine[s : s + PAIRS]})

    return met.mapInPandas(meet, "a long, b long, cosine double")


def cosine_links(df: DataFrame, key: str, vec: str, at_least: float, grouped: bool = True, block: int = BLOCK, cell: int = CELL, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """Links and membership of classes of equal vectors with a cosine of at least the threshold; zero vectors have no links.

    Links: a, b, cosine (a < b), of classes not in one group. Membership: class, n (its rows), and ``grp``, the group it is in or null: classes within half the
    threshold's angle of one pivot are all linked to each other, which no pair tells. Without ``grouped`` every link is a pair. All vectors must be of one dimension.
    """
    met, members = met_blocks(materialise(vector_classes(df, key, vec), "classes"), at_least, grouped, block, cell, pivots)
    return df.sparkSession.createDataFrame([], "a long, b long, cosine double") if met is None else linked_pairs(met, at_least), members


def link_counts(links: DataFrame, members: DataFrame) -> DataFrame:
    """class, n and ``links``: how many other rows a row of the class is linked to, copies of it among them."""
    sizes = members.select("class", "n")
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return counted(both.join(sizes.withColumnRenamed("class", "b"), "b").select(F.col("a").alias("class"), F.col("n").alias("far")), members)


def counted(far: DataFrame, members: DataFrame) -> DataFrame:
    """class, n and ``links``: the rows of its own class and group, and what ``far`` (class, far) has."""
    far = far.groupBy("class").agg(F.sum("far").alias("_far"))
    groups = members.where("grp is not null").groupBy("grp").agg(F.sum("n").alias("_all"))
    found = members.join(far, "class", "left").join(groups, "grp", "left")
    own = F.coalesce("_all", F.col("n")) - 1
    return found.select("class", "n", (own + F.coalesce("_far", F.lit(0))).alias("links"))


def cosine_degrees(df: DataFrame, key: str, vec: str, at_least: float, block: int = BLOCK, cell: int = CELL, pivots: int = PIVOTS) -> DataFrame:
    """link_counts of cosine_links, counted where the blocks meet, so that no pair leaves a task."""
    met, members = met_blocks(materialise(vector_classes(df, key, vec), "classes"), at_least, True, block, cell, pivots)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        far: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        told = lambda: pd.DataFrame({c: np.concatenate(x) for c, x in zip(("class", "far"), zip(*far.values(), strict=True), strict=True)})
        for f in batches:
            for r in f.itertuples(index=False):
                a, b, i, j, _ = linked(r, at_least)
                for block, ids, ns, at, other in ((r.id1, a, r.ns2, i, j), (r.id2, b, r.ns1, j, i)):
                    more = np.bincount(at, np.frombuffer(ns, "<i8")[other], len(ids)).astype(np.int64)
                    far[block] = (ids, far[block][1] + more if block in far else more)
                if len(far) > COUNTS:
                    yield told()
                    far.clear()
        if far:
            yield told()

    return counted(df.sparkSession.createDataFrame([], "class long, far long") if met is None else met.mapInPandas(meet, "class long, far long"), members)


def cosine_pairs(df: DataFrame, key: str, vec: str, at_least: float, block: int = BLOCK) -> DataFrame:
    """a, b, cosine (a < b) of rows whose unit vectors have a cosine of at least the threshold; zero vectors have none.

    Every row is compared for itself, as each of its pairs is a row here; where there are many copies, use ``cosine_links``.
    """
    met, _ = met_blocks(vectors_of(df, key, vec).withColumn("n", F.lit(1).cast("long")), at_least, False, block, CELL, PIVOTS)
    return df.sparkSession.createDataFrame([], "a long, b long, cosine double") if met is None else linked_pairs(met, at_least)
