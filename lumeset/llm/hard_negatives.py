"""Hard negatives of anchors by bounds along a spanning tree of the anchors.

Anchors stand in blocks of like ones. A block's minimum spanning tree is stored with it: each anchor's parent, and the length of the edge between them.
Blocks of anchors meet chunks of candidates. The root's scores with a chunk are computed; a child's score with a candidate lies within the edge's length
times the candidate's norm of its parent's, so the bounds of a chunk go down the tree, and only candidates whose bounds overlap the window that a child
still looks into are scored (again: what is scored is exact, and its bounds are one number). One pass finds the positives, whose window is everything from
the last score held upwards; a second the negatives, whose windows lie between two shares of the positives' scores and shrink to the last score held.

All scores are integers; windows and ranks are exact. Where anchors are far from each other, bounds leave everything open and every pair is scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from lumeset.llm.common import integer_vectors, materialise

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # percent of the positive's score that a negative's may have
BLOCK = 2048  # anchors of a block, about
PIVOTS = 1024  # anchors that blocks are told apart by, at most
CHUNK, CHUNK_BYTES = 2048, 4 << 20  # candidates of a chunk, and bytes of its vectors, at most
TASK_CHUNKS = 64  # chunks that a task holds, about
LEAST, MOST = -(1 << 62), 1 << 62
CHUNK_SCHEMA = "dims int, chunk long, ids binary, labels binary, n binary, vecs binary"
BLOCK_SCHEMA = "block int, dims int, ids binary, labels binary, n binary, vecs binary, parent binary, edge binary"
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """order, parent, edge of a minimum spanning tree: rows of x so that parents precede children, the place of each one's parent in this order (-1 for the root), and the distance to it."""
    n = len(x)
    y = x.astype(float)
    square = (y**2).sum(1)
    left, near, to = np.ones(n, bool), np.full(n, np.inf), np.zeros(n, int)
    order, parent, at = [], [], 0
    place = np.zeros(n, int)
    for k in range(n):
        order.append(at)
        parent.append(place[to[at]] if k else -1)
        place[at], left[at] = k, False
        far = np.maximum(0.0, square + square[at] - 2.0 * (y @ y[at]))
        closer = left & (far < near)
        near[closer], to[closer] = far[closer], at
        at = int(np.where(left, near, np.inf).argmin())
    parent = np.array(parent, np.int64)
    rows = np.array(order, np.int64)
    edge = np.zeros(n)
    edge[1:] = np.sqrt(((y[rows[1:]] - y[rows[parent[1:]]]) ** 2).sum(1))
    return rows, parent, edge


def arrays(r, fields: dict[str, str]) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(getattr(r, c), kind) for c, kind in fields.items()}


CANDIDATE = {"ids": "<i8", "labels": "<i8", "n": "<i8", "vecs": "<i8"}
ANCHOR = CANDIDATE | {"parent": "<i8", "edge": "<f8"}


def opened(r, fields: dict[str, str]) -> dict[str, np.ndarray]:
    a = arrays(r, fields)
    return a | {"vecs": a["vecs"].reshape(len(a["ids"]), -1)}


def packed(f: pd.DataFrame) -> dict[str, list[bytes]]:
    return {"ids": [f["vec_id"].to_numpy("<i8").tobytes()], "labels": [f["label"].to_numpy("<i8").tobytes()], "n": [f["n"].to_numpy("<i8").tobytes()], "vecs": [np.stack(f["vec"].to_numpy()).astype("<i8").tobytes()]}


def chunks_of(rows: DataFrame, chunk: int) -> DataFrame:
    """rows (vec_id, label, vec, n) in chunks of CHUNK_SCHEMA, all vectors of a chunk of one dimension."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dims, f in b.groupby("dims"):
                size = max(1, min(chunk, CHUNK_BYTES // max(1, 8 * dims)))
                for s in range(0, len(f), size):
                    yield pd.DataFrame({"dims": np.array([dims], np.int32)} | packed(f.iloc[s : s + size]))

    stored = rows.withColumn("dims", F.size("vec")).mapInPandas(run, CHUNK_SCHEMA.replace("chunk long, ", ""))
    return stored.select("dims", F.monotonically_increasing_id().alias("chunk"), "ids", "labels", "n", "vecs")


def blocks_of(anchors: DataFrame, block: int) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """Anchors (vec_id, label, vec, n) in blocks of BLOCK_SCHEMA; and for each dimension its first block and how many it has.

    An anchor belongs to the nearest of some pivots, one for each block wanted; a pivot with more than a block's anchors has several blocks.
    """
    sizes = {r["dims"]: r["n"] for r in anchors.groupBy(F.size("vec").alias("dims")).agg(F.count("*").alias("n")).collect()}  # a row a dimension
    pivots = {d: np.zeros((0, d)) for d in sizes}
    for d, n in sizes.items():
        if n > block:
            of = anchors.where(F.size("vec") == d).orderBy(F.xxhash64("vec_id", "vec")).limit(min(PIVOTS, -(-n // block)))
            pivots[d] = np.array([r["vec"] for r in of.select("vec").collect()], float)  # at most PIVOTS rows

    @F.pandas_udf("int")
    def pivot(vec: pd.Series) -> pd.Series:
        out = np.zeros(len(vec), np.int32)
        dims = vec.map(len).to_numpy() if len(vec) else np.zeros(0, int)
        for d in np.unique(dims):
            if len(p := pivots[d]):
                x = np.stack(vec[dims == d].to_numpy()).astype(float)
                out[dims == d] = ((p**2).sum(1)[None] - 2.0 * (x @ p.T)).argmin(1)
        return pd.Series(out)

    placed = materialise(anchors.withColumn("dims", F.size("vec")).withColumn("pivot", pivot("vec")), "placed")
    held = {(r["dims"], r["pivot"]): r["n"] for r in placed.groupBy("dims", "pivot").agg(F.count("*").alias("n")).collect()}  # at most PIVOTS rows a dimension
    first, ranges, at = [], {}, 0
    for (d, p), n in sorted(held.items()):
        parts = -(-n // block)
        first.append((d, p, at, parts))
        low, many = ranges.get(d, (at, 0))
        ranges[d] = (low, many + parts)
        at += parts
    table = F.broadcast(anchors.sparkSession.createDataFrame(first, "dims int, pivot int, _first int, _parts int"))  # a row a pivot

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        order, parent, edge = spanning_tree(np.stack(f["vec"].to_numpy()).astype(np.int64))
        return pd.DataFrame({"block": f["block"].iloc[:1].to_numpy(), "dims": f["dims"].iloc[:1].to_numpy()} | packed(f.iloc[order]) | {"parent": [parent.tobytes()], "edge": [edge.tobytes()]})

    number = (F.col("_first") + F.pmod(F.xxhash64("vec_id", "label", "vec"), F.col("_parts").cast("long"))).cast("int")
    dealt = placed.join(table, ["dims", "pivot"]).select(number.alias("block"), "dims", "vec_id", "label", "n", "vec")
    return materialise(dealt.groupBy("block").applyInPandas(pack, BLOCK_SCHEMA), "blocks"), ranges


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of the integer rows of x with the integer vector y."""
    bound = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(1, x.shape[-1])
    return (x.astype(float) @ y.astype(float)).astype(np.int64) if bound < 2.0**53 else x @ y


class Held:
    """The first ``count`` scores found so far, ties by smaller id; a row counts as often as it stands in the table."""

    def __init__(self, count: int):
        self.count, self.scores, self.ids = count, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """Scores below this are of no use."""
        return int(self.scores[-1]) if len(self.scores) == self.count else LEAST

    def add(self, scores: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        use = scores >= self.least
        if not use.any():
            return
        often = np.minimum(n[use], self.count)
        s, i = np.concatenate([self.scores, np.repeat(scores[use], often)]), np.concatenate([self.ids, np.repeat(ids[use], often)])
        best = np.lexsort((i, -s))[: self.count]
        self.scores, self.ids = s[best], i[best]


def descend(block: dict[str, np.ndarray], chunk: dict[str, np.ndarray], wanted: Callable[[int, np.ndarray, np.ndarray], np.ndarray], found: Callable[[int, np.ndarray, np.ndarray], None]) -> int:
    """Go down a block's tree with the bounds of a chunk; returns how many scores were computed.

    wanted(anchor, low, high): which candidates may lie in its window, by their bounds. found(anchor, rows, scores): gets the scores of those.
    """
    x, parent = chunk["vecs"], block["parent"]
    y = x.astype(float) if float(np.abs(x).max(initial=0)) * float(np.abs(block["vecs"]).max(initial=0)) * max(1, x.shape[1]) < 2.0**53 else None
    norm = np.sqrt((x.astype(float) ** 2).sum(1))
    longest = float(np.sqrt((block["vecs"].astype(float) ** 2).sum(1)).max(initial=0))
    slack = 1.0 + 1e-9 * longest * norm  # of rounding in lengths and bounds
    last = {p: k for k, p in enumerate(parent.tolist())}  # a parent's last child
    kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    scored = 0
    for k in range(len(parent)):
        a = block["vecs"][k]
        if k == 0:
            low, high, rows = np.empty(len(x)), np.empty(len(x)), np.arange(len(x))
        else:
            reach = block["edge"][k] * norm + slack
            p = int(parent[k])
            low, high = kept[p][0] - reach, kept[p][1] + reach
            rows = np.flatnonzero(wanted(k, low, high))
            if last[p] == k:
                del kept[p]
        if len(rows):
            scores = products(x[rows], a) if y is None else (y[rows] @ a.astype(float)).astype(np.int64)
            low[rows] = high[rows] = scores
            scored += len(rows)
            mine = rows[wanted(k, low, high)[rows]] if k == 0 else rows
            found(k, mine, scores[mine] if k == 0 else scores)
        if k in last:
            kept[k] = (low, high)
    return scored


def positives_in(block: dict[str, np.ndarray], chunks: list[dict[str, np.ndarray]], count: int = POSITIVES) -> tuple[list[Held], int]:
    """The first rows of each anchor's label among the chunks, and how many scores this took. Of the anchor's own row one less counts."""
    held = [Held(count) for _ in block["ids"]]
    scored = 0
    for c in chunks:
        label = {v: c["labels"] == v for v in np.unique(block["labels"]).tolist()}

        def wanted(k: int, low: np.ndarray, high: np.ndarray, of=label) -> np.ndarray:
            return of[int(block["labels"][k])] & (high >= held[k].least)

        def found(k: int, rows: np.ndarray, scores: np.ndarray, c=c) -> None:
            n = c["n"][rows]
            own = (c["ids"][rows] == block["ids"][k]) & (c["vecs"][rows] == block["vecs"][k]).all(1)
            held[k].add(scores, c["ids"][rows], n - own)

        scored += descend(block, c, wanted, found)
    return held, scored


def negatives_in(block: dict[str, np.ndarray], windows: list[list[tuple[int, int]]], chunks: list[dict[str, np.ndarray]], count: int = NEGATIVES) -> tuple[list[list[Held]], int]:
    """For each window (least and largest score) of each anchor the first rows of other labels among the chunks, and how many scores this took."""
    held = [[Held(count) for _ in w] for w in windows]
    scored = 0
    for c in chunks:
        other = {v: c["labels"] != v for v in np.unique(block["labels"]).tolist()}

        def wanted(k: int, low: np.ndarray, high: np.ndarray, of=other) -> np.ndarray:
            mask = np.zeros(len(low), bool)
            for (a, b), h in zip(windows[k], held[k], strict=True):
                mask |= (high >= max(a, h.least)) & (low <= b)
            return mask & of[int(block["labels"][k])]

        def found(k: int, rows: np.ndarray, scores: np.ndarray, c=c) -> None:
            for (a, b), h in zip(windows[k], held[k], strict=True):
                fit = (scores >= max(a, h.least)) & (scores <= b)
                if fit.any():
                    h.add(scores[fit], c["ids"][rows][fit], c["n"][rows][fit])

        scored += descend(block, c, wanted, found)
    return held, scored


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and largest score that low and high percent of a score allow; no score if the first is the larger."""
    return -(-low * score // 100), high * score // 100


def met(blocks: DataFrame, chunks: DataFrame, ranges: dict[int, tuple[int, int]], total: int, run: Callable, schema: str) -> DataFrame:
    """run(block row, chunks) for each block and each share of the chunks of its dimension."""
    many = sum(n for _, n in ranges.values())
    salts = max(1, min(total, max(-(-2 * blocks.sparkSession.sparkContext.defaultParallelism // max(1, many)), -(-total // TASK_CHUNKS))))
    first = F.create_map(*(F.lit(x) for d, (at, _) in ranges.items() for x in (d, at)))
    past = F.create_map(*(F.lit(x) for d, (at, n) in ranges.items() for x in (d, at + n - 1)))
    dealt = chunks.where(F.col("dims").isin(*ranges)).withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(salts)))
    dealt = dealt.withColumn("block", F.explode(F.sequence(first[F.col("dims")], past[F.col("dims")])))
    spread = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    names = [c.split()[0] for c in schema.split(", ")]

    def task(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in names})
        return pd.DataFrame(dict(zip(names, run(next(left.itertuples(index=False)), [opened(r, CANDIDATE) for r in right.itertuples(index=False)]), strict=True)))

    return spread.groupBy("block", "salt").cogroup(dealt.groupBy("block", "salt")).applyInPandas(task, schema)


def flat(blocks: int, each: list[tuple[tuple[int, ...], Held]]) -> list[np.ndarray]:
    """Columns: the block, what each Held is of, its scores and ids."""
    size = [len(h.scores) for _, h in each]
    keys = np.repeat(np.array([k for k, _ in each], np.int64).reshape(len(each), -1), size, axis=0)
    return [np.full(sum(size), blocks), *keys.T, *(np.concatenate([np.zeros(0, np.int64), *(getattr(h, c) for _, h in each)]) for c in ("scores", "ids"))]


def mine(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """SCHEMA: for each anchor and each of its positives the first negatives.

    rows: vec_id, label, vec (integers) and anchor (whether it is one); other columns are ignored, rows with a null vec_id, label or vec take no part.
    Positives are an anchor's first other rows of its label by score, ties by smaller id; negatives the first rows of other labels whose score lies
    between low and high percent of the positive's. A row that stands several times is as many rows: an anchor's other copies are
    positives of it, and each copy of an anchor or of a positive has its own rows in the result. Vectors meet only those of their own dimension. An anchor without positives, a
    positive without negatives in its window (as one of a score below zero), and an empty table have no rows in the result.
    """
    spark = rows.sparkSession
    whole = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull())
    whole = whole.groupBy(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "vec").agg(F.count("*").alias("n"), F.max(F.coalesce("anchor", F.lit(False))).alias("anchor"))
    stored = materialise(whole, "rows")
    blocks, ranges = blocks_of(stored.where("anchor").drop("anchor"), block)
    if not ranges:
        return spark.createDataFrame([], SCHEMA)
    chunks = materialise(chunks_of(stored, chunk), "chunks", **{"parquet.block.size": 16 << 20})
    total = chunks.count()

    def first(r, held: list[dict[str, np.ndarray]]) -> list[np.ndarray]:
        found, _ = positives_in(opened(r, ANCHOR), held, positives)
        return flat(r.block, [((k,), h) for k, h in enumerate(found)])

    each = met(blocks, chunks, ranges, total, first, "block int, k int, score long, id long")
    rank = F.row_number().over(W.partitionBy("block", "k").orderBy(F.col("score").desc(), "id"))
    each = each.withColumn("j", rank).where(F.col("j") <= positives)
    # a block's positives stand beside it: as many as its anchors times ``positives``
    listed = each.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("k", "j", "score", "id"))).alias("p"))
    ready = materialise(blocks.join(listed, "block"), "ready", **{"parquet.block.size": 16 << 20})

    def second(r, held: list[dict[str, np.ndarray]]) -> list[np.ndarray]:
        b = opened(r, ANCHOR)
        pairs: list[list[tuple[int, int, int]]] = [[] for _ in b["ids"]]
        for p in r.p:
            if low * p["score"] <= high * p["score"]:
                pairs[p["k"]].append((p["j"], p["score"], p["id"]))
        found, _ = negatives_in(b, [[window(s, low, high) for _, s, _ in of] for of in pairs], held, negatives)
        each = [((int(b["ids"][k]), int(b["n"][k]), k, j, i, s), h) for k, of in enumerate(pairs) for (j, s, i), h in zip(of, found[k], strict=True)]
        return flat(r.block, each) if each else [[]] * 9

    out = met(ready, chunks, ranges, total, second, "block int, anchor_id long, times long, k int, j int, positive_id long, positive_score long, negative_score long, negative_id long")
    rank = F.row_number().over(W.partitionBy("block", "k", "j").orderBy(F.col("negative_score").desc(), "negative_id"))
    out = out.withColumn("rank", rank).where(F.col("rank") <= negatives)
    again = F.when(F.col("times") == 1, F.array(F.lit(1).cast("long"))).otherwise(F.sequence(F.lit(1).cast("long"), "times"))
    return out.withColumn("_copy", F.explode(again)).select(*(c.split()[0] for c in SCHEMA.split(", ")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100; labels of ids divisible by 7 move on by one."""
    e = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(e.select("vec_id", label.alias("label"), "vec", (F.col("vec_id") % 100 == 0).alias("anchor")))


ORACLE_SQL = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS MATERIALIZED (SELECT a.i AS a, a.vec_id AS anchor_id, a.label = v.label AS same, v.i, v.vec_id, list_dot_product(a.e, v.e)::BIGINT AS score FROM v a JOIN v ON a.i <> v.i AND len(a.e) = len(v.e) WHERE a.vec_id % 100 = 0),
p AS MATERIALIZED (SELECT a, anchor_id, i AS p, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY a, p ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (a) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score QUALIFY rank <= {NEGATIVES}"""
