"""Maximum inner product search by score-aware anisotropic quantisation.

Vectors fall into coarse cells (the nearest of some centroids); how many cells a query must look into is calibrated on a sample. A vector's
difference from its centroid, scaled to one length, is quantised in two-dimensional subspaces with 16 centres each, so a code is four bits.
Codebooks are learned under the anisotropic loss, which weighs the part of the residual that is parallel to the vector more than the rest,
as that part changes large inner products. What the four-bit codes leave is kept in eight bits a dimension.

Blocks of queries meet chunks of codes; vectors take no part in this. Tables of inner products with the centres are summed along the
codes for a tile of queries at once. Rows that may reach a query's k-th score within Z standard errors get a second score from the
eight-bit residual, which is off by at most the product of the query's length with that of the last residual. Only rows that this bound
leaves open, a few more than k, are fetched by id and scored in double precision. No number of candidates is fixed, so ties and dense
groups are never cut. The answer is approximate in two places: the cells that are not looked into, and the Z standard errors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from lumeset.llm.common import materialise

K = 20
CENTRES = 16
SUBSPACE = 2  # dimensions
SAMPLE = 8192  # rows that codebooks are learned on, at most
ROUNDS, SWEEPS = 6, 2
PARALLEL = 4.0  # weight of the parallel residual error against the other
CHUNK, TASK_CHUNKS = 8192, 64  # rows of a chunk of codes, and chunks that a task holds about
QUERY_BLOCK, TILE, SLICE = 32_768, 256, 1024  # queries in a task at most; queries and rows that are scanned at once
CELL_ROWS, CELLS = 4096, 1024  # vectors of a cell about; cells at most
COVERED = 0.97  # share of the sample's nearest that must lie in the cells looked into
Z = 3.0  # standard errors of a four-bit score


def clean(vectors: DataFrame, vec: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """vec_id and vec (doubles) of the rows that take part: not null or zero, all components finite, an id."""
    v = F.col(vec).cast("array<double>")
    kept = vectors.where(F.col(vec_id).isNotNull() & F.col(vec).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return kept.where(finite & F.exists("vec", lambda x: x != 0.0))


def encode(x: np.ndarray, books: np.ndarray, parallel: float = PARALLEL, sweeps: int = SWEEPS, along: np.ndarray | None = None) -> np.ndarray:
    """Codes of the rows of x: nearest centres, then sweeps over the subspaces that lower the anisotropic loss with the others held.

    along: the directions in which errors weigh more; those of x itself if not given.
    """
    n, m = len(x), len(books)
    along = x if along is None else along
    codes = np.empty((n, m), np.uint8)
    for s in range(0, n, 512):
        p = x[s : s + 512].reshape(-1, m, books.shape[2]).transpose(1, 0, 2)
        length = np.linalg.norm(along[s : s + 512], axis=1)
        u = (along[s : s + 512] / np.where(length > 0, length, 1.0)[:, None]).reshape(-1, m, books.shape[2]).transpose(1, 0, 2)
        turned = books.transpose(0, 2, 1)
        far = (books**2).sum(2)[:, None] - 2.0 * (p @ turned)  # squared distances of all centres, less what they share
        part = (p * u).sum(2)[:, :, None] - u @ turned  # products of the residuals with the direction
        rows = np.arange(p.shape[1])
        code = far.argmin(2)
        inner = np.take_along_axis(part, code[:, :, None], 2)[:, :, 0]
        total = inner.sum(0)
        for _ in range(sweeps):
            for j in range(m):
                rest = total - inner[j]
                code[j] = (far[j] + (parallel - 1.0) * (rest[:, None] + part[j]) ** 2).argmin(1)
                inner[j] = part[j][rows, code[j]]
                total = rest + inner[j]
        codes[s : s + 512] = code.T
    return codes


def learn(x: np.ndarray, centres: int = CENTRES, subspace: int = SUBSPACE, parallel: float = PARALLEL, rounds: int = ROUNDS, seed: int = 1, along: np.ndarray | None = None) -> np.ndarray:
    """Codebooks (subspaces, centres, dimensions): codes and centres in turn; the centres solve the least squares of the anisotropic loss."""
    n, dims = x.shape
    m = dims // subspace
    rng = np.random.default_rng(seed)
    parts = x.reshape(n, m, subspace)
    books = np.stack([parts[rng.choice(n, centres, replace=n < centres), j] for j in range(m)])
    for _ in range(4):  # start from plain k-means
        for j in range(m):
            code = ((parts[:, j, None, :] - books[j][None]) ** 2).sum(2).argmin(1)
            count = np.bincount(code, minlength=centres)
            for d in range(subspace):
                books[j][count > 0, d] = (np.bincount(code, weights=parts[:, j, d], minlength=centres) / np.maximum(count, 1))[count > 0]
    along = x if along is None else along
    length = np.linalg.norm(along, axis=1)
    unit = along / np.where(length > 0, length, 1.0)[:, None]
    size = m * centres * subspace
    for _ in range(rounds):
        codes = encode(x, books, parallel, along=along)
        slot = ((np.arange(m)[None] * centres + codes)[:, :, None] * subspace + np.arange(subspace)).reshape(n, -1)
        a, rhs = np.zeros((size, size)), np.zeros(size)
        for s in range(0, n, 2048):  # the products with the unit vectors, spread to the slots of each vector's centres
            at, u, v = slot[s : s + 2048], unit[s : s + 2048], x[s : s + 2048]
            spread = np.zeros((len(at), size))
            np.put_along_axis(spread, at, u, 1)
            a += (parallel - 1.0) * spread.T @ spread
            rhs += np.bincount(at.ravel(), weights=(v + (parallel - 1.0) * (v * u).sum(1)[:, None] * u).ravel(), minlength=size)
        a[np.diag_indices(size)] += np.bincount(slot.ravel(), minlength=size) + 1e-9
        solved = np.linalg.solve(a, rhs).reshape(m, centres, subspace)
        used = np.bincount((np.arange(m)[None] * centres + codes).ravel(), minlength=m * centres).reshape(m, centres) > 0
        books[used] = solved[used]
    return books


def nearest_cell(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(1)[None] - 2.0 * (x @ centroids.T)).argmin(1)


def cells_of(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 2) -> np.ndarray:
    """Centroids of a sample by k-means from random rows, so that dense places get their share of them."""
    centroids = x[np.random.default_rng(seed).choice(len(x), cells, replace=False)].copy()
    for _ in range(rounds if cells > 1 else 1):
        cell = nearest_cell(x, centroids)
        count = np.bincount(cell, minlength=cells)
        for d in range(x.shape[1]):
            centroids[count > 0, d] = (np.bincount(cell, weights=x[:, d], minlength=cells) / np.maximum(count, 1))[count > 0]
    return centroids


def chained(centroids: np.ndarray) -> np.ndarray:
    """Place of each centroid in a walk that goes on to the nearest one not yet visited."""
    place, at = np.zeros(len(centroids), int), 0
    left = np.ones(len(centroids), bool)
    for k in range(len(centroids)):
        place[at], left[at] = k, False
        far = ((centroids - centroids[at]) ** 2).sum(1)
        at = int(np.where(left, far, np.inf).argmin())
    return place


def probes_needed(x: np.ndarray, centroids: np.ndarray, k: int, covered: float = COVERED, asked: int = 512) -> int:
    """Cells, best products first, that hold the given share of the k nearest of some of the rows of x among all of them."""
    if len(centroids) == 1:
        return 1
    q = x[:asked]
    score = q @ x.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    best = np.argsort(-score, axis=1)[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-(q @ centroids.T), axis=1), axis=1)
    at = np.take_along_axis(place, nearest_cell(x, centroids)[best], 1)
    return int(np.quantile(at, covered, method="higher")) + 1


class Quantiser:
    """Centroids, codebooks and the number of cells to look into; learned from a sample, the same for every task."""

    def __init__(self, sample: np.ndarray, n: int, k: int, cell_rows: int = CELL_ROWS):
        self.dims = sample.shape[1]
        self.centroids = cells_of(sample, max(1, min(CELLS, n // cell_rows, len(sample) // 8)))
        self.probes = probes_needed(sample, self.centroids, k)
        y, scale = self.scaled(sample, nearest_cell(sample, self.centroids))
        seen = scale > 0
        self.books = learn(y[seen] if seen.any() else sample, subspace=SUBSPACE if self.dims % SUBSPACE == 0 else 1, along=sample[seen] if seen.any() else None)

    def scaled(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Differences from the centroids, at length sqrt(dims), and what to multiply them with."""
        y = x - self.centroids[cell]
        scale = np.linalg.norm(y, axis=1) / np.sqrt(self.dims)
        return y / np.where(scale > 0, scale, 1.0)[:, None], scale

    def encoded(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """cell, codes (n, subspaces), fine (n, dims; int8), scale, step (of fine), error and rest (lengths of the residuals after codes and after fine)."""
        cell = nearest_cell(x, self.centroids)
        y, scale = self.scaled(x, cell)
        codes = encode(y, self.books, along=x)
        left = y - self.books[np.arange(len(self.books)), codes].reshape(len(x), -1)
        step = np.abs(left).max(1) / 127.0
        fine = np.rint(left / np.where(step > 0, step, 1.0)[:, None]).astype(np.int8)
        scale, step = scale.astype("<f4"), step.astype("<f4")
        made = self.centroids[cell] + scale[:, None].astype(float) * (self.books[np.arange(len(self.books)), codes].reshape(len(x), -1) + step[:, None].astype(float) * fine)
        rest = np.linalg.norm(x - made, axis=1) + 1e-6 * (np.linalg.norm(x, axis=1) + np.linalg.norm(self.centroids[cell], axis=1))  # and rounding in single precision
        return {"cell": cell, "codes": codes, "fine": fine, "scale": scale, "step": step, "error": (scale * np.linalg.norm(left, axis=1)).astype("<f4"), "rest": np.nextafter(rest.astype("<f4"), np.float32(np.inf))}

    def scan(self, q: np.ndarray, own: np.ndarray, chunks: list[dict], k: int, z: float = Z) -> tuple[np.ndarray, ...]:
        """(query row, row id, row hash, least score, most score) of all rows that may be among the k nearest of the queries q; chunks: what ``encoded`` gives, and ids and hashes."""
        m, nq = len(self.books), len(q)
        products = np.einsum("jcs,njs->jcn", self.books, q.reshape(nq, m, -1)).astype(np.float32)
        tables = [(products[j][:, None] + products[j + 1][None]).reshape(256, nq) if j + 1 < m else products[j] for j in range(0, m, 2)]  # of two codes at once
        length = np.linalg.norm(q, axis=1).astype(np.float32)
        to_cells = q @ self.centroids.T
        looked = np.zeros(to_cells.shape, bool)
        np.put_along_axis(looked, np.argpartition(-to_cells, self.probes - 1, axis=1)[:, : self.probes], True, axis=1)
        least = np.full(nq, -np.inf, np.float32)  # a bound below each query's k-th score
        sums, terms = np.empty((SLICE, nq), np.float32), np.empty((SLICE, nq), np.float32)
        found = [[np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]]

        def kept_of(found: list[list[np.ndarray]]) -> list[np.ndarray]:
            """What has been found so far, less what cannot reach the k-th; raises the bound."""
            held = [np.concatenate(x) for x in zip(*found, strict=True)]
            order = np.lexsort((-held[3], held[0]))
            held = [x[order] for x in held]
            start = np.searchsorted(held[0], np.arange(nq))
            full = np.bincount(held[0], minlength=nq) >= k
            least[full] = np.nextafter(held[3][start[full] + k - 1].astype(np.float32), np.float32(-np.inf))
            stay = held[4] >= least[held[0]]
            return [x[stay] for x in held]

        for c in chunks:
            asks = looked[:, c["cell"]]
            if not asks.any():
                continue
            pairs = [c["codes"][:, j].astype(np.intp) * 16 + c["codes"][:, j + 1] if j + 1 < m else c["codes"][:, j].astype(np.intp) for j in range(0, m, 2)]
            mine = np.where(asks, 0.0, np.inf).astype(np.float32)
            shift = to_cells[:, c["cell"]].astype(np.float32)
            for s in range(0, len(c["ids"]), SLICE):
                part = slice(s, s + SLICE)
                rough, term = sums[: len(c["ids"][part])], terms[: len(c["ids"][part])]
                np.take(tables[0], pairs[0][part], axis=0, out=rough, mode="clip")
                for table, pair in zip(tables[1:], pairs[1:], strict=True):
                    np.take(table, pair[part], axis=0, out=term, mode="clip")
                    rough += term
                rough *= c["scale"][part, None]
                rough += shift
                width = z / np.sqrt(self.dims) * c["error"][part]
                bound = least
                if len(rough) >= k and np.isneginf(least).any():  # as yet only the k-th of these rows is known, roughly
                    rough[c["ids"][part][:, None] == own] = -np.inf
                    bound = np.maximum(least, np.partition(rough, len(rough) - k, axis=0)[len(rough) - k] - length * width.max())
                at, of = np.nonzero(rough >= bound - length * width.max() + mine)
                open_ = (rough[at, of] + length[of] * width[at] >= bound[of]) & (c["ids"][s + at] != own[of])
                at, of = at[open_], of[open_]
                row = s + at
                score = rough[at, of] + (c["scale"] * c["step"])[row] * np.einsum("nd,nd->n", c["fine"][row].astype(float), q[of])
                slack = length[of] * c["rest"][row].astype(float)
                found.append([of, c["ids"][row], c["hashes"][row], score - slack, score + slack])
                if sum(len(f[0]) for f in found[1:]) > k * nq:
                    found = [kept_of(found)]
        return tuple(kept_of(found))


def packed(df: DataFrame, block: str, name: str) -> DataFrame:
    """One row per block: its ids in ascending order and its vectors, as bytes. df: vec_id, vec and the block, of bounded size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        x = np.stack(pdf["vec"].to_numpy()).astype("<f8")
        return pd.DataFrame({block: [pdf[block].iloc[0]], f"{name}_ids": [pdf["vec_id"].to_numpy("<i8").tobytes()], f"{name}_vecs": [x.tobytes()]})

    return df.groupBy(block).applyInPandas(run, f"{block} long, {name}_ids binary, {name}_vecs binary")


CODE_FIELDS = {"ids": "<i8", "hashes": "<i8", "codes": "u1", "fine": "i1", "scale": "<f4", "step": "<f4", "error": "<f4", "rest": "<f4"}
CODE_SCHEMA = "vec_id long, hash long, cell int, codes binary, fine binary, scale float, step float, error float, rest float"
FOUND_SCHEMA = "query_row long, vec_id long, hash long, low double, high double"


def encoded_rows(vectors: DataFrame, quantiser) -> DataFrame:
    """CODE_SCHEMA of vectors (vec_id, hash, vec); quantiser: a broadcast one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), 4096):
                f = b.iloc[s : s + 4096]
                e = quantiser.value.encoded(np.stack(f["vec"].to_numpy()).astype(float))
                yield pd.DataFrame({"vec_id": f["vec_id"].to_numpy(), "hash": f["hash"].to_numpy()} | {c: [r.tobytes() for r in e[c]] if e[c].ndim > 1 else e[c] for c in ("cell", "codes", "fine", "scale", "step", "error", "rest")})

    return vectors.mapInPandas(run, CODE_SCHEMA)


def chunked(codes: DataFrame, sizes: dict[int, int], chunk: int) -> DataFrame:
    """One row a chunk: its number, its cell and the columns of CODE_FIELDS as bytes. sizes: rows of each cell."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        flat = {"ids": f["vec_id"], "hashes": f["hash"]} | {c: f[c] for c in CODE_FIELDS if c in f}
        return pd.DataFrame({"chunk": [f["chunk"].iloc[0]], "cell": [f["cell"].iloc[0]]} | {c: [b"".join(x) if x.dtype == object else x.to_numpy(CODE_FIELDS[c]).tobytes()] for c, x in flat.items()})

    first, at = {}, 0
    for cell in sorted(sizes):
        first[cell] = at
        at += -(-sizes[cell] // chunk)
    table = F.create_map(*(F.lit(x) for cell in first for x in (cell, first[cell])))
    many = F.create_map(*(F.lit(x) for cell in first for x in (cell, -(-sizes[cell] // chunk))))
    number = table[F.col("cell")] + F.pmod(F.xxhash64("vec_id", "hash"), many[F.col("cell")].cast("long"))
    return codes.withColumn("chunk", number).groupBy("chunk").applyInPandas(run, "chunk long, cell int, " + ", ".join(f"{c} binary" for c in CODE_FIELDS))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, chunk: int = CHUNK, query_block: int = QUERY_BLOCK, sample: int = SAMPLE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k vectors with the largest inner product with each query.

    vectors and queries: vec_id, vec as ``clean`` gives them, all of one dimension (raises if they differ); other columns are ignored. A row of the
    query's own id is no candidate. A row that stands several times counts once as a candidate, and is answered each time as a query; rows of one id with
    different vectors are rows of their own. Ties go to the smaller id. With fewer candidates than k all are returned, with none the query has no rows; an
    empty table gives an empty result.
    """
    spark = vectors.sparkSession
    n, least, most = vectors.agg(F.count("*"), F.min(F.size("vec")), F.max(F.size("vec"))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    if least != most:
        raise ValueError(f"vectors have {least} to {most} dimensions")
    # of equal vectors only the k + 1 smallest ids can be in an answer
    of_vector = F.row_number().over(W.partitionBy("vec").orderBy("vec_id"))
    stored = vectors.select("vec_id", "vec").distinct().withColumn("_n", of_vector).where(F.col("_n") <= k + 1).select("vec_id", F.xxhash64("vec").alias("hash"), "vec")
    stored = materialise(stored, "stored")
    chosen = stored.orderBy(F.xxhash64("vec_id", "hash"), "vec_id").limit(sample).select("vec").collect()  # at most ``sample`` rows
    quantiser = spark.sparkContext.broadcast(Quantiser(np.asarray([r["vec"] for r in chosen], float), n, k, cell_rows))
    centroids = quantiser.value.centroids
    codes = materialise(encoded_rows(stored, quantiser), "codes")
    sizes = {r["cell"]: r["n"] for r in codes.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most CELLS rows
    chunks = materialise(chunked(codes, sizes, chunk), "chunks", **{"parquet.block.size": 16 << 20})
    total = sum(-(-size // chunk) for size in sizes.values())

    # queries of cells near each other share a block, so that it looks into few cells
    place = chained(centroids)

    @F.pandas_udf("long")
    def home(vec: pd.Series) -> pd.Series:
        return pd.Series(place[nearest_cell(np.stack(vec.to_numpy()).astype(float), quantiser.value.centroids)] if len(vec) else [], dtype="int64")

    asked = materialise(queries.select("vec_id", "vec", home("vec").alias("home")), "asked")
    homes = {r["home"]: r["n"] for r in asked.groupBy("home").agg(F.count("*").alias("n")).orderBy("home").collect()}  # at most CELLS rows
    if not homes:
        return spark.createDataFrame([], schema)
    first, many, block, held = [], [], 0, 0
    for cell, size in homes.items():
        if held and held + size > query_block:
            block, held = block + 1, 0
        parts = -(-size // query_block)
        first += [F.lit(cell), F.lit(block)]
        many += [F.lit(cell), F.lit(parts)]
        block, held = (block + parts, 0) if parts > 1 else (block, held + size)
    number = F.create_map(*first)[F.col("home")] + F.pmod(F.xxhash64("vec_id", "vec"), F.create_map(*many)[F.col("home")].cast("long"))
    blocks = materialise(packed(asked.withColumn("q", number.cast("long")), "q", "q"), "queries", **{"parquet.block.size": 16 << 20})

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The queries of a block again, with row numbers."""
        for b in batches:
            for r in b.itertuples(index=False):
                ids = np.frombuffer(r.q_ids, "<i8")
                yield pd.DataFrame({"query_row": (r.q << 32) + np.arange(len(ids)), "query_id": ids, "query": list(np.frombuffer(r.q_vecs, "<f8").reshape(len(ids), -1))})

    def cells_asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = quantiser.value
        for b in batches:
            for r in b.itertuples(index=False):
                best = np.argpartition(-(np.frombuffer(r.q_vecs, "<f8").reshape(-1, of.dims) @ of.centroids.T), of.probes - 1, axis=1)[:, : of.probes]
                yield pd.DataFrame({"q": r.q, "cell": np.unique(best).astype(np.int32)})

    # a task holds one block of queries and some chunks; codes go only to the blocks that ask for their cell
    salts = min(total, max(spark.sparkContext.defaultParallelism, -(-total // TASK_CHUNKS)))
    dealt = chunks.join(blocks.mapInPandas(cells_asked, "q long, cell int"), "cell").withColumn("salt", F.pmod("chunk", F.lit(salts)))
    spread = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        of, out = quantiser.value, []
        if len(left) and len(right):
            rows = []
            for r in right.itertuples(index=False):
                c = {x: np.frombuffer(getattr(r, x), kind) for x, kind in CODE_FIELDS.items()} | {"cell": r.cell}
                rows.append(c | {"codes": c["codes"].reshape(len(c["ids"]), -1), "fine": c["fine"].reshape(len(c["ids"]), -1)})
            ids = np.frombuffer(left["q_ids"].iloc[0], "<i8")
            q = np.frombuffer(left["q_vecs"].iloc[0], "<f8").reshape(len(ids), -1)
            for s in range(0, len(ids), TILE):
                at, *found = of.scan(q[s : s + TILE], ids[s : s + TILE], rows, k)
                out.append(pd.DataFrame(dict(zip(("query_row", "vec_id", "hash", "low", "high"), ((int(left["q"].iloc[0]) << 32) + s + at, *found), strict=True))))
        return pd.concat(out) if out else pd.DataFrame({x.split()[0]: [] for x in FOUND_SCHEMA.split(", ")})

    found = spread.groupBy("q", "salt").cogroup(dealt.groupBy("q", "salt")).applyInPandas(search, FOUND_SCHEMA)
    # what the bounds leave open over all tasks
    of_query = W.partitionBy("query_row")
    kth = F.max(F.when(F.col("_n") == k, F.col("low"))).over(of_query)
    found = found.withColumn("_n", F.row_number().over(of_query.orderBy(F.desc("low")))).withColumn("_least", kth)
    found = materialise(found.where(F.col("_least").isNull() | (F.col("high") >= F.col("_least"))).select("query_row", "vec_id", "hash"), "found")
    product = F.aggregate(F.zip_with("vec", "query", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    scored = found.join(stored, ["vec_id", "hash"]).join(blocks.mapInPandas(pieces, "query_row long, query_id long, query array<double>"), "query_row").select("query_row", "query_id", "vec_id", product.alias("score"))
    rank = F.row_number().over(of_query.orderBy(F.col("score").desc(), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    vectors = materialise(clean(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vectors")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
