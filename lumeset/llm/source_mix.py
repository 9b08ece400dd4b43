"""Mixing sources to target weights by systematic sampling.

Each source gets a word target; a document's expected copies are target over source size. Within a
source the documents stand in an order; their expected copies are prefix-summed, one random offset is
added, and a document is emitted once for each integer boundary that its stretch of the sum crosses. As
the order follows size, every stretch of the sum holds documents of like size and the words taken come
near the target.

No source is ever gathered into one task: documents are dealt to cells (source, size bucket, salt), the
prefix sum runs over the small table of cell counts, and only a cell's rows are ranked together. The
number of salts follows the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from lumeset.llm.common import materialise, words_in

WEIGHTS = (5, 2, 1)  # in the order of source names, repeating
CEILING = 3  # a target is at most so many times its source
LEAST_SALTS, ROWS_A_SALT = 16, 1_000_000
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights=WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """Target words of each source.

    sizes: source, source_size (one row per source). Weights repeat over the sources in code point order, null
    last. The level L of sum(min(ceiling * size, weight * L)) = total is found over the sources ordered by the
    level at which each is full. One row per source meets in one task here; documents never do.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    full = F.col("source_size") * float(ceiling)
    by = W.orderBy("full_at", F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", w).withColumn("full_at", full / F.col("weight"))
    level = (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum(full).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing))
    ranked = ranked.withColumn("level", level)
    level = F.first(F.when(F.col("level") <= F.col("full_at"), F.col("level")), ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return ranked.select("source", "source_size", F.least(full, F.col("weight") * level).alias("target"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, ceiling: int = CEILING, seed: str = SEED, counted: DataFrame | None = None) -> DataFrame:
    """Copies that the mix takes of each document.

    docs: doc_id, source, size (words; null counts as 0), read four times: pass a stored table, or one of the same three
    columns as ``counted``, which is then read instead for all but the result. Documents of null source form a source
    of their own; repeated rows are documents of their own; a document of size 0 may be drawn and adds nothing; an empty table gives an
    empty result. Returns the three columns, source_size, target and copies, and ``doc`` if docs has a column of that name.
    """
    extra = [c for c in docs.columns if c == "doc"]
    # size buckets: bit length and the six bits after the first, so a 64th wide at most, and single sizes up to 127
    bucket = F.length(F.bin("size")) * 64 + F.expr("shiftright(size, greatest(length(bin(size)) - 7, 0))")
    salt = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    counted = docs if counted is None else counted
    n_salts = counted.agg(F.greatest(F.lit(LEAST_SALTS), F.ceil(F.count("*") / ROWS_A_SALT)).cast("long").alias("salts"))

    def deal(df: DataFrame, *more: str) -> DataFrame:
        df = df.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"), *more)
        df = df.withColumn("name", F.coalesce("source", F.lit(""))).withColumn("unnamed", F.col("source").isNull())
        return df.crossJoin(F.broadcast(n_salts)).withColumn("bucket", bucket).withColumn("salt", F.pmod(salt, "salts")).drop("salts")  # one row: a global aggregate

    sources = source_targets(counted.groupBy("source").agg(F.sum(F.coalesce("size", F.lit(0)).cast("long")).alias("source_size")), weights, ceiling)
    cells = ["name", "unnamed", "bucket", "salt"]
    before = F.coalesce(F.sum("n").over(W.partitionBy("name", "unnamed").orderBy("bucket", "salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = deal(counted).groupBy(*cells).agg(F.count("*").alias("n")).withColumn("before", before)
    sources = sources.select(
        F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("unnamed"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"), offset_of(F.col("source"), seed).alias("offset"),
    )
    starts = starts.join(sources, ["name", "unnamed"]).drop("n")
    # ranked and joined on the same keys, so rows are shuffled once
    ranked = deal(docs, *extra).withColumn("rn", F.row_number().over(W.partitionBy(*cells).orderBy("size", "doc_id"))).join(starts, cells)
    at = F.col("before") + F.col("rn")
    copies = F.floor(F.col("rate") * at + F.col("offset")) - F.floor(F.col("rate") * (at - 1) + F.col("offset"))
    return ranked.select("doc_id", "source", "size", "source_size", "target", F.least(copies, F.lit(ceiling)).cast("long").alias("copies"), *extra)


def take_mix(docs: DataFrame, weights=WEIGHTS, ceiling: int = CEILING, seed: str = SEED) -> DataFrame:
    """The documents of the mix with all their columns, a row for each copy taken."""
    sized = docs.select("doc_id", "source", words_in("text").alias("size"), F.struct(*docs.columns).alias("doc"))
    mixed = mix_sources(sized, weights, ceiling, seed, counted=materialise(sized.drop("doc"), "sizes"))  # texts are not stored again
    return mixed.where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc.*")


def offset_of(source, seed: str):
    """The source's random offset in [0, 1), a multiple of 2**-20."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(source, F.lit(""))).cast("binary")), 1, 5), 16, 10).cast("double") / 1048576.0


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix over all documents: words taken per document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", words_in("text").alias("size"))
    mixed = mix_sources(materialise(docs, "sizes"))  # texts are read once; three passes go over the sizes
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
s1 AS (SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s0),
s2 AS (SELECT *, source_size * 3.0::DOUBLE / weight AS full_at FROM s1),
s3 AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3.0::DOUBLE) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))::DOUBLE
    / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
lv AS (SELECT arg_min(level, full_at) AS level FROM s3 WHERE level <= full_at),
src AS (
  SELECT source, source_size, least(source_size * 3.0::DOUBLE, weight * lv.level) AS target,
    ('0x' || substr(md5('mix-1|' || coalesce(source, '')), 1, 5))::BIGINT::DOUBLE / 1048576.0::DOUBLE AS u FROM s3, lv),
dealt AS (
  SELECT *, length(bin(size)) * 64 + (size >> greatest(length(bin(size)) - 7, 0)) AS bucket,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % (SELECT greatest(16, ceil(count(*) / 1000000.0))::BIGINT FROM docs) AS salt FROM docs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY bucket, salt, size, doc_id) AS pos FROM dealt),
c AS (
  SELECT r.doc_id, r.size, s.source_size, s.target, CASE WHEN s.source_size > 0 THEN s.target / s.source_size ELSE 0.0::DOUBLE END AS rate, s.u, r.pos
  FROM ranked r JOIN src s ON r.source IS NOT DISTINCT FROM s.source),
k AS (SELECT *, least(floor(rate * pos + u) - floor(rate * (pos - 1) + u), 3)::BIGINT AS copies FROM c)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM k
"""
