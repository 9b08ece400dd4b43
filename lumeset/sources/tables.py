"""Frames, candidates and scenes from the stored tables.

The expressions below are Spark SQL and DuckDB SQL alike, so a query and its counterpart start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumeset.functions.vectors import sign_hash

#: Columns of a frame from a row of lineitem
FRAME = {
    "k1": "l_orderkey", "k2": "l_partkey", "k3": "l_suppkey", "k4": "l_linenumber", "k5": "CAST(round(l_extendedprice * 100.0) AS BIGINT)",
    "brightness": "l_extendedprice - 256.0 * floor(l_extendedprice / 256.0)",
    "contrast": "l_quantity * 1.6",
    "edge_density": "l_discount * 3.0 + l_tax",
    "action_intensity": "CAST(l_partkey % 60 AS DOUBLE)",
    "luminance_entropy": "CAST(l_suppkey % 50 AS DOUBLE) / 10.0",
    "luminance_range": "CAST(l_orderkey % 180 AS DOUBLE)",
    "near_black_ratio": "CAST(l_partkey % 101 AS DOUBLE) / 100.0",
    "near_white_ratio": "(1.0 - CAST(l_partkey % 101 AS DOUBLE) / 100.0) * CAST(l_orderkey % 103 AS DOUBLE) / 103.0",
    "dominant_tone_ratio": "CAST(l_suppkey % 97 AS DOUBLE) / 97.0",
    "blur_score": "l_extendedprice / 100.0",
    "color_richness": "CAST(l_partkey % 90 AS DOUBLE)",
    "ui_density": "CAST(l_orderkey % 40 AS DOUBLE)",
    "visual_balance": "CAST(l_suppkey % 101 AS DOUBLE)",
    "dramatic_score": "CAST(l_linenumber AS DOUBLE) * 13.0",
    "menu_layout": "l_tax * 5.0", "title_layout": "l_discount * 4.0", "game_over_layout": "CAST(l_partkey % 10 AS DOUBLE) / 10.0",
}
#: Columns of a candidate from an event: the user is the run, the event's kind its source
CANDIDATE = {
    "run": "user_id", "key": "event_id", "ord": "event_id", "ts": "CAST(epoch_us AS DOUBLE) / 1000000.0", "score": "least(100.0, value)",
    "source": "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END",
    "scene": "CASE event_id % 7 WHEN 0 THEN 'Title' WHEN 1 THEN 'World map' WHEN 2 THEN 'Menu' WHEN 3 THEN 'Inventory' ELSE concat('Scene ', CAST(event_id % 5 AS STRING)) END",
    "is_transition": "event_id % 9 = 0", "value": "value", "event_type": "event_type", "props": "props", "features_id": "event_id",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out to all cores if it is read in fewer parts than there are cores, as a small table is; a large one is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*(F.expr(e).alias(c) for c, e in FRAME.items()))


def candidates(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    """Events as candidates, each with the hash (and the vector) of the embedding that its id names in turn."""
    events = table(spark, sf_dir, "events").withColumn("epoch_us", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")).select(*(F.expr(e).alias(c) for c, e in CANDIDATE.items()))
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", sign_hash(F.col("embedding")).alias("h"), *(["embedding"] if vectors else []))
    n = vecs.agg(F.count("*").alias("n_vectors"))
    events = events.crossJoin(F.broadcast(n)).withColumn("vec_id", F.col("features_id") % F.col("n_vectors"))  # one row: a global aggregate
    return events.join(vecs, "vec_id").drop("n_vectors", "features_id", "vec_id").withColumnsRenamed({"embedding": "features"} if vectors else {})
