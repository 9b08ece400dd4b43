"""Verified outputs: digests, manifests, reports and checked writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_HASH_BITS = 10  # an output may differ from its candidate by so many bits


def digest(*columns: str) -> Column:
    """SHA-256 of the columns in one fixed JSON form: sorted by name, nulls left out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """path, size, sha256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def verify(expected: DataFrame, found: DataFrame, root: str) -> DataFrame:
    """path, fault of artifacts that are missing, differ in size or digest, or lie outside the root; empty if all is as recorded."""
    e, f = expected.alias("e"), found.alias("f")
    fault = (
        F.when(~F.regexp_replace("e.path", "^file:/+", "/").startswith(root.rstrip("/") + "/"), "outside").when(F.col("f.path").isNull(), "missing")
        .when(F.col("e.size") != F.col("f.size"), "size").when(F.col("e.sha256") != F.col("f.sha256"), "digest")
    )
    joined = e.join(f, F.regexp_replace("e.path", "^file:/+", "/") == F.regexp_replace("f.path", "^file:/+", "/"), "left")
    return joined.select(F.col("e.path").alias("path"), fault.alias("fault")).where("fault is not null")


def checked(df: DataFrame, distance: Column, most: int = MOST_HASH_BITS) -> DataFrame:
    """df, which fails when it is read, whichever columns are, if an output lies too far from its candidate."""
    return df.where(F.when(distance > most, F.raise_error(F.lit("an output differs from its candidate")).cast("boolean")).otherwise(True))


def unchanged(df: DataFrame, before: DataFrame, after: DataFrame, path: str = "path") -> DataFrame:
    """Rows of df whose file has one version (path, mtime, size) before and after it was analysed: what a cache may keep."""
    same = before.join(after, [path, "mtime", "size"], "left_semi").select(path)
    return df.join(same, path, "left_semi")


#: Fields of a candidate in an image report, and of the report before its two lists
REPORT_CANDIDATE = ("path", "scene_slug", "scene_display_name", "scene_description", "scene_selection_role", "scene_confidence", "quality_score", "selection_score", "score_band", "variant_group", "outlier_rejected")
REPORT_HEAD = (
    "scene_distribution", "scene_mix_target", "scene_mix_actual", "scene_catalog", "ollama_catalog_fallback_used", "ollama_catalog_fallback_reason", "ollama_classification_failed",
    "ollama_classification_failure_rate", "threshold_relaxation_steps", "rejected_by_content_filter", "rejected_by_selection_shortlist", "content_filter_breakdown", "whole_input_profile",
)


def image_report(head: DataFrame, candidates: DataFrame, run: str) -> DataFrame:
    """run and ``report``: the JSON report of each run.

    head: run and REPORT_HEAD, one row a run (absent fields are null). candidates: run, place, selected, output_path and REPORT_CANDIDATE; a run holds at most as
    many as its candidate cap. Selected and rejected ones stand by place; a field without a value is null, but output_path is left out.
    """
    whole = {"ignoreNullFields": "false"}
    entry = F.to_json(F.struct(*REPORT_CANDIDATE), whole)
    entry = F.when(F.col("output_path").isNull(), entry).otherwise(F.concat(F.expr("substring(entry, 1, length(entry) - 1)"), F.lit(","), F.expr("substring(to_json(struct(output_path)), 2)")))
    rows = candidates.withColumn("entry", F.to_json(F.struct(*REPORT_CANDIDATE), whole)).select(run, "selected", F.struct("place", entry.alias("e")).alias("x"))
    listed = lambda keep: F.concat(F.lit("["), F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.when(keep, F.col("x")))), lambda x: x["e"])), F.lit("]"))
    lists = rows.groupBy(run).agg(listed(F.col("selected")).alias("_selected"), listed(~F.col("selected")).alias("_rejected"))
    fields = [F.col(c) if c in head.columns else F.lit(None).cast("string").alias(c) for c in REPORT_HEAD]
    top = head.select(run, F.to_json(F.struct(*fields), whole).alias("_head")).join(lists, run, "left")
    part = lambda c: F.coalesce(c, F.lit("[]"))
    return top.select(run, F.concat(F.expr("substring(_head, 1, length(_head) - 1)"), F.lit(',"selected":'), part("_selected"), F.lit(',"rejected":'), part("_rejected"), F.lit("}")).alias("report"))


def sheet_layout(df: DataFrame, order: str, columns: int = 3, width: int = 480, height: int = 270) -> DataFrame:
    """Add x and y of each row's thumbnail on a sheet, rows numbered by ``order`` from 1."""
    i = F.col(order) - 1
    return df.withColumn("x", F.pmod(i, F.lit(columns)) * width).withColumn("y", F.floor(i / columns) * height)
