"""What may be used again: stored analyses by file version, and runs by the manifest of their inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumeset.session import materialise

LEAF, DEEPEST = 256, 8  # inputs of a slice, about; levels of a tree


def version_key(version: int, analyzer: str) -> Column:
    """Key of a stored analysis: format version, file version (path, mtime, size) and the analyser's fingerprint."""
    return F.sha2(F.to_json(F.struct(F.lit(version).alias("version"), "path", "mtime", "size", F.lit(analyzer).alias("analyzer"))), 256)


def read_cached(files: DataFrame, cache: DataFrame, version: int, analyzer: str) -> DataFrame:
    """files (path, mtime, size) with the payload columns of the cache (cache_key, path, ...) and ``hit``; an entry of another path is no hit."""
    payload = [c for c in cache.columns if c not in ("cache_key", "path")]
    entries = cache.withColumn("hit", F.lit(True)).dropDuplicates(["cache_key", "path"])
    return files.withColumn("cache_key", version_key(version, analyzer)).join(entries, ["cache_key", "path"], "left").select("path", *payload, F.coalesce("hit", F.lit(False)).alias("hit"))


def write_cached(df: DataFrame, version: int, analyzer: str) -> DataFrame:
    """Entries (cache_key, path, payload) of analysed rows with path, mtime and size."""
    return df.withColumn("cache_key", version_key(version, analyzer)).drop("mtime", "size")


def depth_of(n: Column, leaf: int) -> Column:
    """Levels of sixteen that leave no more than about ``leaf`` inputs in a slice."""
    out = F.lit(0)
    for k in range(1, DEEPEST + 1):
        out = F.when(n > leaf * 16 ** (k - 1), k).otherwise(out)
    return out


def manifest_tree(inputs: DataFrame, run: str, settings: str, leaf: int = LEAF) -> DataFrame:
    """run, prefix, digest, n: the Merkle tree of each run's inputs. inputs: run and ``input_digest``.

    A slice holds the inputs whose digests begin alike, about ``leaf`` of them; its digest is that of its inputs' in order. Up to sixteen slices make one of
    the level above; the root (an empty prefix) is hashed with the settings. Inputs that stand several times count once, with their number; n is how many different ones
    a slice has. So no row ever lists a run's inputs, and two trees show by their slices where they differ.
    """
    one = F.sha2(F.concat_ws("*", "input_digest", F.col("_times").cast("string")), 256)
    each = inputs.groupBy(run, "input_digest").agg(F.count("*").alias("_times")).select(run, one.alias("_d"))
    depths = each.groupBy(F.col(run).alias("_run")).agg(depth_of(F.count("*"), leaf).alias("_depth"))
    placed = each.join(depths, F.col(run).eqNullSafe(F.col("_run"))).select(run, "_d", "_depth").withColumn("prefix", F.expr("substring(_d, 1, _depth)"))
    top = lambda x: F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(x))), 256)  # noqa: E731  at most sixteen, or about ``leaf``
    nodes = materialise(placed.groupBy(run, "prefix").agg(top("_d").alias("digest"), F.count("*").alias("n")), "slices")
    deepest = nodes.agg(F.max(F.length("prefix"))).first()[0] or 0
    levels, level = [], nodes.where(F.length("prefix") == deepest)
    for k in range(deepest, 0, -1):
        levels.append(level)
        above = level.groupBy(run, F.expr(f"substring(prefix, 1, {k - 1})").alias("prefix")).agg(top(F.concat(F.substring("prefix", k, 1), F.lit(":"), "digest")).alias("digest"), F.sum("n").alias("n"))
        level = above.union(nodes.where(F.length("prefix") == k - 1))
    levels.append(level.withColumn("digest", F.sha2(F.concat(F.lit(f"{settings}|"), "digest"), 256)))
    return reduce(DataFrame.union, levels)


def manifests(inputs: DataFrame, run: str, settings: str, leaf: int = LEAF) -> DataFrame:
    """run and ``digest``: the roots of ``manifest_tree``, of the run's inputs and the settings."""
    return manifest_tree(inputs, run, settings, leaf).where("prefix = ''").select(run, "digest")


def changed_slices(now: DataFrame, before: DataFrame, run: str) -> DataFrame:
    """run, prefix, state (new, gone or changed) of the finest slices that both trees have, where they differ. now, before: as ``manifest_tree`` gives them."""
    depth = lambda t, name: t.groupBy(F.col(run).alias("_run")).agg(F.max(F.length("prefix")).alias(name))
    a, b = depth(now, "_a"), depth(before, "_b").withColumnRenamed("_run", "_other")
    level = a.join(b, F.col("_run").eqNullSafe(F.col("_other")), "full").select(F.coalesce("_run", "_other").alias("_run"), F.least("_a", "_b").alias("_level"))
    finest = lambda t, names: t.join(level, F.col(run).eqNullSafe(F.col("_run"))).where(F.length("prefix") == F.col("_level")).select(run, "prefix", "digest").toDF(*names)
    x, y = finest(now, [run, "prefix", "digest"]), finest(before, ["_run", "_prefix", "_digest"])
    met = x.join(y, F.col(run).eqNullSafe(F.col("_run")) & (F.col("prefix") == F.col("_prefix")), "full")
    state = F.when(F.col("_digest").isNull(), "new").when(F.col("digest").isNull(), "gone").when(F.col("digest") != F.col("_digest"), "changed")
    return met.select(F.coalesce(F.col(run), F.col("_run")).alias(run), F.coalesce("prefix", "_prefix").alias("prefix"), state.alias("state")).where("state is not null")


def resume_states(wanted: DataFrame, stored: DataFrame, run: str, strict: bool = False) -> DataFrame:
    """run, state: new, resume (stored with the same manifest), or changed; a changed run is an error if strict. wanted, stored: run, digest."""
    kept = stored.select(run, F.col("digest").alias("_kept"))
    changed = F.raise_error(F.concat(F.lit("its inputs or settings have changed: "), F.col(run).cast("string"))).cast("string") if strict else F.lit("changed")
    return wanted.join(kept, run, "left").select(run, F.when(F.col("_kept").isNull(), "new").when(F.col("_kept") == F.col("digest"), "resume").otherwise(changed).alias("state"))
