"""Batched scoring by an external model, with resume, retries and backfill.

A scorer is any callable that takes a pandas frame of candidates and returns one with key, blog_score, is_transition, scene and
reason. It runs in the tasks, on batches; what it returned is appended to a state folder, so a later run asks only for what is missing.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "key long, blog_score double, is_transition boolean, scene string, reason string"
TRIES, WAIT = 3, 1.0
Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def cache_key(model: str, prompt: str, context: str) -> str:
    """What the stored assessments depend on besides the candidate."""
    import hashlib

    return hashlib.sha256("\0".join((model, prompt, context)).encode()).hexdigest()[:16]


def checked_reply(asked: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
    """The reply, if it is about exactly the rows asked about; of repeated rows that agree, one."""
    got = got.drop_duplicates()
    if sorted(got["key"]) != sorted(asked["key"]):
        raise ValueError("a reply has other ids than were asked for, or two that differ")
    if not got["blog_score"].between(0, 100).all():
        raise ValueError("a score is not between 0 and 100")
    return got.assign(scene=got["scene"].str.slice(0, 80), reason=got["reason"].str.slice(0, 300))[["key", "blog_score", "is_transition", "scene", "reason"]]


def ask(scorer: Scorer, batch: pd.DataFrame, tries: int = TRIES, wait: float = WAIT) -> pd.DataFrame:
    """One batch; a failed call is repeated, an invalid reply is not."""
    for n in range(tries):
        try:
            return checked_reply(batch, scorer(batch))
        except ValueError:
            raise
        except Exception:
            if n == tries - 1:
                raise
            time.sleep(wait * (n + 1))
    raise AssertionError


def state(df: DataFrame, folder: str, key: str) -> DataFrame:
    """Assessments stored under the key; of several for one candidate the one written last, then the smallest."""
    spark = df.sparkSession
    try:
        stored = spark.read.schema(STATE).parquet(f"{folder}/cache_key={key}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STATE)
    fields = [c.split()[0] for c in STATE.split(", ")]
    # as structs they compare field by field: the earliest of the negated times is the last write
    first = F.min(F.struct((-F.unix_micros("_metadata.file_modification_time")).alias("t"), *fields))
    return stored.groupBy(F.col("key").alias("_key")).agg(first.alias("s")).select(*(f"s.{c}" for c in fields))


def assess(candidates: DataFrame, scorer: Scorer, folder: str, key: str, batch: int = 12) -> DataFrame:
    """Assessments (STATE) of all candidates: stored ones as they are, the others scored and stored."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), batch):
                yield ask(scorer, f.iloc[a : a + batch])

    missing = candidates.join(state(candidates, folder, key).select("key"), "key", "left_anti")
    missing.mapInPandas(run, STATE).write.mode("append").parquet(f"{folder}/cache_key={key}")
    return state(candidates, folder, key).join(candidates.select("key"), "key", "left_semi")


def assess_until_covered(candidates: DataFrame, first: DataFrame, scorer: Scorer, folder: str, key: str, count: int, distinct_bits: int = 5) -> DataFrame:
    """Assess ``first``, then more candidates of sources without a survivor, until each run has enough or nothing is left.

    candidates: run, key, source, ts, score, h; first: run, key. Every round stores its assessments, so a round's lineage is a read of
    them. Returns key and the assessment of all that were assessed.
    """
    from lumeset.operators.select import backfill_order, source_backfill

    asked = first.select("key")
    while True:  # each round assesses candidates that were not
        done = assess(candidates.join(asked, "key", "left_semi"), scorer, folder, key)
        known = candidates.join(done, "key")
        order = backfill_order(known.select("run", "source", "is_transition"), candidates.select("run", "source").distinct(), count)
        more = source_backfill(candidates.join(done.select("key", F.lit(True).alias("assessed")), "key", "left").withColumn("assessed", F.coalesce("assessed", F.lit(False))), order, distinct_bits)
        if more.isEmpty():
            return done
        asked = done.select("key").union(more.select("key"))


def assess_twice(candidates: DataFrame, first: DataFrame, one: Scorer, two: Scorer, folder: str, keys: tuple[str, str], count: int, distinct_bits: int = 5) -> DataFrame:
    """Assess with the first scorer, then those it lets pass with the second, until each run has enough survivors of both or nothing is left.

    When the second's pool has no more candidates of the sources that lack survivors, the first's is filled up from all candidates of those
    sources, and what passes there is added to the pool. Arguments and result (the second's assessments) as in ``assess_until_covered``.
    """
    from lumeset.operators.select import backfill_order, source_backfill

    primary = assess_until_covered(candidates, first, one, folder, keys[0], count, distinct_bits)
    asked = primary.select("key")
    while True:  # each round assesses candidates that were not
        pool = candidates.join(assess(candidates.join(asked, "key", "left_semi"), one, folder, keys[0]).where(~F.col("is_transition")).select("key"), "key", "left_semi")
        start = pool.join(first.select("key"), "key", "left_semi")
        done = assess_until_covered(pool, (pool if start.isEmpty() else start).select("run", "key"), two, folder, keys[1], count, distinct_bits)
        order = backfill_order(candidates.join(done, "key").select("run", "source", "is_transition"), candidates.select("run", "source").distinct(), count)
        known = candidates.join(asked.select("key", F.lit(True).alias("assessed")), "key", "left").withColumn("assessed", F.coalesce("assessed", F.lit(False)))
        more = source_backfill(known, order, distinct_bits)
        if more.isEmpty():
            return done
        # stored, so that the next round's list is no plan over all rounds before
        assess(candidates.join(more.select("key"), "key", "left_semi"), one, folder, keys[0]).count()
        asked = state(candidates, folder, keys[0]).select("key")


def with_fallback(candidates: DataFrame, classified: DataFrame, slug: str = "fallback") -> DataFrame:
    """Candidates with their classification (path, scene, confidence); a fixed scene of confidence 0 where it failed."""
    return candidates.join(classified, "path", "left").withColumns({"scene": F.coalesce("scene", F.lit(slug)), "confidence": F.coalesce("confidence", F.lit(0.0))})
