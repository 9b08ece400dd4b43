"""A stream of candidates scored once each, however often they come.

State is kept by candidate. Without waits it is the key alone: repeats are dropped by Spark and what is left is scored in batches. With waits it is how often a candidate
was tried and whether it is done: a call that fails is tried again when its wait is over, with the next batch that comes after that. An invalid reply is an
error and never tried again. State and output survive a restart from the checkpoint.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from lumeset.operators.assess import STATE, TRIES, WAIT, Scorer, checked_reply
from lumeset.session import shared_folder

FIELDS = [c.split()[0] for c in STATE.split(", ")]


def scored_once(candidates: DataFrame, scorer: Scorer, tries: int = TRIES, wait: float = WAIT, batch: int = 12) -> DataFrame:
    """Assessments (STATE, and ``tries``) of a stream of candidates with a ``key``: each key's first row is scored, later ones are passed over.

    After a failed call the candidate waits ``wait`` seconds for each try so far, and is asked about alone; the last failure is an error. What a candidate is scored by is
    kept in its state until then. With a wait of 0 candidates are asked about ``batch`` at a time (those of a failed call then alone, at once), and the stream can end with
    its input. Rows without a key are passed over.
    """
    if not wait:
        return scored_in_batches(candidates.where("key is not null").dropDuplicates(["key"]), scorer, tries, batch)
    columns = candidates.columns
    kept = StructType([*candidates.schema.fields, StructField("_tries", IntegerType()), StructField("_done", BooleanType())])

    def one(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0] is None or pd.isna(key[0]):
            return
        *row, tried, done = state.get if state.exists else (*[None] * len(columns), 0, False)
        if not state.exists:
            for f in frames:
                if len(f):
                    row = [None if pd.isna(x) else x for x in f.iloc[0][columns].tolist()]
                    break
        elif done or not state.hasTimedOut:
            return
        asked = pd.DataFrame([row], columns=columns)
        tried += 1
        try:
            reply = checked_reply(asked, scorer(asked))
        except ValueError:
            raise
        except Exception:
            if tried < tries:
                state.update((*row, tried, False))
                state.setTimeoutDuration(max(1, int(1000 * wait * tried)))
                return
            raise
        state.update((*[None] * len(columns), tried, True))  # only that it is done stays
        yield reply[FIELDS].assign(tries=tried)

    return candidates.groupBy("key").applyInPandasWithState(one, f"{STATE}, tries int", kept, "append", GroupStateTimeout.ProcessingTimeTimeout)


def scored_in_batches(candidates: DataFrame, scorer: Scorer, tries: int, batch: int) -> DataFrame:
    """Assessments (STATE, and ``tries``) of candidates, each asked about with others; after a failed call each of these alone."""

    def ask(asked: pd.DataFrame, tried: int) -> Iterator[pd.DataFrame]:
        try:
            yield checked_reply(asked, scorer(asked)).assign(tries=tried)
        except ValueError:
            raise
        except Exception:
            if tried >= tries:
                raise
            for i in range(len(asked)):
                yield from ask(asked.iloc[i : i + 1], tried + 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), batch):
                yield from ask(f.iloc[a : a + batch].reset_index(drop=True), 1)

    return candidates.mapInPandas(run, f"{STATE}, tries int")


def run_to(scored: DataFrame, folder: str | None = None, seconds: float = 0.0, name: str = "scored") -> DataFrame:
    """What a stream has given once its input is used up, or, if waits are expected, after so many seconds, as a table in the shared folder."""
    spark = scored.sparkSession
    folder = folder or f"{shared_folder(spark)}/lumeset/{uuid.uuid4().hex}"
    write = scored.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}_checkpoint")
    if seconds:
        query = write.trigger(processingTime="200 milliseconds").start()
        try:
            query.awaitTermination(seconds)  # with timers a stream never says that all is done
        finally:
            query.stop()
    else:
        query = write.trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(scored.schema).parquet(f"{folder}/{name}")
