"""Helpers that the pipeline operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumeset.session import distilled, materialise  # noqa: F401

#: ASCII white space; a word is a maximal run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = "\t\n\x0b\x0c\r "
SCALE = 256  # integer vectors are floor(SCALE * x)
LARGEST = 1 << 59  # of the squared largest component times the dimensions: what is added up from products fits a long then


def words_in(text: str) -> F.Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def integer_vectors(df: DataFrame, *keep: str, vec: str = "embedding") -> DataFrame:
    """The columns of ``keep`` and ``vec`` (array<long>, floor of SCALE times each component) of rows whose vector is not null and whose components are neither null nor non-finite.

    Vectors so long that sums of products would not fit a long (see LARGEST) take no part either.
    """
    v: Column = F.transform(F.col(vec), lambda x: F.floor(x.cast("double") * SCALE))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float(1 << 30))
    kept = df.where(F.col(vec).isNotNull() & F.forall(F.col(vec), finite)).select(*keep, v.alias("vec"))
    most = F.aggregate("vec", F.lit(0).cast("double"), lambda m, x: F.greatest(m, F.abs(x).cast("double")))
    return kept.where(most * most * F.size("vec") < float(LARGEST))
