"""Quality rules with risk-controlled thresholds.

Every document gets counts and, from them, scores that rise with badness. For each stratum (language) and
score a cutoff is searched on a fixed grid: labelled good documents are split by a hash of their id into
a choosing quarter and a holdout. On the holdout, an exact binomial test asks for each cutoff whether the
share of good documents that it would reject is below the limit; cutoffs are tested from the loosest on
until the first that fails, which needs no correction along the grid, and the error level is divided by
the number of (stratum, score) pairs tested. Among the cutoffs certified this way, the one that rejects most
bad documents net of good ones on the choosing quarter is used, and none if it rejects no more bad than good.
The limit is divided among the scores, so that all of a stratum's cutoffs together keep it.

Built-in functions only. Texts are read once; what is shuffled are counts of labelled documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from lumeset.llm.common import SPACES, WORD, materialise

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50  # words; per cent of words in repeated windows

MOST_REJECTED = 0.05  # of a stratum's good documents, by all cutoffs together
ERROR = 0.05  # chance that any certified cutoff breaks its limit
PRECISION = 0.9  # of the labelled documents that a cutoff rejects, so many must be bad
CHOOSING = 4  # one labelled document in so many chooses among certified cutoffs, the others are the holdout
BROADCAST_STRATA = 10_000
#: score -> cutoffs tested, loosest first
GRID = {
    "symbol_share": (1.0, 0.75, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05),
    "repeat_share": (0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.05),
}


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines of the whole text; a null text is empty.

    n_repeat_words counts the words in three-word windows that stand twice or more in the text, the first time
    included: windows are hashed, sorted with their places, and equal neighbours give the places that repeat.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    packed = F.translate(body, SPACES, "")
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    kept = docs.columns
    df = docs.select(
        *kept,
        F.regexp_extract_all(body, F.lit(WORD), F.lit(0)).alias("_words"),
        lines.alias("_lines"),
        F.length(packed).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    # each step is a projection of its own, so that no list is made anew for every element of the next
    window = lambda x, i: F.struct(F.xxhash64(x, F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i"))
    df = df.withColumn("_windows", F.sort_array(F.slice(F.transform("_words", window), F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0)))))
    rest = F.greatest(F.size("_windows") - 1, F.lit(0))
    equal = F.zip_with(F.slice("_windows", F.lit(1), rest), F.slice("_windows", F.lit(2), rest), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    df = df.withColumn("_equal", F.filter(equal, lambda x: x.isNotNull()))
    df = df.withColumn("_starts", F.sort_array(F.array_distinct(F.flatten("_equal"))))
    rest = F.greatest(F.size("_starts") - 1, F.lit(0))
    gaps = F.zip_with(F.slice("_starts", F.lit(1), rest), F.slice("_starts", F.lit(2), rest), lambda a, b: F.least(b - a, F.lit(3)))
    return df.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_starts") == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda s, x: s + x)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    )


def scores(df: DataFrame) -> DataFrame:
    """Add base_failed and the scores of GRID, each higher for worse documents; a score without a denominator is null and rejects nothing."""
    words = F.when(F.col("n_words") > 0, F.col("n_words").cast("double"))
    return df.select(
        *df.columns,
        ((F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)).alias("base_failed"),
        (F.col("n_symbols") / words).alias("symbol_share"),
        (F.col("n_dup_lines") / F.when(F.col("n_lines") > 0, F.col("n_lines").cast("double"))).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
    )


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series from n + 8 on, good to about 1e-10."""
    z = n + 9.0
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1.0 / (12.0 * z) - 1.0 / (360.0 * z * z * z) + 1.0 / (1260.0 * F.pow(z, F.lit(5.0)))
    below = F.lit(1.0)
    for k in range(1, 9):
        below = below * (n + float(k))
    return series - F.log(below)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial, summed from the largest term down; for 0 <= k < n * p, where terms fall."""
    dk, dn = k.cast("double"), n.cast("double")
    log_term = log_factorial(dn) - log_factorial(dk) - log_factorial(dn - dk) + dk * F.log(F.lit(p)) + (dn - dk) * F.log(F.lit(1.0 - p))
    steps = F.when(k > 0, F.sequence(k, F.lit(1).cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    ratio = F.lit((1.0 - p) / p)

    def add(state: Column, i: Column) -> Column:
        term = state["term"] * (i.cast("double") / (dn - i.cast("double") + 1.0)) * ratio
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    return F.aggregate(steps, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")), add, lambda s: s["total"]) * F.exp(log_term)


def certified_cutoffs(labelled: DataFrame, stratum: str = "lang", grid=GRID, most: float = MOST_REJECTED, error: float = ERROR, precision: float = PRECISION) -> DataFrame:
    """Cutoff of each (stratum, score); null where none is certified and useful.

    labelled: doc_id, the stratum, good (1 or 0) and the scores. Returns the stratum and a column per score, a row for
    each stratum with a cutoff. A stratum may be null. Only counts are shuffled, at most one per (stratum, fold, label, score, cutoff)
    from each task.
    """
    limit = most / len(grid)
    fold = F.pmod(F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(CHOOSING)) == 0
    passed = lambda c: sum((F.when(F.col(c) > t, 1).otherwise(0) for t in grid[c]), F.lit(0))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("score"), passed(c).alias("passed")) for c in grid))).alias("e")
    counts = labelled.select(F.col(stratum).alias("stratum"), fold.alias("choosing"), "good", each).groupBy("stratum", "choosing", "good", "e.score", "e.passed").agg(F.count("*").alias("n"))
    tested = labelled.sparkSession.createDataFrame([(c, j, t, len(ts) - j) for c, ts in grid.items() for j, t in enumerate(ts)], "score string, step int, cutoff double, needs int")
    rejected = lambda which: F.coalesce(F.sum(F.when(which & (F.col("passed") >= F.col("needs")), F.col("n"))), F.lit(0))
    good, choosing = F.col("good") == 1, F.col("choosing")
    steps = counts.join(F.broadcast(tested), "score").groupBy("stratum", "score", "step", "cutoff").agg(  # the grid is fixed
        rejected(~choosing & good).alias("k"),
        F.coalesce(F.sum(F.when(~choosing & good, F.col("n"))), F.lit(0)).alias("n"),
        rejected(choosing & ~good).alias("bad"),
        rejected(choosing & good).alias("fine"),
    )
    pairs = steps.agg(F.count_distinct(F.struct("stratum", "score")).alias("pairs"))
    steps = steps.crossJoin(F.broadcast(pairs))  # one row: a global aggregate
    holds = (F.col("k") < F.col("n") * limit) & (binomial_tail(F.least("k", F.floor(F.col("n") * limit)), F.col("n"), limit) <= F.lit(error) / F.col("pairs"))
    so_far = F.min(F.when(holds, 1).otherwise(0)).over(W.partitionBy("stratum", "score").orderBy("step").rowsBetween(W.unboundedPreceding, 0))
    net = F.col("bad") * (1.0 - precision) - F.col("fine") * precision
    useful = steps.withColumn("certified", so_far).withColumn("net", net).where("certified = 1 and net > 1e-9")
    best = useful.groupBy("stratum", "score").agg(F.max_by("cutoff", F.struct("net", "cutoff")).alias("cutoff"))
    return best.groupBy(F.col("stratum").alias(stratum)).agg(*(F.max(F.when(F.col("score") == c, F.col("cutoff"))).alias(c) for c in grid))


def judge_quality(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """Counts and verdict of each document.

    docs: doc_id, text, the stratum. labels: doc_id, quality (the lower of repeated labels counts; nulls do not). Without
    enough labels no cutoff is certified and only the base rules reject. Repeated rows are judged each; a null text has no words and
    fails the base rules; an empty table gives an empty result. Returns doc_id, the counts, base_failed and kept, and ``doc``
    if docs has a column of that name (a struct of anything to carry along).
    """
    extra = [c for c in docs.columns if c == "doc"]
    scored = materialise(scores(text_counts(docs.select("doc_id", stratum, "text", *extra))).drop("text"), "scores")
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    cutoffs = materialise(certified_cutoffs(scored.drop(*extra).where(~F.col("base_failed")).join(known, "doc_id"), stratum), "cutoffs")
    cut = cutoffs.select(F.col(stratum).alias("_stratum"), *(F.col(c).alias(f"_{c}") for c in GRID))
    if cutoffs.count() <= BROADCAST_STRATA:
        cut = F.broadcast(cut)  # of a checked size; beyond it, a plain join
    over = F.lit(False)
    for c in GRID:
        over = over | F.coalesce(F.col(c) > F.col(f"_{c}"), F.lit(False))
    judged = scored.join(cut, scored[stratum].eqNullSafe(cut["_stratum"]), "left")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~over).alias("kept"), *extra)


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    judged = judge_quality(docs.select("doc_id", "text", stratum, F.struct(*docs.columns).alias("doc")), labels, stratum)
    return judged.where("kept").select("doc.*")


def op8_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict on every document."""
    return judge_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def oracle_sql(documents: str = "documents") -> str:
    """DuckDB SQL for the result; ``documents`` names the table judged."""
    grid = ", ".join(f"('{c}', {j}, {t}::DOUBLE)" for c, ts in GRID.items() for j, t in enumerate(ts))
    limit, ends = MOST_REJECTED / len(GRID), " OR ".join(f"coalesce({c} > cut_{c}, false)" for c in GRID)
    cuts = ", ".join(f"max(CASE WHEN score = '{c}' THEN cutoff END) AS cut_{c}" for c in GRID)
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM {documents}),
w AS (SELECT *, regexp_extract_all(t, '[^ 	-
]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS ls FROM d),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, i + k AS j FROM rep, range(3) r(k)) GROUP BY doc_id),
m AS (
  SELECT doc_id, lang, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines
  FROM w LEFT JOIN cov USING (doc_id)),
s AS (
  SELECT *, n_words < {LEAST_WORDS} OR n_repeat_words * 100 > n_words * {MOST_REPEATED} AS base_failed,
    CASE WHEN n_words > 0 THEN n_symbols / n_words::DOUBLE END AS symbol_share, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines::DOUBLE END AS dup_line_share,
    CASE WHEN n_words > 0 THEN n_repeat_words / n_words::DOUBLE END AS repeat_share FROM m),
known AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
lab AS (SELECT s.*, good, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % {CHOOSING} = 0 AS choosing FROM s JOIN known USING (doc_id) WHERE NOT base_failed),
long AS (UNPIVOT (SELECT lang, choosing, good, coalesce(symbol_share, -1) AS symbol_share, coalesce(dup_line_share, -1) AS dup_line_share, coalesce(repeat_share, -1) AS repeat_share FROM lab) ON symbol_share, dup_line_share, repeat_share INTO NAME score VALUE v),
grid(score, step, cutoff) AS (VALUES {grid}),
steps AS (
  SELECT lang, score, step, cutoff, count(*) FILTER (NOT choosing AND good = 1 AND v > cutoff) AS k, count(*) FILTER (NOT choosing AND good = 1) AS n,
    count(*) FILTER (choosing AND good <> 1 AND v > cutoff) AS bad, count(*) FILTER (choosing AND good = 1 AND v > cutoff) AS fine
  FROM long JOIN grid USING (score) GROUP BY ALL),
p AS (
  SELECT *, (SELECT count(*) FROM (SELECT DISTINCT lang, score FROM steps)) AS pairs,
    CASE WHEN k < n * {limit!r}::DOUBLE THEN list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({limit!r}::DOUBLE) + (n - i) * ln({1 - limit!r}::DOUBLE)))) ELSE 1 END AS tail FROM steps),
c AS (SELECT *, min((tail <= {ERROR}::DOUBLE / pairs)::INT) OVER (PARTITION BY lang, score ORDER BY step) AS certified, bad * {1 - PRECISION!r}::DOUBLE - fine * {PRECISION}::DOUBLE AS net FROM p),
best AS (SELECT lang, score, arg_max(cutoff, {{'a': net, 'b': cutoff}}) AS cutoff FROM c WHERE certified = 1 AND net > 1e-9 GROUP BY ALL),
cut AS (SELECT lang, {cuts} FROM best GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({ends}) AS kept
FROM s LEFT JOIN cut ON s.lang IS NOT DISTINCT FROM cut.lang
"""
