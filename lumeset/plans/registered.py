"""Registered queries: each applies an operator to the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from lumeset.functions import metrics as M
from lumeset.functions import text as X
from lumeset.functions import vectors as V
from lumeset.operators import allocate, interleave, links, profile, reject, select, similarity
from lumeset.sources.tables import candidates, frames, spread, table

KEYS = ["k1", "k2", "k3", "k4", "k5"]
COUNT = 6  # outputs of a run
LIKE = 0.35  # cosine that counts as alike on these tables
NEAR_BITS = 20  # bits that count as near on these tables
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(x, name: str):
    return F.round(x, 6).alias(name)


def keyed_frames(spark: SparkSession, d: str) -> DataFrame:
    return M.normalised(frames(spark, d))


# --- profiles, scores and rules ---


@query
def profile_percentiles(spark, d):
    p = profile.build_profile(frames(spark, d))
    return p.select(*(r6(F.col(c), c) for c in p.columns))


@query
def frame_scores(spark, d):
    df = keyed_frames(spark, d)
    q = M.quality_score()
    return df.select(
        *KEYS, M.unusable(F.col("brightness"), F.col("contrast"), F.col("blur_score")).alias("unusable"),
        r6(M.mechanical_quality(F.col("brightness"), F.col("contrast"), F.col("blur_score"), F.col("luminance_entropy")), "mechanical"),
        r6(q, "quality"), r6(M.selection_score(q, F.col("near_white_ratio")), "selection"), r6(M.visibility(), "visibility"), r6(M.bright_washout(), "washout"),
        r6(M.system_ui(), "system_ui"), r6(M.support_ui(), "support_ui"), r6(M.veiled_transition(M.visibility(), F.lit(0.5), M.bright_washout()), "veiled"),
    )


@query
def relative_transitions(spark, d):
    df = keyed_frames(spark, d)
    df = profile.with_profile(df, profile.build_profile(df))
    bright, dark = M.relative_transition(M.bright_washout())
    return df.select(*KEYS, F.round(bright, 9).alias("bright"), F.round(dark, 9).alias("dark"))


def judged_frames(spark, d) -> DataFrame:
    df = keyed_frames(spark, d)
    scored = profile.with_information(df, rows=spread(df)).withColumn("visibility", M.visibility()).withColumn("washout", M.bright_washout())
    return reject.with_reason(profile.with_profile(scored, profile.build_profile(df)))


@query
def information_scores(spark, d):
    df = keyed_frames(spark, d)
    return profile.with_information(df).select(*KEYS, F.round("information", 9).alias("information"))


@query
def reject_classifier(spark, d):
    return judged_frames(spark, d).select(*KEYS, "reason")


@query
def reject_breakdown(spark, d):
    return reject.breakdown(judged_frames(spark, d))


@query
def temporal_dip_filter(spark, d):
    df = candidates(spark, d, vectors=True).withColumn("visibility", F.col("score") / 100.0).withColumn("reason", F.when(F.col("is_transition"), "fade_transition"))
    return reject.temporal_dips(df, ["run"], ["ts", "key"], similarity=0.05, margin=0.05).select("run", "key", "dip")


@query
def report_profile(spark, d):
    """The profile as a report has it, here of a third of each value: four digits, ties to even."""
    p = profile.build_profile(frames(spark, d))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(q).alias("point"), F.col(f"p_{m}_{q}").alias("x")) for m in profile.PROFILED for q in profile.POINTS))).alias("e")
    return p.select(each).select("e.metric", "e.point", M.round_half_even(F.col("e.x") / 3.0, 4).alias("value"))


# --- functions on text, hashes and vectors ---


@query
def scene_labels(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", X.normalize_scene(F.concat_ws(" / ", "p_name", "p_type")).alias("scene_key"), X.role(F.concat(F.lit(" "), F.element_at(F.array(*map(F.lit, [*X.ROLES, "boss"])), (F.col("p_partkey") % 4 + 1).cast("int")))).alias("role"))


@query
def screen_families(spark, d):
    return candidates(spark, d).select("key", X.normalize_scene(F.col("scene")).alias("scene_key"), X.screen_family(F.col("scene")).alias("family"))


@query
def inferred_titles(spark, d):
    p = table(spark, d, "part")
    stem = F.concat("p_name", F.element_at(F.array(*map(F.lit, [" Part ", " #", " パート ", "-"])), (F.col("p_partkey") % 4 + 1).cast("int")), F.col("p_size").cast("string"), F.lit(" end"))
    return p.select("p_partkey", X.infer_title(stem).alias("title"))


@query
def duration_labels(spark, d):
    o = table(spark, d, "orders")
    rate = F.concat_ws("/", (F.col("o_orderkey") % 61).cast("string"), (F.col("o_custkey") % 7).cast("string"))
    t = F.col("o_totalprice")
    return o.select("o_orderkey", X.duration_label(t).alias("duration"), X.timestamp_label(t).alias("at"), r6(X.frame_interval(rate), "interval"), X.source_label(F.col("o_orderkey") % 100, F.col("o_orderstatus")).alias("label"), X.host_url(F.concat_ws(":", F.lit("host"), F.when(F.col("o_orderkey") % 2 == 0, "9000"))).alias("host"))


@query
def salvaged_replies(spark, d):
    e = table(spark, d, "events").withColumn("reply", F.concat(F.lit("Sure:\n"), "props", F.lit("\nDone")))
    k = F.from_json(X.salvaged_json(F.col("reply")), "k double")["k"]
    return e.select("event_id", F.when(F.col("event_type") == "error", None).otherwise(F.when(k.between(0, 100), k)).alias("blog_score"))


@query
def hash_text(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", V.sign_hash(F.col("embedding")).alias("h"))
    return e.select("vec_id", "h", V.hash_text(F.col("h")).alias("hex"), (V.hash_number(V.hash_text(F.col("h"))) == F.col("h")).alias("same"))


@query
def unit_vectors(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", V.l2_normalise(F.col("embedding")).alias("u"))
    return e.select("vec_id", r6(V.dot(F.col("u"), F.col("u")), "square"), r6(F.element_at("u", 1), "first"))


@query
def event_entropy(spark, d):
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(W.partitionBy("user_id"))
    return n.withColumn("p", p).groupBy("user_id").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"))


# --- joins ---


@query
def hamming_pairs(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", V.sign_hash(F.col("embedding")).alias("h"))
    return links.hamming_links(e, "vec_id", "h", NEAR_BITS)


@query
def near_frames(spark, d):
    """Candidates whose hashes, in which some bits are turned over, differ in fewer than five."""
    turned = F.expr("shiftleft(1L, CAST(key % 61 AS INT)) ^ shiftleft(key % 4, CAST(key % 7 * 8 AS INT))")
    c = candidates(spark, d).select("key", F.col("h").bitwiseXOR(turned).alias("h"))
    return links.hamming_links(c, "key", "h", select.DISTINCT_BITS)


@query
def hash_classes(spark, d):
    """Documents of equal length as copies of one hash: each with its class."""
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("long").alias("h"))
    return docs.join(links.hash_classes(docs, "doc_id", "h"), "h").select("doc_id", "class", "n")


@query
def cosine_pairs(spark, d):
    return links.cosine_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", LIKE).select("a", "b", r6(F.col("cosine"), "cosine"))


@query
def cosine_degrees(spark, d):
    """Classes of equal vectors among those of the candidates, and how many candidates a member of each is linked to."""
    return links.cosine_degrees(candidates(spark, d, vectors=True), "key", "features", LIKE)


@query
def stage_blend(spark, d):
    """Two assessments of each candidate, 0.4 and 0.6."""
    c = candidates(spark, d)
    one, two = c.select("key", F.col("score").alias("p")), c.where(~F.col("is_transition")).select("key", (100.0 - F.col("score")).alias("s"))
    return c.select("run", "key").join(one, "key").join(two, "key").select("run", "key", r6(F.col("p") * 0.4 + F.col("s") * 0.6, "aggregate"))


@query
def unassessed_documents(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id", "left_anti").select("doc_id", "source")


@query
def cache_probe(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    j = docs.join(labels, "doc_id", "left")
    return j.groupBy("source").agg(F.count_if(F.col("quality").isNotNull()).alias("hits"), F.count_if(F.col("quality").isNull()).alias("misses"))


@query
def exact_id_check(spark, d):
    """Ids expected and not found, and found and not expected."""
    ids, got = table(spark, d, "documents").select(F.col("doc_id").alias("id")), table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return ids.exceptAll(got).select("id", F.lit("missing").alias("what")).union(got.exceptAll(ids).select("id", F.lit("unknown").alias("what")))


@query
def nearest_in_time(spark, d):
    """Seconds to the nearest candidate of the same source."""
    by = W.partitionBy("run", "source").orderBy("ts", "key")
    c = candidates(spark, d)
    before, after = F.col("ts") - F.lag("ts").over(by), F.lead("ts").over(by) - F.col("ts")
    return c.select("run", "key", F.round(F.least(before, after), 3).alias("seconds"))


@query
def context_window(spark, d):
    c = candidates(spark, d)
    by = W.partitionBy("run", "source")
    start, end = F.min("ts").over(by), F.max("ts").over(by)
    return c.select("run", "key", F.round(F.greatest(start + 0.05, F.col("ts") - 0.35), 3).alias("before"), F.round(F.least(end, F.col("ts") + 0.35), 3).alias("after"))


# --- aggregations, windows and sets ---


@query
def source_survivors(spark, d):
    c = candidates(spark, d)
    return c.groupBy("run", "source").agg(F.count_if(~F.col("is_transition")).alias("alive"), F.count("*").alias("n"))


@query
def uncovered_sources(spark, d):
    c = candidates(spark, d)
    return c.select("run", "source").distinct().join(c.where(~F.col("is_transition") & (F.col("score") > 50)).select("run", "source"), ["run", "source"], "left_anti")


@query
def source_time_scales(spark, d):
    c = candidates(spark, d).groupBy("run", "source").agg((F.max("ts") - F.min("ts")).alias("span"))
    expected = F.greatest(F.lit(1.0), F.lit(float(COUNT)) / F.count("*").over(W.partitionBy("run")))
    return c.select("run", "source", F.round(F.greatest(F.lit(60.0), F.col("span") / expected), 3).alias("scale"))


@query
def time_bins(spark, d):
    return binned(candidates(spark, d)).select("run", "key", "bin")


def binned(c: DataFrame, count: int = COUNT) -> DataFrame:
    """Add ``bin``: the place of a candidate among up to 60 bins of the run's sources, put one after another."""
    spans = c.groupBy("run", "source").agg(F.min("ts").alias("start"), (F.max("ts") - F.min("ts")).alias("span"), F.count("*").alias("rows"))
    by = W.partitionBy("run")
    spans = spans.withColumn("offset", F.coalesce(F.sum("span").over(by.orderBy("source").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    spans = spans.withColumn("all", F.greatest(F.sum("span").over(by.orderBy("source").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.lit(0.001)))
    spans = spans.withColumn("bins", F.least(F.lit(60), F.lit(count * 12), F.sum("rows").over(by))).drop("rows", "span")
    at = F.floor((F.col("offset") + F.greatest(F.lit(0.0), F.col("ts") - F.col("start"))) / F.col("all") * F.col("bins"))
    return c.join(spans, ["run", "source"]).withColumn("bin", F.least(F.col("bins") - 1, at)).drop("start", "offset", "all", "bins")


@query
def source_topk(spark, d):
    rank = F.row_number().over(W.partitionBy("run", "source").orderBy(F.col("score").desc(), "ts", "key"))
    return candidates(spark, d).withColumn("place", rank).where("place <= 3").select("run", "source", "key", "place")


@query
def batch_numbers(spark, d):
    return interleave.batches(candidates(spark, d), ["run"], ["key"], 12).select("run", "key", "batch")


@query
def memory_chunks(spark, d):
    return interleave.memory_chunks(table(spark, d, "documents"), "n_chars", 65536, ["doc_id"], ["source"])


@query
def output_names(spark, d):
    c = candidates(spark, d).withColumn("scene", F.concat("event_type", F.lit(""))).withColumn("suffix", F.when(F.col("key") % 2 == 0, ".JPG").otherwise(".jpg"))
    return interleave.output_names(c, "run", "key", 30).select("run", "key", "name")


@query
def label_conflicts(spark, d):
    """Ids whose repeated labels differ."""
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count_distinct("props").alias("kinds"), F.count("*").alias("n"))
    return e.where("kinds > 1")


@query
def last_update(spark, d):
    """The newest state of each user and kind."""
    e = table(spark, d, "events")
    return e.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("event_id").alias("last_id"))


@query
def id_sets(spark, d):
    """Union without repeats, difference and common part of two id sets, counted."""
    one, two = table(spark, d, "documents").select(F.col("doc_id").alias("id")), table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    n = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return n(one.union(two).distinct(), "union").union(n(one.subtract(two), "difference")).union(n(one.intersect(two), "common")).union(n(one.distinct(), "distinct"))


@query
def canonical_digest(spark, d):
    """SHA-256 of each order in a fixed text form."""
    from lumeset.sinks.artifacts import digest

    return table(spark, d, "orders").select("o_orderkey", digest("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").alias("digest"))


@query
def run_statistics(spark, d):
    c = candidates(spark, d)
    return c.groupBy("run").agg(F.count("*").alias("n"), F.count_if(F.col("is_transition")).alias("rejected"), F.round(F.avg(F.col("is_transition").cast("int")), 6).alias("failure_rate"), F.count_distinct("scene").alias("scenes"), F.round(F.max("score"), 4).alias("best"))


# --- allocation and interleaving ---


def customer_sources(spark, d) -> DataFrame:
    """Customers as sources of their nation's run, their balance as a duration."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("run"), F.col("c_custkey").alias("key"), F.col("c_custkey").alias("ord"), F.abs("c_acctbal").alias("duration"))
    return c.withColumn("capacity", allocate.sample_capacity(F.col("duration"), F.lit(1.0 / 30.0), F.lit(0.0), F.lit(None).cast("double")))


@query
def sample_capacities(spark, d):
    return customer_sources(spark, d).select("key", "capacity")


@query
def sample_budget(spark, d):
    return allocate.weighted_counts(allocate.automatic_budget(customer_sources(spark, d), COUNT, strict=False))


@query
def minimum_budget(spark, d):
    by = W.partitionBy("run")
    s = customer_sources(spark, d).withColumn("target", F.least(F.sum("capacity").over(by), F.greatest(F.lit(200), F.count("*").over(by))))
    return allocate.weighted_counts(s.select("run", "key", "ord", F.col("duration").alias("weight"), F.lit(1).cast("long").alias("least"), F.col("capacity").alias("most"), "target"))


@query
def sample_positions(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), (F.abs("s_acctbal") / 50.0).alias("duration"), F.lit(1.0 / 30.0).alias("end_margin"), F.lit(0.0).alias("start"), F.lit(None).cast("double").alias("last"))
    return allocate.sample_positions(s, 2)


def scenes(spark, d) -> DataFrame:
    """Candidates as scored scene members."""
    role = F.when(F.col("event_type") == "purchase", "cinematic").when(F.col("event_type") == "click", "recurring_gameplay").otherwise("ordinary")
    c = candidates(spark, d, vectors=True).withColumn("scene", F.col("event_type")).withColumn("role", role)
    return c.withColumn("selection", F.col("score")).withColumn("quality", F.col("key").cast("double")).withColumn("path", F.format_string("p%08d", F.col("key")))


def placed(s: DataFrame) -> DataFrame:
    """Scene members with the groups of like ones in a run's scene, and ``place``: the groups in turn."""
    like = similarity.leader_groups(s, ["run", "scene"], "key", "ord", "features", LIKE)
    like = like.select("run", "scene", "key", F.format_string("%s_%03d", "scene", "leader").alias("variant_group"))
    return interleave.variant_turns(s.join(like, ["run", "scene", "key"]), ["run", "scene"])


@query
def scene_stats(spark, d):
    return allocate.scene_stats(scenes(spark, d))


@query
def scene_quotas(spark, d):
    return allocate.scene_quotas(allocate.scene_stats(scenes(spark, d)), 20).select("run", "scene", "quota")


@query
def scarce_scene_quotas(spark, d):
    return allocate.scene_quotas(allocate.scene_stats(scenes(spark, d)), 3).select("run", "scene", "quota")


@query
def variant_turns(spark, d):
    return placed(scenes(spark, d)).select("run", "scene", "key", "variant_group", "place")


def turns(spark, d, count: int = 20) -> DataFrame:
    s = scenes(spark, d)
    stats = allocate.scene_quotas(allocate.scene_stats(s), count).select("run", "scene", "first", "quota", F.col("role").alias("scene_role"))
    return interleave.scene_turns(placed(s).join(stats, ["run", "scene"]))


@query
def scene_turns(spark, d):
    return turns(spark, d).select("run", "key", "segment", "turn")


# --- greedy choices ---


@query
def diverse_topk(spark, d):
    c = candidates(spark, d).where(~F.col("is_transition")).withColumn("scene", X.normalize_scene(F.col("scene")))
    return select.diverse_candidates(c, COUNT, NEAR_BITS, strict=False)


@query
def final_topk(spark, d):
    c = candidates(spark, d).where(~F.col("is_transition")).withColumn("family", X.screen_family(F.col("scene"))).withColumn("scene", X.normalize_scene(F.col("scene")))
    return select.diverse_candidates(c, COUNT, NEAR_BITS, final=True, strict=False)


@query
def source_representatives(spark, d):
    return select.representatives(candidates(spark, d), ["run", "source"], 3, 30)


@query
def primary_preselect(spark, d):
    return select.primary_preselect(binned(candidates(spark, d), 3), 3, 30)


@query
def source_backfill(spark, d):
    c = candidates(spark, d).withColumn("assessed", F.col("key") % 3 == 0)
    order = select.backfill_order(c.where("assessed").withColumn("is_transition", F.col("key") % 4 != 0), c.select("run", "source").distinct(), COUNT)
    return select.source_backfill(c, order, 30)


def grouped_embeddings(spark, d) -> DataFrame:
    """Embeddings grouped by label, each a scene; a scene holds at most as many rows as a run has candidates."""
    return table(spark, d, "embeddings").withColumn("grp", F.col("label").cast("string"))


@query
def diversity_filter(spark, d):
    return similarity.diverse_filter(grouped_embeddings(spark, d), "grp", "vec_id", "vec_id", "embedding", 20, [0.05, 0.15, 0.25])


@query
def variant_groups(spark, d):
    return similarity.leader_groups(grouped_embeddings(spark, d), "grp", "vec_id", "vec_id", "embedding", 0.2).withColumnRenamed("grp", "scene")


def sharp_embeddings(spark, d) -> DataFrame:
    """Embeddings grouped by label with ``quality``, a component that stands for their sharpness, and ``fall``, by which the sharpest come first."""
    e = grouped_embeddings(spark, d).withColumn("quality", F.get("embedding", F.lit(0)).cast("double"))
    return e.withColumn("fall", -F.col("quality"))


def repeated_patterns(e: DataFrame, at_least: float) -> DataFrame:
    """scene, leader, n, sharpest, best of groups of several like rows (grp, vec_id, embedding, quality, fall), led by the sharpest of those unlike all leaders before."""
    g = similarity.leader_groups(e, "grp", "vec_id", "fall", "embedding", at_least).withColumnRenamed("grp", "scene")
    g = g.join(e.select("quality", F.col("vec_id").alias("key")), "key")
    best = F.min_by("key", F.struct(-F.col("quality"), "key"))
    return g.groupBy("scene", "leader").agg(F.count("*").alias("n"), F.max("quality").alias("sharpest"), best.alias("best")).where("n > 1")


@query
def frequent_patterns(spark, d):
    """Groups of several like vectors, largest first, then those with the sharpest member, which stands for them."""
    g = repeated_patterns(sharp_embeddings(spark, d), 0.2)
    place = F.row_number().over(W.partitionBy("scene").orderBy(F.col("n").desc(), F.col("sharpest").desc(), "best"))
    return g.withColumn("place", place).select("scene", "leader", "n", "best", "place")


@query
def shortlist(spark, d):
    """Unlike candidates of a kind first, by quality, then the rest by quality, up to a size that follows the number wanted."""
    c = candidates(spark, d, vectors=True).select(F.col("event_type").alias("run"), "key", F.col("value").alias("quality"), "features")
    return select.shortlist(c, select.shortlist_size(COUNT), list(similarity.LADDER))


@query
def catalog_representatives(spark, d):
    """Up to 24 of each group, each once: the 8 sharpest, the sharpest of the most frequent kinds, the unlike from the sharpest on, then the rest by sharpness."""
    e, most = sharp_embeddings(spark, d), 24
    ranked = e.withColumn("rank", F.row_number().over(W.partitionBy("grp").orderBy("fall", "vec_id"))).select(F.col("grp").alias("run"), F.col("vec_id").alias("key"), "rank").where(F.col("rank") <= most)
    sharp = ranked.select("run", "key", F.when(F.col("rank") <= most // 3, F.struct(F.lit(0).alias("part"), F.col("rank").alias("at"))).otherwise(F.struct(F.lit(3).alias("part"), F.col("rank").alias("at"))).alias("n"))
    g = repeated_patterns(e, 0.2)
    place = F.row_number().over(W.partitionBy("scene").orderBy(F.col("n").desc(), F.col("sharpest").desc(), "best"))
    often = g.select(F.col("scene").alias("run"), F.col("best").alias("key"), F.struct(F.lit(1).alias("part"), place.alias("at")).alias("n")).where(F.col("n.at") <= most)
    apart = similarity.diverse_filter(e, "grp", "vec_id", "fall", "embedding", most, [0.2]).where("pick > 0").select("run", "key", F.struct(F.lit(2).alias("part"), F.col("pick").alias("at")).alias("n"))
    # of a group no larger than the limit all stay, in the order of sharpness alone
    small = e.groupBy(F.col("grp").alias("run")).agg((F.count("*") <= most).alias("small"))
    each = sharp.union(often).union(apart).groupBy("run", "key").agg(F.min("n").alias("n")).join(ranked, ["run", "key"], "left").join(small, "run")
    by = W.partitionBy("run").orderBy(F.when(F.col("small"), F.col("rank")), "n")
    return each.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most).select("run", "key", "place")


@query
def classification_refill(spark, d):
    """Candidates classified, best first and a slice at a time, until enough succeed: those up to the slice in which the last needed success falls."""
    by = W.partitionBy("run").orderBy(F.col("score").desc(), "key")
    c = candidates(spark, d).withColumn("i", F.row_number().over(by)).withColumn("ok", ~F.col("is_transition"))
    c = c.withColumn("before", F.coalesce(F.sum(F.col("ok").cast("int")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return c.where(F.col("before") < COUNT).select("run", "key", "i", "ok")


@query
def scene_select(spark, d):
    """The whole scene selection: quotas, turns and choice by similarity."""
    return select.similar_aware_choice(turns(spark, d), 20, similarity.ladder(0.1))


@query
def selection_report(spark, d):
    """Chosen candidates in the order of the report, rounded."""
    c = candidates(spark, d)
    chosen = final_topk(spark, d).join(c, ["run", "key"])
    place = F.row_number().over(W.partitionBy("run").orderBy(F.col("score").desc(), "source", "ts"))
    return chosen.select("run", "key", place.alias("place"), F.round("score", 2).alias("score"), F.round("ts", 6).alias("ts"), V.hash_text(F.col("h")).alias("hash"))


@query
def histogram_metrics(spark, d):
    """Luminance metrics of each user's values, taken as 256 tones."""
    from lumeset.functions import pixels as P

    e = table(spark, d, "events").select("user_id", F.least(F.lit(255), F.floor(F.col("value") / 2.0)).cast("int").alias("tone"))
    n = e.groupBy("user_id", "tone").agg(F.count("*").cast("double").alias("n"))
    m = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("tone", "n"))).alias("m"))  # 256 entries at most
    h = m.select("user_id", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("h"))
    h = h.select("user_id", "h")
    c = F.col("h")
    return h.select("user_id", F.round(P.entropy(c), 9).alias("entropy"), F.round(P.share(c, 0, 12), 9).alias("black"), F.round(P.share(c, 243, 255), 9).alias("white"), F.round(P.dominant_tone(c), 9).alias("tone"))


@query
def stream_survivors(spark, d):
    """Extension: a stream of the events, counted by the hour."""
    from lumeset.streaming.survivors import replay

    return replay(spark, d).select(F.unix_seconds("start").alias("start"), "event_type", "alive", "n")


@query
def sheet_layout(spark, d):
    from lumeset.sinks.artifacts import sheet_layout as layout

    return layout(selection_report(spark, d).select("run", "key", "place"), "place")


@query
def quality_scene_join(spark, d):
    """Scene roles looked up with a default, and the share of members without one."""
    roles = scenes(spark, d).where("role <> 'ordinary'").select("event_type", "role").distinct()
    c = candidates(spark, d).join(roles, "event_type", "left")
    return c.groupBy("event_type").agg(F.max(F.coalesce("role", F.lit("ordinary"))).alias("role"), F.avg(F.col("role").isNull().cast("int")).alias("without"), F.count("*").alias("n"))
