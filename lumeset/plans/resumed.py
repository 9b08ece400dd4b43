"""Registered queries on replies, vectors, caches, manifests and reports, each with its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumeset.functions import vectors as V
from lumeset.operators import append, replies, resume
from lumeset.session import materialise, shared_folder
from lumeset.sinks import artifacts
from lumeset.sources import state
from lumeset.sources.tables import table
from lumeset.streaming import assessments

QUERIES, ORACLES = {}, {}
CATALOG = {"field": "Field", "battle": "Battle", "other": "Other"}


def query(sql: str):
    def registered(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return registered


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: abs(x)::DOUBLE) AS t, list_transform(embedding[33:64], lambda x: x::DOUBLE) AS c FROM embeddings),
u AS (SELECT *, sqrt(list_sum(list_transform(t, lambda x: x * x))) AS n FROM e)
SELECT vec_id, (len(t) + len(c) + 5)::INT AS content_size, round(list_sum(t) / n + list_sum(c) + (vec_id % 80) / 80.0 + (vec_id % 51) / 51.0 + 0.5 + 0.25 + 0.125, 9) AS content_sum,
  (len(c) + 64)::INT AS combined_size, round(c[1] + c[2] * 2, 9) AS combined_start FROM u""")
def feature_vectors(spark, d):
    """Content and combined vectors, told by their sizes and sums."""
    e = table(spark, d, "embeddings")
    tones, colours = F.transform(F.slice("embedding", 1, 32), lambda x: F.abs(x)), F.slice("embedding", 33, 32)
    content = V.content_vector(tones, colours, (F.col("vec_id") % 80) / 10.0, (F.col("vec_id") % 51) * 5.0, F.lit(0.5), F.lit(0.25), F.lit(0.125))
    combined = V.combined_vector(colours, F.col("embedding"))
    made = e.select("vec_id", content.alias("content"), combined.alias("combined"))
    total = F.aggregate("content", F.lit(0.0), lambda a, x: a + x)
    start = F.get("combined", F.lit(0)) + F.get("combined", F.lit(1)) * 2
    return made.select("vec_id", F.size("content").alias("content_size"), F.round(total, 9).alias("content_sum"), F.size("combined").alias("combined_size"), F.round(start, 9).alias("combined_start"))


@query("SELECT p_brand, CASE WHEN count(*) FILTER (p_partkey % 97 = 0) = 0 THEN p_brand WHEN count(*) FILTER (p_partkey % 97 <> 0) = 0 THEN 'Bonus' END AS title FROM part GROUP BY p_brand")
def agreed_titles(spark, d):
    """The title of each brand's parts, null where some parts have another."""
    name = F.when(F.col("p_partkey") % 97 == 0, F.lit("Bonus")).otherwise(F.col("p_brand"))
    end = F.element_at(F.array(F.lit("　Part "), F.lit(" #"), F.lit(" パート　")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return replies.agreed_titles(table(spark, d, "part").select("p_brand", F.concat(name, end, F.col("p_size").cast("string")).alias("stem")), "p_brand", "stem")


#: A reply for each event, in Spark SQL and DuckDB SQL alike
SCENES = """concat(CASE WHEN event_id % 5 = 0 THEN 'Sure: ' ELSE '' END, '{"scenes": [{"slug": " field ", "display_name": "F", "description": "f", "selection_role": "cinematic"}, {"slug": "s', event_id % 3,
 '", "display_name": "S", "description": "', CASE WHEN event_id % 11 = 0 THEN ' ' ELSE 'd' END, '", "scene_selection_role": "boss"}, 7, {"slug": "', CASE WHEN event_id % 7 = 0 THEN 'rest' ELSE 'other' END,
 '", "display_name": ', CASE WHEN event_id % 13 = 0 THEN '5' ELSE '"O"' END, ', "description": "o"}', CASE WHEN event_id % 17 = 0 THEN ', {"slug": "field", "display_name": "F", "description": "f", "selection_role": "x"}' ELSE '' END, ']}',
 CASE WHEN event_id % 19 = 0 THEN '}' ELSE '' END)"""


@query("""
SELECT event_id, CASE WHEN ok THEN 3 ELSE 0 END AS scenes, CASE WHEN ok THEN 'field,s' || (event_id % 3) || ',other' END AS slugs, CASE WHEN ok THEN 'cinematic,ordinary,ordinary' END AS roles
FROM (SELECT event_id, event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_id % 19 <> 0 AS ok FROM events)""")
def catalog_replies(spark, d):
    """Catalogs read from replies; null where a reply is no whole catalog."""
    found = table(spark, d, "events").select("event_id", replies.catalog_of(F.expr(SCENES)).alias("c"))
    joined = lambda field: F.when(F.col("c").isNotNull(), F.concat_ws(",", F.transform("c", lambda s: s[field])))
    return found.select("event_id", F.when(F.col("c").isNotNull(), F.size("c")).otherwise(0).alias("scenes"), joined("slug").alias("slugs"), joined("role").alias("roles"))


def document_files(spark, d):
    """Documents as files with a version."""
    return table(spark, d, "documents").select(F.format_string("/in/%08d.png", "doc_id").alias("path"), (F.col("doc_id") * 7).alias("mtime"), F.col("n_chars").cast("long").alias("size"), "doc_id")


@query("""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'battle' WHEN doc_id % 3 < 2 THEN 'field' END AS scene, CASE WHEN doc_id % 4 = 0 THEN 'Battle' WHEN doc_id % 3 < 2 THEN 'Field' END AS display_name,
  CASE WHEN doc_id % 4 = 0 THEN 1.0::DOUBLE WHEN doc_id % 3 < 2 THEN 0.5::DOUBLE END AS confidence, CASE WHEN doc_id % 4 = 0 THEN 'cache' WHEN doc_id % 3 = 0 THEN 'first' WHEN doc_id % 3 = 1 THEN 'retry' END AS source FROM documents""")
def cached_classification(spark, d):
    """Documents classified from a cache, at the first prompt, at the second, or not at all."""
    files = document_files(spark, d)
    images = files.select("path", "mtime", "size")
    entry = (F.lit("battle").alias("scene"), F.lit("Battle").alias("display_name"), F.lit("x").alias("description"), F.lit(1.0).alias("confidence"))
    stored = files.where("doc_id % 4 = 0").select(replies.classification_key("m", CATALOG).alias("cache_key"), *entry)
    stale = files.where("doc_id % 4 = 1").withColumn("mtime", F.col("mtime") + 1).select(replies.classification_key("m", CATALOG).alias("cache_key"), *entry)

    def ask(df):
        n = F.regexp_extract("path", r"(\d+)", 1).cast("long") % 3
        good = F.lit('I see {"scene_slug": "field", "description": "grass", "confidence": "0.5"}')
        bad = F.when(F.col("path").endswith("7.png"), F.lit('{"scene_slug": "cave", "description": "x", "confidence": 1}')).otherwise(F.lit('{"scene_slug": "field", "description": "x", "confidence": true}'))
        return df.withColumn("reply", F.when(n <= F.col("prompt"), good).otherwise(bad))

    found = replies.classify(images, ask, CATALOG, "m", stored.union(stale))
    return found.join(files.select("path", "doc_id"), "path").select("doc_id", "scene", "display_name", "confidence", "source")


@query("SELECT doc_id, doc_id % 6 IN (0, 1) AS hit, CASE WHEN doc_id % 6 IN (0, 1) THEN doc_id * 2 ELSE -1 END AS payload FROM documents")
def cached_analysis(spark, d):
    """Stored analyses of documents: of the same file, of an older file version, of another analyser, and under another path."""
    files = document_files(spark, d)
    entries = lambda df, analyzer: resume.write_cached(df.select("path", "mtime", "size", (F.col("doc_id") * 2).alias("payload")), 3, analyzer)
    cache = entries(files.where("doc_id % 6 in (0, 1)"), "a").union(entries(files.where("doc_id % 6 = 2").withColumn("mtime", F.col("mtime") - 1), "a"))
    cache = cache.union(entries(files.where("doc_id % 6 = 3"), "b")).union(entries(files.where("doc_id % 6 = 4"), "a").withColumn("path", F.concat("path", F.lit(".old"))))
    found = resume.read_cached(files.select("path", "mtime", "size"), cache, 3, "a")
    return found.join(files.select("path", "doc_id"), "path").select("doc_id", "hit", F.coalesce("payload", F.lit(-1).cast("long")).alias("payload"))


@query("SELECT DISTINCT o_custkey AS customer, CASE o_custkey % 3 WHEN 0 THEN 'resume' WHEN 1 THEN 'changed' ELSE 'new' END AS state FROM orders")
def run_manifests(spark, d):
    """Customers as runs, their orders as inputs: which can go on, which have changed, which are new."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("customer"), artifacts.digest("o_orderkey", "o_totalprice", "o_orderdate").alias("input_digest"))
    now = resume.manifests(o, "customer", "v1")
    before = now.where("customer % 3 = 0").union(resume.manifests(o.where("customer % 3 = 1"), "customer", "v0"))
    return resume.resume_states(now, before, "customer")


@query("""
WITH o AS (SELECT o_orderstatus AS run, o_orderkey AS k, sha256(o_orderkey || ':' || (o_custkey + CASE WHEN o_orderkey % 4001 = 7 THEN 1 ELSE 0 END)) AS now, CASE WHEN o_orderkey % 5003 <> 11 THEN sha256(o_orderkey || ':' || o_custkey) END AS before FROM orders),
c AS (SELECT *, sha256(now || '*1') AS a, sha256(before || '*1') AS b, count(now) OVER w AS na, count(before) OVER w AS nb FROM o WINDOW w AS (PARTITION BY run)),
d AS (SELECT *, CASE WHEN least(na, nb) > 256 * 4096 THEN 4 WHEN least(na, nb) > 256 * 256 THEN 3 WHEN least(na, nb) > 256 * 16 THEN 2 WHEN least(na, nb) > 256 THEN 1 ELSE 0 END AS depth FROM c),
x AS (SELECT run, a[1:depth] AS prefix, string_agg(a, ',' ORDER BY a) AS d FROM d GROUP BY ALL), y AS (SELECT run, b[1:depth] AS prefix, string_agg(b, ',' ORDER BY b) AS d FROM d WHERE b IS NOT NULL GROUP BY ALL)
SELECT coalesce(x.run, y.run) AS run, coalesce(x.prefix, y.prefix) AS prefix, CASE WHEN y.d IS NULL THEN 'new' WHEN x.d IS NULL THEN 'gone' ELSE 'changed' END AS state
FROM x FULL JOIN y ON x.run = y.run AND x.prefix = y.prefix WHERE x.d IS DISTINCT FROM y.d""")
def changed_slices(spark, d):
    """Orders by status as runs, of which some have changed and some are new: in which slices of the manifests."""
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("run"), "o_orderkey", "o_custkey")
    digest = lambda customer: F.sha2(F.concat_ws(":", F.col("o_orderkey").cast("string"), customer.cast("string")), 256).alias("input_digest")
    now = o.select("run", digest(F.col("o_custkey") + F.when(F.col("o_orderkey") % 4001 == 7, 1).otherwise(0)))
    before = o.where("o_orderkey % 5003 <> 11").select("run", digest(F.col("o_custkey")))
    return resume.changed_slices(resume.manifest_tree(now, "run", "v1"), resume.manifest_tree(before, "run", "v1"), "run")


@query("""
WITH p AS (SELECT p_brand AS run, count(*) AS n, least(24, count(*)) AS m, 24 >> (right(p_brand, 1)::INT) AS readable FROM part GROUP BY p_brand),
r AS (SELECT *, unnest(range(0, 6)) AS k FROM p), s AS (SELECT *, greatest(1, m >> k) AS size FROM r),
f AS (SELECT run, min(k) AS k FROM s WHERE size <= readable OR size = 1 GROUP BY run)
SELECT run, size::INT AS asked, (k + 1)::INT AS rounds, CASE WHEN size <= readable THEN 3 ELSE 0 END AS scenes FROM f JOIN s USING (run, k)""")
def halved_catalogs(spark, d):
    """Catalogs of brands from up to 24 parts each; a reply is readable only if few enough parts are shown, so some brands are asked again with half of them, and again."""
    rank = F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey"))
    parts = table(spark, d, "part").select(F.col("p_brand").alias("run"), F.format_string("%08d.png", "p_partkey").alias("path"), rank.alias("ord")).where("ord <= 24")

    def ask(df):
        scene = lambda slug: f'{{"slug": "{slug}", "display_name": "{slug}", "description": "d", "selection_role": "ordinary"}}'
        good = f'{{"scenes": [{scene("a")}, {scene("b")}, {scene("other")}]}}'
        return df.withColumn("reply", F.when(F.size("paths") <= F.expr("shiftright(24, CAST(right(run, 1) AS INT))"), good).otherwise("too many images"))

    return replies.catalogs(parts, ask).select("run", "asked", "rounds", F.when(F.col("catalog").isNotNull(), F.size("catalog")).otherwise(0).alias("scenes"))


@query("""
WITH c AS (SELECT event_id AS key, user_id AS run, ts, 0 AS list FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, user_id, ts, 1 FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, user_id, ts, 2 FROM events WHERE event_id % 2 = 0),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY list) = 1) SELECT key, run, row_number() OVER (ORDER BY list, ts, key) - 1 AS ord FROM f""")
def appended_candidates(spark, d):
    """Three lists of events one after another, each in the order of time, each event once; the place of each."""
    e = table(spark, d, "events").select(F.col("event_id").alias("key"), F.col("user_id").alias("run"), "ts", "event_type")
    lists = [x.drop("event_type") for x in (e.where("event_type = 'click'"), e.where("key % 3 = 0"), e.where("key % 2 = 0"))]
    return append.append(lists, "key", ["ts", "key"]).select("key", "run", "ord")


@query("SELECT event_id AS key, least(100.0, value) AS blog_score, event_id % 9 = 0 AS is_transition, event_type AS scene, 'r' || (event_id % 7) AS reason FROM events")
def stored_assessments(spark, d):
    """Assessments written through the data source in two commits and read again under their key."""
    state.register(spark)
    folder = f"{shared_folder(spark)}/lumeset/{uuid.uuid4().hex}/state"
    e = table(spark, d, "events").select(F.col("event_id").alias("key"), F.least(F.lit(100.0), "value").alias("blog_score"), (F.col("event_id") % 9 == 0).alias("is_transition"), F.col("event_type").alias("scene"), F.concat(F.lit("r"), (F.col("event_id") % 7).cast("string")).alias("reason"))
    for part in (0, 1):
        e.where(F.col("key") % 2 == part).write.format("assessment_state").option("cache_key", "v1").mode("append").save(folder)
    return spark.read.format("assessment_state").option("cache_key", "v1").load(folder)


@query("""
SELECT DISTINCT o_orderpriority AS part, CASE left(o_orderpriority, 1)::INT % 5 WHEN 1 THEN 'size' WHEN 2 THEN 'digest' WHEN 3 THEN 'outside' ELSE 'missing' END AS fault FROM orders WHERE left(o_orderpriority, 1)::INT % 5 <> 0""")
def completion_check(spark, d):
    """Orders written by priority, recorded by size and digest, and the record verified: of four of five parts it says something else."""
    root = f"{shared_folder(spark)}/lumeset/{uuid.uuid4().hex}/outputs"
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.substring("o_orderpriority", 1, 1).alias("part"))
    o.write.partitionBy("part").csv(root)
    found = artifacts.artifacts(spark, root)
    n = F.regexp_extract("path", r"part=(\d)", 1).cast("int") % 5
    wrong = F.when(n == 3, F.concat(F.lit("/elsewhere/"), F.regexp_extract("path", r"(part=\d.*)", 1))).when(n == 4, F.concat("path", F.lit(".gone"))).otherwise(F.col("path"))
    record = found.select(wrong.alias("path"), F.when(n == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(n == 2, "0").otherwise(F.col("sha256")).alias("sha256"))
    faults = artifacts.verify(materialise(record, "record"), found, root.removeprefix("file:").replace("//", "/").replace("//", "/"))
    names = table(spark, d, "orders").select("o_orderpriority").distinct()
    return faults.select(F.regexp_extract("path", r"part=(\d)", 1).alias("_p"), "fault").distinct().join(names, F.col("_p") == F.substring("o_orderpriority", 1, 1)).select(F.col("o_orderpriority").alias("part"), "fault")


@query("SELECT event_id AS key, least(100.0, value) AS blog_score, event_id % 9 = 0 AS is_transition, event_type AS scene, 'r' AS reason, 1 AS tries FROM events")
def streamed_assessments(spark, d):
    """Events as a stream that comes twice, a third of it three times; each is scored once."""
    folder = f"{shared_folder(spark)}/lumeset/{uuid.uuid4().hex}/arrivals"
    e = table(spark, d, "events").select(F.col("event_id").alias("key"), F.least(F.lit(100.0), "value").alias("score"), F.col("event_type").alias("scene"))
    for part in (e.where("key % 3 = 0"), e, e):
        part.write.mode("append").parquet(folder)
    arrivals = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 8).parquet(folder)

    def scorer(f):
        return f.assign(blog_score=f["score"].astype(float), is_transition=f["key"] % 9 == 0, reason="r")[["key", "blog_score", "is_transition", "scene", "reason"]]

    return assessments.run_to(assessments.scored_once(arrivals, scorer, wait=0, batch=4096))


@query("""
SELECT label AS run, 15 AS fields, count(*) FILTER (vec_id % 3 = 0) AS selected, count(*) FILTER (vec_id % 3 <> 0) AS rejected, min(vec_id) FILTER (vec_id % 3 = 0) AS first,
  count(*) FILTER (vec_id % 3 = 0) AS with_output, 11 + CASE WHEN min(vec_id) FILTER (vec_id % 3 = 0) IS NULL THEN NULL ELSE 1 END AS of_selected, 11 AS of_rejected
FROM embeddings GROUP BY label""")
def image_report(spark, d):
    """A report for each label, read back."""
    e = table(spark, d, "embeddings").select(F.col("label").alias("run"), "vec_id")
    keep = F.col("vec_id") % 3 == 0
    rows = e.select("run", F.col("vec_id").alias("place"), keep.alias("selected"), F.when(keep, F.format_string("out/%d.png", "vec_id")).alias("output_path"), F.format_string("%d", "vec_id").alias("path"), F.lit("field").alias("scene_slug"), *(F.lit(None).cast("string").alias(c) for c in artifacts.REPORT_CANDIDATE[2:]))
    report = artifacts.image_report(e.select("run").distinct().withColumn("scene_distribution", F.lit("{}")), rows, "run")
    lists = report.select("run", "report", F.from_json("report", "selected array<string>, rejected array<string>").alias("x"))
    keys = lambda text: F.size(F.json_object_keys(text))
    first = F.get("x.selected", F.lit(0))
    return lists.select(
        "run", keys(F.col("report")).alias("fields"), F.size("x.selected").cast("long").alias("selected"), F.size("x.rejected").cast("long").alias("rejected"), F.get_json_object(first, "$.path").cast("long").alias("first"),
        F.size(F.filter("x.selected", lambda s: F.get_json_object(s, "$.output_path").isNotNull())).cast("long").alias("with_output"), keys(first).alias("of_selected"), keys(F.get("x.rejected", F.lit(0))).alias("of_rejected"),
    )
