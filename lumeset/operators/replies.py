"""Replies of a model as typed columns, and classification with a cache and a second prompt.

Fields are read as variants, so that a number does not pass for a string. What is not as it must be is null: the caller decides whether that fails.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumeset.functions.text import infer_title, role, salvaged_json, strip
from lumeset.session import materialise

LEAST_SCENES, MOST_SCENES, OTHER = 3, 8, "other"
#: A reply's question: takes rows with ``prompt`` (0 first, 1 again) and adds ``reply``
Ask = Callable[[DataFrame], DataFrame]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def whole_json(text: Column) -> Column:
    """The value that a text is, as a variant; null if it is none or more follows. The parser stops after a value, so it reads a list of one."""
    values = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return bound(values, lambda v: F.when(F.size(v) == 1, F.get(v, F.lit(0))))


def json_object(reply: Column) -> Column:
    """The object that a reply is, else the widest {...} in it, as a variant; null if neither is JSON."""
    found = F.coalesce(whole_json(strip(reply)), whole_json(salvaged_json(reply)))
    return bound(found, lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v))


def string_of(value: Column, field: str) -> Column:
    """A field that must be a string with something in it."""
    text = strip(F.try_variant_get(value, f"$.{field}", "string"))
    is_string = F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant")) == "STRING"
    return F.when(is_string & (text != ""), text)


def number_of(value: Column, field: str) -> Column:
    """A field that must be a number, or a string that is one."""
    kind = F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant"))
    return F.when(kind != "BOOLEAN", strip(F.try_variant_get(value, f"$.{field}", "string")).try_cast("double"))


def catalog_of(reply: Column) -> Column:
    """array<struct<slug, display_name, description, role>> of a catalog reply, or null: 3 to 8 whole scenes with slugs of their own, ``other`` among them."""
    scenes = F.try_variant_get(json_object(reply), "$.scenes", "array<variant>")
    scenes = F.filter(scenes, lambda x: F.schema_of_variant(x).startswith("OBJECT"))

    def entry(x: Column) -> Column:
        slug = string_of(x, "slug")
        stated = F.when(F.try_variant_get(x, "$.selection_role", "string").isNotNull(), string_of(x, "selection_role")).otherwise(string_of(x, "scene_selection_role"))
        return F.struct(slug.alias("slug"), string_of(x, "display_name").alias("display_name"), string_of(x, "description").alias("description"), F.when(slug == OTHER, "ordinary").when(stated.isNotNull(), role(stated)).alias("role"))

    def checked(found: Column) -> Column:
        whole = F.forall(found, lambda s: s["slug"].isNotNull() & s["display_name"].isNotNull() & s["description"].isNotNull() & s["role"].isNotNull())
        slugs = F.transform(found, lambda s: s["slug"])
        return F.when(whole & F.size(found).between(LEAST_SCENES, MOST_SCENES) & (F.size(F.array_distinct(slugs)) == F.size(slugs)) & F.array_contains(slugs, OTHER), found)

    return bound(F.transform(scenes, entry), checked)


def classification_of(reply: Column, catalog: dict[str, str]) -> Column:
    """struct<scene, display_name, description, confidence> of a classification reply, or null. catalog: display names by slug."""
    names = F.create_map(*(F.lit(x) for pair in catalog.items() for x in pair))

    def fields(value: Column) -> Column:
        slug = string_of(value, "scene_slug")
        return F.struct(slug.alias("scene"), F.try_element_at(names, slug).alias("display_name"), string_of(value, "description").alias("description"), number_of(value, "confidence").alias("confidence"))

    whole = lambda c: c["scene"].isin(*catalog) & c["description"].isNotNull() & c["confidence"].isNotNull()
    return bound(bound(json_object(reply), fields), lambda c: F.when(whole(c), c))


def agreed_titles(df: DataFrame, group: str, stem: str, strict: bool = False) -> DataFrame:
    """group and the title that all of a group's stems lead to; if they differ null, or an error if strict."""
    found = df.select(group, infer_title(F.col(stem)).alias("t")).groupBy(group).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    differ = F.raise_error(F.lit("names do not lead to one title; state it")).cast("string") if strict else F.lit(None).cast("string")
    return found.select(group, F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(differ).alias("title"))


def classification_key(model: str, catalog: dict[str, str]) -> Column:
    """What a stored classification depends on: model, file version (path, mtime, size) and catalog."""
    entries = F.lit("|".join(f"{slug}={name}" for slug, name in sorted(catalog.items())))
    return F.sha2(F.to_json(F.struct(F.lit(model).alias("model"), "path", "mtime", "size", entries.alias("catalog"))), 256)


def classify(images: DataFrame, ask: Ask, catalog: dict[str, str], model: str, cache: DataFrame | None = None) -> DataFrame:
    """path, cache_key, scene, display_name, description, confidence and ``source`` (cache, first, retry, or null where both prompts failed).

    images: path, mtime, size. cache: cache_key and the classification. Only images without a stored classification are asked about, and only those
    whose first reply could not be read a second time. Rows from first and retry are what to add to the cache.
    """
    fields = ("scene", "display_name", "description", "confidence")
    keyed = images.withColumn("cache_key", classification_key(model, catalog))
    none = images.sparkSession.createDataFrame([], "cache_key string, scene string, display_name string, description string, confidence double")
    stored = (none if cache is None else cache).select("cache_key", *fields).dropDuplicates(["cache_key"])
    hits = keyed.join(stored, "cache_key").withColumn("source", F.lit("cache"))
    missing = keyed.join(stored, "cache_key", "left_anti")

    def answered(df: DataFrame, prompt: int, name: str) -> DataFrame:
        return ask(df.withColumn("prompt", F.lit(prompt))).withColumn("c", classification_of(F.col("reply"), catalog)).withColumn("source", F.when(F.col("c").isNotNull(), name)).drop("prompt", "reply")

    first = answered(missing, 0, "first")
    again = answered(first.where("c is null").drop("c", "source"), 1, "retry")
    asked = first.where("c is not null").unionByName(again)
    return hits.select("path", "cache_key", *fields, "source").unionByName(asked.select("path", "cache_key", "c.*", "source"))


def catalogs(images: DataFrame, ask: Ask) -> DataFrame:
    """run, asked, rounds, catalog: what the first readable catalog reply of each run says, and of how many images; null where none was readable.

    images: run, path, ord; a run has its few representatives. All runs are asked at once: with all their images, then those without a readable
    catalog with the first half, and so on down to one. ``ask`` takes rows of run, round and paths (in order) and adds ``reply``; replies are stored,
    so no question is asked again.
    """
    listed = images.groupBy("run").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "path"))), lambda x: x["path"]).alias("paths"))  # the representatives of a run
    left, found, n = materialise(listed, "asked"), [], 0
    while not left.isEmpty():
        replied = ask(left.withColumn("round", F.lit(n))).withColumn("catalog", catalog_of(F.col("reply")))
        replied = materialise(replied.select("run", "paths", "catalog"), "replies")
        size = F.size("paths")
        over = F.col("catalog").isNotNull() | (size == 1)
        found.append(replied.where(over).select("run", size.alias("asked"), F.lit(n + 1).alias("rounds"), "catalog"))
        left, n = replied.where(~over).select("run", F.slice("paths", 1, F.floor(size / 2).cast("int")).alias("paths")), n + 1
    none = images.sparkSession.createDataFrame([], "run string, asked int, rounds int, catalog array<struct<slug:string,display_name:string,description:string,role:string>>")
    return reduce(DataFrame.union, found) if found else none
