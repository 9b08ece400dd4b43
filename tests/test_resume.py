"""Manifest trees, ordered appends, halved catalogs and the data source of assessments."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumeset.operators import append, replies, resume
from lumeset.sources import state


def inputs(spark, rows):
    return spark.createDataFrame(rows, "run string, input_digest string")


def test_one_changed_input_changes_one_slice(spark):
    digest = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    rows = [("a", digest(i)) for i in range(3000)] + [("b", digest(0))] * 500 + [(None, digest(1))]
    tree = resume.manifest_tree(inputs(spark, rows), "run", "v1", leaf=16)
    got = tree.collect()
    assert {r.run for r in got} == {"a", "b", None} and sum(r.prefix == "" for r in got) == 3
    leaves = [r for r in got if r.run == "a" and len(r.prefix) == 2]
    assert len(leaves) > 250 and sum(r.n for r in leaves) == 3000 and max(r.n for r in leaves) < 40
    assert [r.n for r in got if r.run == "b"] == [1]
    changed = [("a", digest(-1) if i == 77 else digest(i)) for i in range(3000)] + [("b", digest(0))] * 499 + [(None, digest(1))]
    found = resume.changed_slices(resume.manifest_tree(inputs(spark, changed), "run", "v1", leaf=16), tree, "run").collect()
    one = lambda d, n: hashlib.sha256(f"{d}*{n}".encode()).hexdigest()
    assert {(r.run, r.prefix) for r in found} == {("a", one(digest(77), 1)[:2]), ("a", one(digest(-1), 1)[:2]), ("b", "")}
    roots = {r.run: r.digest for r in resume.manifests(inputs(spark, rows), "run", "v1", leaf=16).collect()}
    assert roots == {r.run: r.digest for r in resume.manifests(inputs(spark, rows[::-1]).repartition(7), "run", "v1", leaf=16).collect()}
    assert all(roots[r.run] != r.digest for r in resume.manifests(inputs(spark, rows), "run", "v2", leaf=16).collect())
    assert resume.manifests(inputs(spark, []), "run", "v1").count() == 0


def test_append_keeps_order_and_the_first_of_an_id(spark):
    rng = np.random.default_rng(1)
    lists = [[(int(k), float(t)) for k, t in zip(rng.integers(0, 300, n), rng.random(n))] for n in (200, 0, 150)] + [[(None, 0.5), (None, 0.25)]]
    want, seen = [], set()
    for part in lists:
        for k, t in sorted(part, key=lambda r: (r[1], r[0] or 0)):
            if k not in seen:
                seen.add(k)
                want.append((k, t))
    frames = [spark.createDataFrame(part, "key long, ts double") for part in lists]
    got = append.append(frames, "key", ["ts"], parts=7).orderBy("ord").collect()
    assert [(r.key, r.ts) for r in got] == want and [r.ord for r in got] == list(range(len(want)))


def test_catalogs_of_nothing(spark):
    assert replies.catalogs(spark.createDataFrame([], "run string, path string, ord int"), lambda df: df.withColumn("reply", F.lit("x"))).count() == 0


ROWS = [(1, 50.0, False, "s", "r"), (2, 0.0, True, "größe", "漢"), (3, 100.0, False, "", "")]


def write(df, folder, key="v1", mode="append"):
    df.write.format("assessment_state").option("cache_key", key).mode(mode).save(folder)


def test_state_is_complete_typed_and_under_its_key(spark, tmp_path):
    state.register(spark)
    folder, read = str(tmp_path / "s"), lambda key="v1": spark.read.format("assessment_state").option("cache_key", key).load(folder)
    with pytest.raises(Exception, match="no complete assessments"):
        read().count()
    df = spark.createDataFrame(ROWS, state.SCHEMA).repartition(3)
    write(df, folder)
    write(spark.createDataFrame([(9, 1.5, True, "x", "y")], state.SCHEMA), folder)
    assert sorted(map(tuple, read().collect())) == [*ROWS, (9, 1.5, True, "x", "y")]
    for action in (lambda: read("v2").count(), lambda: write(df, folder, "v2")):
        with pytest.raises(Exception, match="are of v1|of v1, not of v2"):
            action()
    record = json.loads((tmp_path / "s" / state.RECORD).read_text())
    assert sorted(x["rows"] for x in record["files"]) == [1, 1, 1, 1] or sum(x["rows"] for x in record["files"]) == 4

    # a task that fails leaves the record, and no file of its own, as they were
    bad = spark.range(4, numPartitions=4).select("id", F.when(F.col("id") == 2, F.lit(101.0)).otherwise(1.0).alias("blog_score"), F.lit(False).alias("is_transition"), F.lit("s").alias("scene"), F.lit("r").alias("reason")).withColumnRenamed("id", "key")
    with pytest.raises(Exception, match="between 0 and 100"):
        write(bad, folder)
    assert json.loads((tmp_path / "s" / state.RECORD).read_text()) == record
    with pytest.raises(Exception, match="between 0 and 100"):
        write(bad, str(tmp_path / "new"))
    assert not (tmp_path / "new" / state.RECORD).exists()

    one = tmp_path / "s" / record["files"][0]["name"]
    whole = one.read_bytes()
    one.write_bytes(whole.replace(b"false", b"true ").replace(b"true", b"1   "))
    with pytest.raises(Exception, match="not as it was recorded"):
        read().count()
    one.write_bytes(whole)
    write(spark.createDataFrame(ROWS[:1], state.SCHEMA), folder, "v3", "overwrite")
    assert sorted(map(tuple, read("v3").collect())) == ROWS[:1]


@pytest.mark.parametrize("line", [b'{"key": 1}', b"[]", b'{"key": "1", "blog_score": 1.0, "is_transition": true, "scene": "", "reason": ""}', b'{"key": 1, "blog_score": true, "is_transition": true, "scene": "", "reason": ""}', b'{"key": 1, "blog_score": NaN, "is_transition": true, "scene": "", "reason": ""}'])
def test_rows_of_other_types_are_errors(line):
    with pytest.raises(ValueError):
        state.typed(line)
