"""Replies, titles of all scripts, caches, manifests and nested backfill."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumeset.functions import text as X
from lumeset.operators import assess, replies, resume
from lumeset.sinks import artifacts


def one(spark, column, **values):
    kinds = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first().x


def test_titles_of_all_scripts(spark):
    want = {
        "ゲーム　パート1": "ゲーム", "Game　Part 2": "Game", "Game パート１": "Game", "　Game #３　": "Game", "Game part 1 #2": "Game", "Part 2": "Part 2", "Game PART10 end": "Game",
        "Game Party 3": "Game Party 3", " # 1": "# 1", "": "",
    }
    rows = spark.createDataFrame([(s,) for s in want], "s string").select("s", X.infer_title(F.col("s")).alias("t")).collect()
    assert {r.s: r.t for r in rows} == want
    assert one(spark, X.screen_family(F.col("s")), s="　タイトル　") == "title" and one(spark, X.role(F.col("s")), s="　cinematic ") == "cinematic"


def test_agreed_titles(spark):
    df = spark.createDataFrame([("a", "G #1"), ("a", "G　パート2"), ("b", "G #1"), ("b", "H #1")], "run string, stem string")
    assert {r.run: r.title for r in replies.agreed_titles(df, "run", "stem").collect()} == {"a": "G", "b": None}
    with pytest.raises(Exception, match="one title"):
        replies.agreed_titles(df, "run", "stem", strict=True).collect()


SCENE = {"slug": "a", "display_name": "A", "description": "d", "selection_role": "cinematic"}


def test_catalog_replies(spark):
    whole = [SCENE, {**SCENE, "slug": "b", "selection_role": "boss"}, {"slug": "other", "display_name": "O", "description": "o"}]
    good = ["Here: " + json.dumps({"scenes": whole}) + " done", "　" + json.dumps({"scenes": [*whole, "no dict", 5]}), json.dumps({"scenes": [{**SCENE, "slug": "a "}, *whole[1:]]})]
    bad = [
        "", "none", json.dumps([{"scenes": whole}]), json.dumps({"scenes": whole[:2]}), json.dumps({"scenes": [*whole, SCENE]}), json.dumps({"scenes": [*whole[:2], {**SCENE, "slug": "c"}]}),
        json.dumps({"scenes": [{**SCENE, "slug": 5}, *whole[1:]]}), json.dumps({"scenes": [{**SCENE, "description": " "}, *whole[1:]]}), json.dumps({"scenes": [{**SCENE, "selection_role": 3}, *whole[1:]]}),
        json.dumps({"scenes": [{"slug": "a", "display_name": "A", "description": "d"}, *whole[1:]]}), json.dumps({"scenes": whole * 3}), json.dumps({"scenes": "x"}), None, json.dumps({"scenes": whole}) + "}", json.dumps({"scenes": whole}) + ", {}", "[" + json.dumps({"scenes": whole}) + "]",
    ]
    for reply in good:
        assert [(s.slug, s.role) for s in one(spark, replies.catalog_of(F.col("r")), r=reply)] == [("a", "cinematic"), ("b", "ordinary"), ("other", "ordinary")], reply
    for reply in bad:
        assert one(spark, replies.catalog_of(F.col("r")), r=reply) is None, reply


def test_classification_replies(spark):
    def read(**fields):
        found = one(spark, replies.classification_of(F.col("r"), {"a": "A", "b": "B"}), r=json.dumps({"scene_slug": "a", "description": "d", "confidence": 0.5} | fields))
        return found and tuple(found)

    assert read() == ("a", "A", "d", 0.5) and read(confidence="1") == ("a", "A", "d", 1.0) and read(scene_slug=" b ") == ("b", "B", "d", 0.5)
    assert not any(read(**x) for x in ({"scene_slug": "c"}, {"confidence": True}, {"confidence": "high"}, {"confidence": None}, {"description": ""}, {"scene_slug": 1}))


def test_changed_runs_are_refused(spark):
    now = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "run int, digest string")
    before = spark.createDataFrame([(1, "x"), (2, "other")], "run int, digest string")
    assert {r.run: r.state for r in resume.resume_states(now, before, "run").collect()} == {1: "resume", 2: "changed", 3: "new"}
    with pytest.raises(Exception, match="have changed"):
        resume.resume_states(now, before, "run", strict=True).collect()


def test_report_is_json(spark):
    rows = [(1, i, i < 2, f"out{i}" if i < 2 else None, f'p"{i}') for i in range(4)]
    df = spark.createDataFrame(rows, "run int, place int, selected boolean, output_path string, path string").withColumns({c: F.lit(None).cast("double") for c in artifacts.REPORT_CANDIDATE[1:]})
    report = json.loads(artifacts.image_report(spark.createDataFrame([(1, 0.25)], "run int, ollama_classification_failure_rate double"), df, "run").first().report)
    assert list(report) == [*artifacts.REPORT_HEAD, "selected", "rejected"] and report["ollama_classification_failure_rate"] == 0.25
    assert [x["output_path"] for x in report["selected"]] == ["out0", "out1"] and [x["path"] for x in report["rejected"]] == ['p"2', 'p"3'] and "output_path" not in report["rejected"][0]


def test_the_first_pool_grows_for_the_second(spark, tmp_path):
    """Source 1 passes the first scorer only at its worse rows, and the second only at its worst."""
    rows = [(1, k, k % 2, float(k), 100.0 - k, k * 77777) for k in range(10)]
    candidates = spark.createDataFrame(rows, "run int, key long, source int, ts double, score double, h long")

    def scorer(fails):
        def score(f):
            return pd.DataFrame({"key": f["key"], "blog_score": 50.0, "is_transition": [fails(k, s) for k, s in zip(f["key"], f["source"], strict=True)], "scene": "s", "reason": "r"})

        return score

    first, second = scorer(lambda k, s: s == 1 and k < 3), scorer(lambda k, s: s == 1 and k < 7)
    start = candidates.where("key < 4").select("run", "key")
    done = assess.assess_twice(candidates, start, first, second, str(tmp_path), ("one", "two"), 2).collect()
    alive = {r.key for r in done if not r.is_transition}
    assert any(k % 2 == 1 and k >= 7 for k in alive) and any(k % 2 == 0 for k in alive)
    assert assess.assess(candidates.where("key < 4"), lambda f: 1 / 0, str(tmp_path), "one").count() == 4  # all of it was stored
