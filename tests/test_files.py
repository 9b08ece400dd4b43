"""Files, outputs, external scoring and streams."""

import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumeset.functions import pixels
from lumeset.operators import assess
from lumeset.sinks import artifacts
from lumeset.sources import files


def test_scan_orders_names_naturally(spark, tmp_path):
    for name in ("b10.MP4", "b9.mp4", "a.txt", "B2.mkv"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.mp4").write_bytes(b"x")
    assert [r.name for r in files.scan(spark, str(tmp_path)).orderBy("ord").collect()] == ["B2.mkv", "b9.mp4", "b10.MP4"]
    assert files.scan(spark, str(tmp_path), recursive=True).count() == 4


def test_probe_skips_attached_pictures(spark):
    reply = """{"streams": [{"index": 0, "codec_type": "video", "disposition": {"attached_pic": 1}}, {"index": 1, "codec_type": "audio"},
      {"index": 2, "codec_type": "video", "width": 320, "height": 180, "avg_frame_rate": "30/1", "duration": "N/A", "start_time": "1.5", "disposition": {"attached_pic": 0}}], "format": {"duration": "10.0", "start_time": "0.5"}}"""
    got = spark.createDataFrame([(reply,)], "r string").select(files.first_video_stream(F.col("r")).alias("s")).first().s
    assert (got["index"], got.width, got.start, got.duration) == (2, 320, 1.0, 9.0)


def test_last_frame(spark):
    df = spark.createDataFrame([(1, 4.0, 3.0, 1.0, 0.0), (1, None, 6.0, 1.0, 0.0), (2, 1.0, None, 1.0, 2.0)], "key int, pts double, dts double, format_start double, start double")
    assert {r.key: r["last"] for r in files.last_frame(df).collect()} == {1: 5.0, 2: None}


def test_artifacts_are_verified(spark, tmp_path):
    for name in ("one", "two", "three"):
        (tmp_path / name).write_text(name)
    found = artifacts.artifacts(spark, str(tmp_path))
    assert {r.sha256 for r in found.collect()} == {hashlib.sha256(x.encode()).hexdigest() for x in ("one", "two", "three")}
    recorded = spark.createDataFrame(found.collect(), found.schema)
    assert artifacts.verify(recorded, found, str(tmp_path)).count() == 0
    (tmp_path / "one").write_text("new")
    (tmp_path / "two").write_text("longer")
    (tmp_path / "three").unlink()
    outside = recorded.union(spark.createDataFrame([("/etc/x", 1, "d")], recorded.schema))
    got = {r.path.rsplit("/", 1)[-1]: r.fault for r in artifacts.verify(outside, artifacts.artifacts(spark, str(tmp_path)), str(tmp_path)).collect()}
    assert got == {"one": "digest", "two": "size", "three": "missing", "x": "outside"}


def test_digest_does_not_depend_on_column_order(spark):
    df = spark.createDataFrame([(1, "x")], "b int, a string")
    one, two = df.select(artifacts.digest("a", "b").alias("d")).first().d, df.select(artifacts.digest("b", "a").alias("d")).first().d
    assert one == two == hashlib.sha256(b'{"a":"x","b":1}').hexdigest()


def test_checked_outputs_raise(spark):
    df = spark.createDataFrame([("p", 11)], "path string, bits int")
    assert artifacts.checked(df.withColumn("bits", F.lit(10)), F.col("bits")).count() == 1
    with pytest.raises(Exception, match="differs"):
        artifacts.checked(df, F.col("bits")).collect()


def test_only_unchanged_files_are_cached(spark):
    version = "path string, mtime long, size long"
    before, after = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], version), spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], version)
    assert [r.path for r in artifacts.unchanged(before, before, after).collect()] == ["a"]


CANDIDATES = "run int, key long, source int, ts double, score double, h long"


def scorers():
    """Nested, so that they are sent to the tasks by value."""

    def scorer(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": batch["key"], "blog_score": 70.0, "is_transition": batch["key"] < 4, "scene": "s" * 90, "reason": "r"})

    def refuse(batch: pd.DataFrame) -> pd.DataFrame:
        raise ConnectionError("asked again")

    return scorer, refuse


scorer, refuse = scorers()


def test_assessments_resume(spark, tmp_path):
    df = spark.createDataFrame([(1, i, 0, float(i), 1.0, i) for i in range(30)], CANDIDATES)
    first = assess.assess(df.where("key < 10"), scorer, str(tmp_path), "k")
    assert first.count() == 10 and first.select("scene").first()[0] == "s" * 80
    assert assess.assess(df, scorer, str(tmp_path), "k").count() == 30
    assert assess.assess(df, refuse, str(tmp_path), "k").count() == 30  # nothing is left to ask
    assert assess.cache_key("m", "p", "c") != assess.cache_key("m", "pc", "")


def test_replies_are_checked():
    batch = pd.DataFrame({"key": [1, 2]})
    good = scorer(batch)
    assert len(assess.checked_reply(batch, pd.concat([good, good]))) == 2
    for bad in (good.iloc[:1], good.assign(blog_score=101.0), pd.concat([good, good.assign(blog_score=1.0)])):
        with pytest.raises(ValueError):
            assess.checked_reply(batch, bad)
    calls = []

    def flaky(b):
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return scorer(b)

    assert len(assess.ask(flaky, batch, wait=0.0)) == 2 and len(calls) == 3
    with pytest.raises(ConnectionError):
        assess.ask(refuse, batch, wait=0.0)


def test_backfill_goes_on_until_sources_are_covered(spark, tmp_path):
    df = spark.createDataFrame([(1, i, i % 2, float(i), 50.0 - i, i * 4095) for i in range(12)], CANDIDATES)
    done = assess.assess_until_covered(df, df.where("key < 2").select("run", "key"), scorer, str(tmp_path), "k", 2)
    alive = {r.source for r in df.join(done.where("not is_transition"), "key").collect()}
    assert alive == {0, 1}


def test_fallback_scene(spark):
    c, k = spark.createDataFrame([("a",), ("b",)], "path string"), spark.createDataFrame([("a", "s", 0.9)], "path string, scene string, confidence double")
    assert {r.path: (r.scene, r.confidence) for r in assess.with_fallback(c, k).collect()} == {"a": ("s", 0.9), "b": ("fallback", 0.0)}


def test_histogram_metrics(spark):
    hist = [0.0] * 256
    hist[0], hist[255], hist[100] = 2.0, 1.0, 1.0
    c = F.col("h")
    row = spark.createDataFrame([(hist,)], "h array<double>").select(pixels.entropy(c).alias("e"), pixels.share(c, 0, 12).alias("b"), pixels.share(c, 243, 255).alias("w"), pixels.dominant_tone(c).alias("t")).first()
    assert tuple(row) == (1.5, 0.5, 0.25, 0.5)
