"""Streams of candidates that are scored once."""

import collections
import uuid

import pandas as pd
import pytest

from lumeset.streaming import assessments


def arrivals(spark, folder, parts):
    for rows in parts:
        spark.createDataFrame(rows, "key long, score double, scene string").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("key long, score double, scene string").option("maxFilesPerTrigger", 1).parquet(folder)


def test_replayed_candidates_are_scored_once_and_failures_again(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def scorer(f: pd.DataFrame) -> pd.DataFrame:
        key = int(f["key"].iloc[0])
        n = sum(p.name.startswith(f"{key}-") for p in calls.iterdir())
        (calls / f"{key}-{n}").touch()
        if key == 3 and n < 2:
            raise OSError("not there")
        return f.assign(blog_score=f["score"], is_transition=False, reason="")[["key", "blog_score", "is_transition", "scene", "reason"]]

    rows = [(k, float(k), "s" if k != 4 else None) for k in range(6)]
    stream = arrivals(spark, str(tmp_path / "in"), [rows[:4], rows[2:] + rows[:1], [(None, 1.0, "x"), *rows]])
    got = assessments.run_to(assessments.scored_once(stream, scorer, wait=0.3), str(tmp_path / "out"), seconds=14.0).collect()
    assert sorted((r.key, r.blog_score, r.tries) for r in got) == [(k, float(k), 3 if k == 3 else 1) for k in range(6)]
    assert sorted(p.name for p in calls.iterdir()) == sorted([f"{k}-0" for k in range(6)] + ["3-1", "3-2"])

    # a restart from the checkpoint asks for nothing again
    more = arrivals(spark, str(tmp_path / "in"), [[*rows, (9, 9.0, "s")]])
    got = assessments.run_to(assessments.scored_once(more, scorer, wait=0.3), str(tmp_path / "out"), seconds=6.0).collect()
    assert sorted(r.key for r in got) == [*range(6), 9]


def test_an_invalid_reply_is_not_asked_for_again(spark, tmp_path):
    stream = arrivals(spark, str(tmp_path / "in"), [[(1, 500.0, "s")]])
    bad = lambda f: f.assign(blog_score=f["score"], is_transition=False, reason="")
    with pytest.raises(Exception, match="between 0 and 100"):
        assessments.run_to(assessments.scored_once(stream, bad, wait=0), str(tmp_path / "out"))


def test_without_waits_candidates_are_asked_about_in_batches(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def scorer(f: pd.DataFrame) -> pd.DataFrame:
        (calls / uuid.uuid4().hex).write_text(" ".join(map(str, f["key"])))
        if 30 in set(f["key"]) and sum("30" in p.read_text().split() for p in calls.iterdir()) < 3:
            raise OSError("not there")
        return f.assign(blog_score=f["score"], is_transition=False, reason="")[["key", "blog_score", "is_transition", "scene", "reason"]]

    rows = [(k, k % 100 + 0.5, "s" if k % 7 else None) for k in range(400)]
    stream = arrivals(spark, str(tmp_path / "in"), [rows[:250], [*rows[100:], (None, 1.0, "x")], rows])
    scored = lambda s: assessments.run_to(assessments.scored_once(s, scorer, wait=0, batch=50), str(tmp_path / "out")).collect()
    got = scored(stream)
    assert sorted((r.key, r.blog_score, r.scene) for r in got) == rows
    tries = {r.key: r.tries for r in got}
    asked = collections.Counter(int(k) for p in calls.iterdir() for k in p.read_text().split())
    assert asked == tries and tries[30] == 3 and sorted(set(tries.values())) == [1, 2, 3] and sum(n > 1 for n in tries.values()) <= 50
    assert sum(len(p.read_text().split()) > 1 for p in calls.iterdir()) < 30  # not one by one

    # a restart from the checkpoint asks for nothing again
    assert sorted(r.key for r in scored(arrivals(spark, str(tmp_path / "in"), [[*rows, (900, 9.0, "s")]]))) == [*range(400), 900]
    assert sum(len(p.read_text().split()) for p in calls.iterdir()) == sum(tries.values()) + 1
