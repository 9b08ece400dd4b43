"""The quality classifier: against plain averages, on held-out documents, and on odd inputs."""

from __future__ import annotations

import collections
import zlib

import numpy as np
import pytest

from lumeset.llm import subword_quality as Q

DOCS = "doc_id long, text string, lang string, source string, score double, held_out string, quality int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", 0.1, "x", 9) for i, t in rows], DOCS)


def plain_features(text):
    """Features one by one."""
    words, out = text.encode().split(), collections.Counter()
    one = lambda h: int(Q.mixed(np.array([h % 2**64], np.uint64))[0]) % Q.BUCKETS
    for a, b in zip(words, words[1:]):
        out[one(5) if a == b else one((zlib.crc32(a) * 0x9E3779B97F4A7C15 + zlib.crc32(b) + (1 << 50)))] += 1
    for w in words:
        out[one(zlib.crc32(w) + (1 << 40))] += 1
        s = "<" + w.decode() + ">"
        for n in (3, 4, 5):
            for k in range(len(s) - n + 1):
                h = n
                for c in s[k : k + n]:
                    h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) % 2**64
                out[one(h)] += 1
    return out


TEXTS = ["one two two two three", "", " \n\t", "größe 漢字 a b x", "w" * 50, "a a a\x0bb\x1cc b", "𝔘𝔫𝔦 code"]


@pytest.mark.parametrize("sizes", [{}, {"PIECE": 3, "WINDOW": 2}])
def test_features_and_scores_equal_plain_ones(monkeypatch, sizes):
    for c, v in sizes.items():
        monkeypatch.setattr(Q, c, v)
    rng = np.random.default_rng(1)
    m = Q.Model(rng.normal(0, 1, (Q.BUCKETS, 4)), rng.normal(0, 1, (2, 4)), rng.normal(0, 1, 2))
    for most in (2, 1000):
        scorer = Q.Scorer(m.weights(), m.bias[1] - m.bias[0], most)
        for t in TEXTS:
            want = plain_features(t)
            ids, counts = Q.features(t.encode())
            assert dict(zip(ids.tolist(), counts.tolist())) == dict(want)
            mean = sum((n * m.vectors[i] for i, n in want.items()), np.zeros(4)) / max(1, sum(want.values()))
            odds = m.output @ mean + m.bias
            assert scorer.log_odds(t.encode()) == pytest.approx(odds[1] - odds[0], abs=1e-9)


def test_held_out_documents(spark):
    """Of the fifth that nothing was learned from nearly all labels are found."""
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in Q.op12_subword_quality(spark, d).collect()}
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    asked = [(got[r.doc_id], r.quality) for r in spark.read.parquet(f"{d}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert np.mean([r.predicted == q for r, q in asked]) >= 0.97
    good, bad = ([r.score for r, q in asked if q == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) >= 0.99


def test_odd_documents_and_labels(spark):
    good, bad = "the cat sat on the mat and looked at a dog", "the%%% cat### sat&&& on*** the%%%"
    rows = [(i, good if i % 2 else bad) for i in range(40)] + [(7, good)] * 3 + [(None, good), (100, None), (101, ""), (102, bad * 30_000), (103, "x" * 300_000)]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 0, "z") for i in range(40)] + [(7, 1, 0, "z"), (9, 0, 0, "z"), (11, None, 0, "z"), (None, 1, 0, "z"), (100, 0, 0, "z"), (500, 1, 0, "z"), (13, 5, 0, "z")], "doc_id long, quality int, toxic int, text string")
    found = Q.labelled(docs, labels).collect()
    used = {i for i in range(40) if zlib.crc32(str(i).encode()) % 5} - {9}
    assert sorted(r.doc_id for r in found) == sorted(used)
    got = Q.score(docs, Q.fit(docs, labels, buckets=1 << 10)).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].predicted == i % 2 for i in range(40)) and by[102].predicted == 0 and by[None].predicted == 1 and by[None].held_out is False
    assert by[100].score == by[101].score
    few = Q.labelled(docs, labels, per_label=3).collect()
    assert collections.Counter(r.quality for r in few) == {0: 3, 1: 3}


def test_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = Q.score(docs_of(spark, [(1, "a b")]), Q.fit(docs_of(spark, [(1, "a b")]), none, buckets=64)).collect()
    assert [(r.score, r.predicted) for r in got] == [(0.5, 1)]
    assert Q.score(docs_of(spark, []), Q.fit(docs_of(spark, []), none, buckets=64)).count() == 0
    one = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    assert Q.score(docs_of(spark, [(1, "a b")]), Q.fit(docs_of(spark, [(1, "a b")]), one, buckets=64)).first().score < 0.5
