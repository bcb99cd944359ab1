import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from nearfold.llm.toxicity import Machine, learn, op3_toxicity, score, terms_of


def auc(pos, neg):
    return np.mean([np.mean(pos > x) + np.mean(pos == x) / 2 for x in neg])


def test_scores_are_the_formula():
    m = Machine(6, 3)
    m.w0, m.w = 0.3, np.arange(6) / 10
    rows = [np.array([0, 2, 5]), np.array([], np.int64), np.array([1])]
    for row, s in zip(rows, m.raw(rows)):
        want = 0.3 + sum(m.w[row]) + sum(m.v[a] @ m.v[b] for k, a in enumerate(row) for b in row[k + 1 :])
        assert abs(s - want) < 1e-12


def test_pairs_that_additive_weights_miss():
    """Toxic if and only if an insult meets a group: neither tells anything by itself."""
    rng = random.Random(1)
    rows, labels = [], []
    for _ in range(1500):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.array(sorted(([0] if insult else []) + ([1] if group else []) + rng.sample(range(2, 30), 4))))
        labels.append(float(insult == group))
    y = np.array(labels)
    m = Machine(30).fit(rows[:1000], y[:1000], epochs=60, rate=0.2)
    s = m.scores(rows[1000:])
    assert auc(s[y[1000:] == 1], s[y[1000:] == 0]) > 0.95
    m.v[:] = 0
    s = m.scores(rows[1000:])
    assert auc(s[y[1000:] == 1], s[y[1000:] == 0]) < 0.7


def test_pairs_through_learning(spark):
    """Toxic if and only if an insult meets a group, in words: the terms that tell only in a pair must reach the machine."""
    rng = random.Random(1)
    rows = []
    for i in range(1500):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = (["moron"] if insult else []) + (["martians"] if group else []) + [f"w{x}" for x in rng.sample(range(40), 5)] + [f"n{i}"]
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(insult == group)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    position, machine = learn(docs, docs.filter("doc_id < 1000").select("doc_id", "toxic"))
    assert {t for w in ("moron", "martians") for t in terms_of(w)} <= set(position)
    got = score(docs.filter("doc_id >= 1000"), position, machine).collect()
    pos, neg = (np.array([r.score for r in got if rows[r.doc_id][2] == y]) for y in (1, 0))
    assert len(got) == 500 and auc(pos, neg) > 0.95
    assert np.mean([(r.score >= 0.5) == rows[r.doc_id][2] for r in got]) > 0.9
    # a linear machine learned from the same rows can't tell
    linear = score(docs.filter("doc_id >= 1000"), *learn(docs, docs.filter("doc_id < 1000").select("doc_id", "toxic"), factors=0)).collect()
    pos, neg = (np.array([r.score for r in linear if rows[r.doc_id][2] == y]) for y in (1, 0))
    assert auc(pos, neg) < 0.7


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    for r in got[:200]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1
    pos, neg = (np.array([r.score for r in got if r.held_out and r.toxic == y]) for y in (1, 0))
    assert auc(pos, neg) > 0.93 and (neg >= 0.7).mean() < 0.005 and (pos >= 0.7).mean() > 0.7


def test_odd_rows(spark):
    rows = [(i, f"this is {'stupid' if i % 2 else 'nice'} text {i}", 1) for i in range(60)] + [(100, None, 1), (101, "", 1), (None, "stupid", 1), (1, "stupid again", 1), (102, "stupid " * 100_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(60)] + [(None, 0, 1), (3, 0, None)], "doc_id bigint, quality int, toxic int")
    position, machine = learn(docs, labels)
    got = score(docs, position, machine).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.score for r in got}
    assert by[102] > 0.7 and by[100] == by[101] < 0.7 and by[2] < 0.3
    again = learn(docs.repartition(5), labels.repartition(2))
    assert again[0] == position and np.allclose(again[1].w, machine.w)
    bare = score(docs, *learn(docs, labels.limit(0))).select(F.min("score"), F.max("score")).first()
    assert bare[0] == bare[1] == 0.5 and score(docs.limit(0), position, machine).count() == 0
