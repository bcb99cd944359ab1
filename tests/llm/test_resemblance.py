import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfold.llm import resemblance
from nearfold.llm.fingerprints import hashes_of
from nearfold.llm.resemblance import minimal_bytes, resembling, verified
from nearfold.llm.simhash import near_dedup_stage, near_duplicates


def shingles(text, k=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def groups(texts, similarity=0.8):
    """The smallest index reachable over pairs that share at least `similarity` of their shingles, by comparing all."""
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    pairs = [(a, b) for a, b in combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    while True:
        before = list(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


def made_up(seed=3):
    """Groups of variants, one of them large and loosely linked, texts that resemble by just less, and texts that share nothing."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(100_000)
    texts = []
    for size, edits in [(3, 1), (5, 3), (60, 2), (8, 30), (40, 8)]:
        base = [word() for _ in range(300)]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randint(0, edits)):
                text[rng.randrange(300)] = word()
            texts.append(" ".join(text))
    chain = [word() for _ in range(200)]
    for _ in range(45):  # each is near the one before only
        for _ in range(3):
            chain[rng.randrange(200)] = word()
        texts.append(" ".join(chain))
    texts += [" ".join(word() for _ in range(rng.randint(1, 80))) for _ in range(60)]
    texts += ["a b c", "A B\tC", "a b", "", " \n", "x " * 70_000 + "y", "x " * 70_000 + "z"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [20_000, 15])
def test_groups_against_all_pairs(spark, block):
    texts = made_up()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    if block == 20_000:
        got = {r.doc_id: r.component_id for r in near_duplicates(docs, shingle=5, similarity=0.8).collect()}
        assert [got[k] for k in range(len(texts))] == groups(texts)
        return
    # lists longer than a block are cut, and found again block by block
    rows, sets, seen = [], [], {}
    for k, t in enumerate(texts):
        own = np.unique(hashes_of(t.encode(), 5))
        if len(own) and seen.setdefault(own.tobytes(), k) == k:
            m0, m1 = minimal_bytes(own).view(np.int64).tolist()
            rows.append((k, 0, m0, m1, len(own)))
            sets.append((k, own.view(np.int64).tolist()))
    classes = spark.createDataFrame(rows, "node bigint, fp bigint, m0 bigint, m1 bigint, size bigint")
    comp = {r.node: r.component for r in resembling(classes, spark.createDataFrame(sets, "node bigint, shingles array<bigint>"), 0.8, block, most_sent=10).collect()}
    want = groups([texts[r[0]] for r in rows])
    assert [comp.get(r[0], r[0]) for r in rows] == [rows[w][0] for w in want]


def test_minimal_bytes_are_equal_as_often_as_sets_resemble():
    rng = np.random.default_rng(1)
    same = []
    for _ in range(300):
        common = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 100, dtype=np.uint64)])) for _ in range(2))
        same.append((minimal_bytes(a).view(np.uint8) == minimal_bytes(b).view(np.uint8)).mean())
    assert 0.78 < np.mean(same) < 0.82


def test_an_end_of_many_pairs_is_met_in_pieces(spark, monkeypatch):
    sets = spark.range(200).select(F.col("id").alias("node"), F.when(F.col("id") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(3))).cast("array<bigint>").alias("shingles"))
    pairs = spark.range(1, 200).select(F.lit(0).cast("bigint").alias("a"), F.col("id").alias("b"))
    real = resemblance._met
    monkeypatch.setattr(resemblance, "_met", lambda p, s, end, other: real(p, s, end, other, most=7))
    assert sorted(r.b for r in verified(pairs, sets, 0.8).collect()) == list(range(2, 200, 2))


def test_stage_keeps_one_of_each_group(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(5, base), (3, base + " more"), (None, base + " yet more"), (None, "alone without an id"), (None, "Alone  without an ID"), (8, None), (8, ""), (9, " \n"), (2, "x y z"), (2, "quite another text of its own"), (2, "x y z")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id bigint, text string, _key int, chosen int, row int")
    got = near_dedup_stage(spark, docs, "")
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert [k for k in kept if k[0] == 3] == [(3, base + " more")] and sum(k[0] is None for k in kept) == 1
    assert [k for k in kept if k[0] == 2] == [(2, "quite another text of its own"), (2, "x y z"), (2, "x y z")]
    assert {k[0] for k in kept} == {2, 3, 8, None}
    assert near_dedup_stage(spark, docs.limit(0), "").count() == 0
