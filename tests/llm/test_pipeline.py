import hashlib

import corpus_pipeline
from nearfold.llm.secrets import base_spans
from nearfold.scratch import written
from tests.llm.test_resemblance import groups

SF = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "stage")
        seen.append(docs)
    raw, good, exact, near, clean, packed = seen
    assert all(x.columns == columns for x in seen[:-1])
    rows = [sorted(map(tuple, x.collect())) for x in seen[:-1]]
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r[0] for r in rows[1]}
    assert all(q == 0 or i in kept for i, q in quality.items() if i in {r[0] for r in rows[0]}) and len(kept) < len(rows[0])
    assert set(rows[1]) <= set(rows[0])
    last = {}
    for r in rows[1]:
        last[hashlib.sha256(r[1].encode()).digest()] = r
    assert rows[2] == sorted(last.values())
    assert rows[3] == [r for k, (r, c) in enumerate(zip(rows[2], groups([r[1] for r in rows[2]]))) if c == k]
    assert [r[0] for r in rows[4]] == [r[0] for r in rows[3]]
    for before, after in zip(rows[3], rows[4]):
        assert not base_spans(after[1]) and after[4] == len(after[1])
        assert base_spans(before[1]) or before[1] == after[1]
    pieces = packed.collect()
    assert {r.doc_id for r in pieces} == {r[0] for r in rows[4]}
    fill = {}
    for r in pieces:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    whole = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect())
    assert whole == sorted(tuple(r) for r in packed.drop("sequence_id", "offset").collect())
    assert len({r.sequence_id for r in pieces}) <= -(-sum(r.length for r in pieces) // 2048) * 1.02 + 1


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "stage")
        assert docs.count() == 0


def test_rows_are_judged_one_by_one(spark):
    """A rejected row takes no other row of its id, or without an id, along."""
    text = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id = 1").first().text
    quality, near = corpus_pipeline.STAGES[0][1], corpus_pipeline.STAGES[2][1]
    base = [(i, text, "en", "s", 1) for i in (10, 11, 12)]
    docs = spark.createDataFrame([*base, (None, "", "en", "s", 1), (None, text, "en", "s", 1), (12, "", "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars int")
    real = quality(spark, docs.limit(0), SF).count()
    kept = [(r.doc_id, r.text) for r in quality(spark, docs, SF).collect()]
    assert real == 0 and (None, text) in kept and (12, text) in kept and all(t for _, t in kept)
    rows = [(1, "one two three four five"), (2, "one two three four five"), (2, "quite another text of its own")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(tuple(r) for r in near(spark, docs, SF).collect()) == [rows[0], rows[2]]


def test_stages_keep_columns_of_any_name(spark):
    """Names that the operators use themselves, nulls and repeats, through all stages that return documents."""
    text = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id = 1").first().text
    extra = ["_key", "_gone", "_stays", "chosen", "key", "row", "draw", "kept", "component", "fp", "node", "spans", "size"]
    rows = [(i, t, "en", "s", 1, *range(len(extra))) for i, t in [(1, text), (1, text), (2, text + " and one"), (None, text + "!"), (None, None), (3, "")]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int, " + ", ".join(f"{x} int" for x in extra))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "stage")
        assert docs.columns[5:] == extra and docs.filter(" or ".join(f"{x} <> {k}" for k, x in enumerate(extra))).count() == 0
    assert docs.count() == 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= 1
