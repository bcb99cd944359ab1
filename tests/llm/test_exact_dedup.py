import hashlib

from pyspark.sql import functions as F

from nearfold.llm.common import attach
from nearfold.llm.digest_index import DigestIndex, exact_dedup_stage

SCHEMA = "doc_id bigint, text string, digest string, n int"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


def test_groups_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b" * 100_000), (6, "A"), (6, "A"), (None, "c"), (None, "a")]
    got = DigestIndex(spark).deduplicate(make(spark, rows), "b").collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    a = by[hashlib.sha256(b"a").hexdigest()]
    assert {r.keep_id for r in a} == {2} and {r.group_size for r in a} == {3} and [r.doc_id for r in a if r.kept] == [2]
    empty = by[hashlib.sha256(b"").hexdigest()]
    assert [r.doc_id for r in empty if r.kept] == [4] and len(empty) == 2
    twice = by[hashlib.sha256(b"A").hexdigest()]
    assert len(twice) == 2 and sum(r.kept for r in twice) == 1
    alone = by[hashlib.sha256(b"c").hexdigest()]
    assert alone[0].kept and alone[0].keep_id is None


def test_index_persists_appends_and_repeats_a_batch(spark):
    index = DigestIndex(spark, buckets=3)
    index.deduplicate(make(spark, [(1, "a"), (2, "b")]), "one")
    again = DigestIndex(spark, index.path)
    assert again.buckets == 3
    got = {r.doc_id: r for r in again.deduplicate(make(spark, [(7, "b"), (8, "c"), (9, "c")]), "two").collect()}
    assert (got[7].kept, got[7].keep_id) == (False, 2)
    assert (got[8].kept, got[9].kept, got[8].keep_id) == (False, True, 9)
    repeat = {r.doc_id: r.kept for r in again.deduplicate(make(spark, [(7, "b"), (8, "c"), (9, "c")]), "two").collect()}
    assert repeat == {7: False, 8: False, 9: True} and again.table().count() == 3
    plan = again.table().groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # bucketed by digest
    tables = len(spark.catalog.listTables())
    again.close()
    assert len(spark.catalog.listTables()) == tables - 1 and DigestIndex(spark, index.path).table().count() == 3
    gone = DigestIndex(spark)
    found = gone.deduplicate(make(spark, [(1, "a"), (2, "a")]), "one")
    gone.close(delete=True)
    assert sorted(r.kept for r in found.collect()) == [False, True] and len(spark.catalog.listTables()) == tables


def test_empty_table_and_stage(spark):
    assert DigestIndex(spark).deduplicate(make(spark, []), "b").count() == 0
    docs = make(spark, [(1, "a"), (2, "a"), (2, "a"), (None, None), (None, ""), (3, "z")])
    kept = exact_dedup_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (2, "a"), (3, "z")]


def test_attach_with_hot_keys(spark):
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = attach(rows, groups, ["k"], "n", hot_least=100)
    assert got.count() == 3000
    assert got.filter("(k = 0 and top = 2997 and n = 1000) or (k = id and top = id)").count() == 3000
