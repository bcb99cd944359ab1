"""SimHash near-duplicates by an inverted index over positional bytes, with count filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.llm.common import attach, row_key, rows_of, sliced, table
from nearfold.llm.fingerprints import fingerprint, posting_keys
from nearfold.llm.resemblance import WORDS, resembling, signatures
from nearfold.operators.components import connected_components
from nearfold.scratch import written


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, key: Column | None = None) -> DataFrame:
    """(id, fp, and key as _key if given): fp is the fingerprint as a signed 64-bit number. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text"):
            fps = [fingerprint(t or b"", shingle) for t in part.column(1).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), *part.columns[2:]], ["id", "fp", *part.schema.names[2:]])

    more = [] if key is None else [key.alias("_key")]
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), *more).mapInArrow(run, "id bigint, fp bigint" + ", _key binary" * len(more))


class _Forest:
    """Union-find that keeps only links that join two trees."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def compress(self) -> np.ndarray:
        while not np.array_equal(up := self.root[self.root], self.root):
            self.root = up
        return self.root

    def joining(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        root = self.compress()
        apart = root[a] != root[b]
        kept = []
        for x, y in zip(a[apart].tolist(), b[apart].tolist()):
            i, j = x, y
            while self.root[i] != i:
                i = self.root[i]
            while self.root[j] != j:
                j = self.root[j]
            if i != j:
                self.root[max(i, j)] = min(i, j)
                kept.append((x, y))
        return kept


def _links_of_runs(key: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys, as a spanning forest of them: what it leaves out follows from what it has."""
    values, ids = np.unique(fp, return_inverse=True)
    forest, kept = _Forest(len(values)), []
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
    d, at = 1, np.flatnonzero(key[:-1] == key[1:])
    while at.size:
        x = fp[at] ^ fp[at + d]
        near = np.flatnonzero((x.view(np.uint8).reshape(-1, 8) == 0).sum(1) >= 8 - bits)  # the tally of shared positional bytes
        near = near[np.bitwise_count(x[near]) <= bits]  # verified
        if near.size:
            kept += forest.joining(ids[at[near]], ids[at[near] + d])
        d += 1
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
        if d % 32 == 0 and at.size:  # runs that hang together wholly are done
            root = forest.compress()[ids]
            open_ = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
            at = at[open_[run[at]]]
    a, b = np.array(kept, np.int64).reshape(-1, 2).T
    return values[a], values[b]


def near_links(fps: DataFrame, bits: int = 4, block: int = 20_000) -> DataFrame:
    """(src, dst) between different fingerprints of at most `bits` differing bits, reduced to what keeps them connected.

    fps has the column fp, each value once. Two such fingerprints share at least 8 - bits = 4 of their 8 bytes, hence
    one of 20 covering triples of positional bytes: each triple's value is a posting list. Pairs within a list are
    tallied by all their shared positional bytes, those of four or more verified by their bits. Lists longer than
    `block` are cut into blocks, each pair of which is a run of its own, so none is cut off.
    """
    if bits > 4:
        raise ValueError("the covering triples guarantee a shared list up to 4 bits")
    index = fps.select("fp", F.explode(posting_keys(F.col("fp"))).alias("key"))
    long = written(index.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block), "long_lists")
    # by number, long lists are at most a block-th of all postings; joined as they are where those are many
    heavy = F.broadcast(long) if long.count() <= 100_000 else long.hint("merge")
    blocks = F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    spread = (
        index.join(heavy, "key", "left")
        .withColumn("blocks", blocks)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "fp")
    )
    near_bits = bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = fp = np.zeros(0, np.int64)

        def done(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = _links_of_runs(k, f.view(np.uint64), near_bits)
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["src", "dst"])

        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy()])
            if len(key) < 100_000:
                continue
            cut = int(np.searchsorted(key, key[-1]))  # the last run may go on
            if cut:
                yield done(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        if len(key):
            yield done(key, fp)

    return spread.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "src bigint, dst bigint")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 4, shingle: int = 4, similarity: float | None = None, key: Column | None = None
) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id, and with a key also _key and component.

    Documents whose fingerprints differ in at most `bits` bits are linked; component_id is the smallest id reachable,
    itself included. Equal fingerprints are linked before anything is compared, so copies cost nothing. Texts without
    words have fingerprint zero and are linked like any other. Null ids are never the smallest; a component that has
    no other id has component_id null. Other columns are ignored; component numbers components, those without ids too.

    With a similarity, documents are linked instead if their sets of shingles share at least that part of their union, which
    goes far beyond four bits: the index then also holds words of minimal bytes, and candidates are verified by their
    shingles (resemblance.resembling). Texts without words are then alike among themselves only.
    """
    key = F.lit(None).cast("binary") if key is None else key
    if similarity is None:
        marked = written(fingerprints(docs, id_col, text_col, shingle, key), "fingerprints")
        fps = written(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "fps")
        comp = connected_components(written(near_links(fps, bits), "links"))
        by, nodes = "fp", fps.withColumn("node", F.col("fp"))
    else:
        marked = written(signatures(docs, id_col, text_col, shingle, key).withColumn("row", F.monotonically_increasing_id()), "signatures")
        small = marked.drop("shingles")
        fps = written(small.groupBy("digest").agg(F.min("row").alias("node"), F.min("id").alias("least"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in (*WORDS, "size"))), "classes")
        comp = resembling(fps.filter("size > 0").select("node", *WORDS, "size"), marked.select(F.col("row").alias("node"), "shingles"), similarity)
        by, nodes = "digest", fps
    joined = written(comp.join(nodes.select("node", "least"), "node"), "joined")
    least = joined.groupBy("component").agg(F.min("least").alias("whole"))
    linked = joined.join(least, "component").select("node", "component", "whole")
    whole = nodes.join(linked, "node", "left").select(by, "n", F.coalesce("component", "node").alias("component"), F.coalesce("whole", "least").alias("component_id"))
    shown = marked.select("id", "fp", "_key", *([by] if by != "fp" else []))
    return attach(shown, written(whole, "classes"), [by], "n").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "_key", "component"
    )


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`: four-word shingles, at most four differing bits."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("_key", "component")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id, or the smallest digest among rows without ids.

    Documents are linked if their sets of five-word shingles share 0.8 of their union or more. Null texts count as empty, and texts without words
    are one group. Rows are told apart by id and text, so a row that repeats stays or goes with its repeats; columns may have any names.
    """
    key = row_key(F.col("doc_id"), F.col("text"))
    found = near_duplicates(docs, shingle=5, similarity=0.8, key=key)
    stay = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_key"))).alias("first")).select(F.col("first._key").alias("_key"))
    return rows_of(docs, stay, key)
