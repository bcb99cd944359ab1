"""Near duplicates by the resemblance of shingle sets, found through the same inverted index over positional bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfold.llm.common import sliced
from nearfold.llm.fingerprints import LISTS, hashes_of, majority, posting_keys
from nearfold.operators.components import connected_components
from nearfold.scratch import written

#: Words of a signature: the SimHash fingerprint, and two of eight bytes each by minima of hash functions.
WORDS = ("fp", "m0", "m1")
_RNG = np.random.default_rng(64)
FACTORS = _RNG.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RNG.integers(0, 1 << 63, 16, dtype=np.uint64)
#: Lists up to this length are compared wholly at once.
SHORT = 32


def minimal_bytes(shingles: np.ndarray) -> np.ndarray:
    """Two 64-bit words; each byte comes from the shingle that a hash function of its own puts first, so it is equal for two sets as often as they resemble."""
    if not len(shingles):
        return np.zeros(2, np.uint64)
    best, at = np.full(16, np.iinfo(np.uint64).max, np.uint64), np.zeros(16, np.uint64)
    for k in range(0, len(shingles), 1 << 13):
        part = shingles[k : k + (1 << 13)]
        value = part[None, :] * FACTORS[:, None] + SHIFTS[:, None]
        first = value.argmin(1)
        least = value[np.arange(16), first]
        at = np.where(least <= best, part[first], at)
        best = np.minimum(least, best)
    return (at >> np.uint64(40)).astype(np.uint8).view("<u8")


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, key: Column) -> DataFrame:
    """(id, _key, digest of the shingle set, fp, m0, m1, size, shingles) of whole texts; null text counts as empty."""
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text"):
            rows = []
            for text in part.column(2).cast(pa.binary()).to_pylist():
                hashes = hashes_of(text or b"", shingle)
                own = np.unique(hashes)
                words = np.concatenate([np.array([majority(hashes)], np.uint64), minimal_bytes(own)]).view(np.int64).tolist()
                rows.append((xxhash.xxh3_128_digest(own.tobytes()), *words, len(own), own.view(np.int64)))
            yield pa.record_batch([*part.columns[:2], *(pa.array(list(c), t) for c, t in zip(zip(*rows), kinds))], ["id", "_key", "digest", *WORDS, "size", "shingles"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), key.alias("_key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id bigint, _key binary, digest binary, fp bigint, m0 bigint, m1 bigint, size bigint, shingles array<bigint>")


def _index(classes: DataFrame, *more: str) -> DataFrame:
    """(key, word, node, size, more): 20 posting lists for each word of a signature."""

    def lists_of(number: int, word: str) -> Column:
        first = F.lit(number * LISTS << 24).cast("bigint")
        return F.transform(posting_keys(F.col(word)), lambda k: F.struct((k + first).alias("key"), F.col(word).alias("word")))

    lists = F.flatten(F.array(*(lists_of(n, w) for n, w in enumerate(WORDS))))
    return classes.select("node", "size", *more, F.explode(lists).alias("x")).select("x.key", "x.word", "node", "size", *more)


class Runs:
    """Rows sorted by key and word, and the pairs of one key that share four of eight positional bytes of the word and can be similar by their sizes."""

    def __init__(self, similarity: float, key: np.ndarray, word: np.ndarray, node: np.ndarray, size: np.ndarray):
        self.similarity, self.key, self.word, self.node, self.size = similarity, key, word, node, size
        self.starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.lengths = np.diff(np.append(self.starts, len(key)))

    def near(self, at: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shared = ((self.word[at] ^ self.word[other]).view(np.uint8).reshape(-1, 8) == 0).sum(1)
        low, high = np.minimum(self.size[at], self.size[other]), np.maximum(self.size[at], self.size[other])
        ok = (shared >= 4) & (low >= self.similarity * high) & (low > 0)
        a, b = self.node[at[ok]], self.node[other[ok]]
        return np.minimum(a, b), np.maximum(a, b)

    def offsets(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, row at an offset of the same key), offset by offset, for the given rows."""
        d = 1
        while rows.size:
            rows = rows[rows + d < len(self.key)]
            rows = rows[self.key[rows] == self.key[rows + d]]
            yield rows, rows + d
            d += 1

    def first_pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b) of all pairs of short lists, and of long ones those with their first row and the next two; keys of the long ones."""
        long = self.lengths > SHORT
        of_long = np.repeat(long, self.lengths)
        found = [self.near(x, y) for x, y in self.offsets(np.flatnonzero(~of_long & np.repeat(self.lengths > 1, self.lengths)))]
        rows = np.flatnonzero(of_long)
        if rows.size:
            found.append(self.near(np.repeat(self.starts, self.lengths)[rows], rows))
            found += [self.near(x, y) for _, (x, y) in zip(range(2), self.offsets(rows))]
        a, b = (np.concatenate([x[k] for x in found] + [np.zeros(0, np.int64)]) for k in (0, 1))
        different = a != b
        return a[different], b[different], self.key[self.starts[long]]


def _by_runs(rows: DataFrame, of_runs, schema: str, apart: bool = False, most: int = 100_000) -> DataFrame:
    """of_runs of all rows (key, word, ...), whole keys and some `most` rows at a time. A key with more comes whole, so callers bound it, or in parts if `apart`."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = [batch.column(c).to_numpy() for c in names]
            held = new if held is None else [np.concatenate([x, y]) for x, y in zip(held, new)]
            if len(held[0]) < most:
                continue
            cut = int(np.searchsorted(held[0], held[0][-1])) or (len(held[0]) if apart else 0)  # the last key may go on
            if cut:
                yield from of_runs(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield from of_runs(*held)

    return rows.repartition("key").sortWithinPartitions("key", "word", "node").mapInArrow(run, schema)


def _met(pairs: DataFrame, sets: DataFrame, end: str, other: str, most: int = 20_000) -> DataFrame:
    """pairs with the shingles of one end. An end of more than `most` pairs is met in pieces, each with a copy of its set."""
    sets = sets.select(F.col("node").alias(end), F.col("shingles").alias(f"of_{end}"))
    hot = written(pairs.groupBy(end).agg(F.ceil(F.count("*") / most).cast("int").alias("pieces")).filter("pieces > 1"), "hot_ends")
    n = hot.count()
    if not n:
        return pairs.join(sets.hint("merge"), end)
    hot = F.broadcast(hot) if n <= 100_000 else hot.hint("merge")
    spread = pairs.join(hot, end, "left").withColumn("piece", F.pmod(F.xxhash64(other), F.coalesce("pieces", F.lit(1))).cast("int")).drop("pieces")
    copies = sets.join(hot, end, "left").withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))).drop("pieces")
    return spread.join(copies.hint("merge"), [end, "piece"]).drop("piece")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets share at least `similarity` of their union."""
    both = _met(_met(pairs.select("a", "b"), sets, "a", "b"), sets, "b", "a")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.filter(shared >= similarity * (F.size("of_a") + F.size("of_b") - shared)).select("a", "b")


def _across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs whose ends aren't known to hang together."""
    end = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    known = pairs.join(end("a"), "a", "left").join(end("b"), "b", "left")
    return known.filter("c_a is null or c_b is null or c_a <> c_b").select("a", "b")


def resembling(classes: DataFrame, sets: DataFrame, similarity: float = 0.8, block: int = 20_000, most_sent: int = 4_000_000) -> DataFrame:
    """(node, component) of those nodes that are linked: shingle sets sharing at least `similarity` of their union.

    classes is (node, fp, m0, m1, size), sets (node, shingles). Candidates share four of the eight positional bytes of some word
    of their signature, so one of its 20 covering triples, whose values are posting lists. Two sets of resemblance 0.8 do so in
    either of the two words of minimal bytes with a chance of 0.990, thus 0.9999 for both; every candidate is verified exactly.

    Pairs within what hangs together already need no verification. So each node's first partner is verified, then the pairs that
    remain between components, then all such pairs of lists that are longer than SHORT. These lists are left out if all
    of one component. The numbers of the nodes that may be compared are broadcast up to `most_sent` (eight bytes each), else their
    sets are found by sort-merge; lists beyond `block` rows are compared block by block, and none is cut off.
    """

    def first(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b, keys = Runs(similarity, *columns).first_pairs()
        pairs = np.unique(np.stack([a, b]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
        yield pa.record_batch([pa.array(np.concatenate([pairs[0], keys])), pa.array([*pairs[1].tolist(), *[None] * len(keys)], pa.int64())], ["a", "b"])

    # long lists are spread over tasks by block, as far as a sample of nodes tells them; what this leaves out is found below
    index, thin = _index(classes), max(1, block // 256)
    seen = _index(classes.filter(F.pmod(F.xxhash64("node", F.lit(7)), F.lit(thin)) == 0)).groupBy("key").agg((F.count("*") * thin).alias("n"))
    counted = written(seen.filter(F.col("n") > block), "long_lists")
    longest = counted.count()
    cut = index
    if longest:
        hot = F.broadcast(counted) if longest <= 100_000 else counted.hint("merge")
        part = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("n") / block))
        cut = index.join(hot, "key", "left").withColumn("key", F.when(F.col("n").isNull(), F.col("key")).otherwise(F.col("key") + F.shiftleft(part.cast("bigint"), 32))).drop("n")
    found = written(_by_runs(cut, first, "a bigint, b bigint", apart=True), "candidates")
    pairs = written(found.filter("b is not null").distinct(), "pairs")
    opened = found.filter("b is null").select(F.col("a").bitwiseAND(F.lit((1 << 32) - 1)).alias("key")).distinct()
    opened = written(opened, "open_lists")
    n_open = opened.count()
    lists = F.broadcast(opened) if n_open <= 100_000 else opened.hint("merge")
    # only sets that may be compared go on
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    if n_open:
        ends = ends.unionByName(index.join(lists, "key", "left_semi").select("node"))
    ends = written(ends.distinct(), "ends")
    few = ends.count() <= most_sent
    sets = written(sets.join(F.broadcast(ends) if few else ends.hint("merge"), "node", "left_semi"), "sets")

    links = written(verified(pairs.groupBy("b").agg(F.min("a").alias("a")), sets, similarity), "links")
    comp = written(connected_components(links, "a", "b"), "components")
    rest = written(_across(pairs, comp), "pairs")
    if not rest.isEmpty():
        links = written(links.unionByName(verified(rest, sets, similarity)), "links")
        comp = written(connected_components(links, "a", "b"), "components")
    if not n_open:
        return comp
    told = classes.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    inner = written(_index(told, "component").join(lists, "key"), "open_rows")
    mixed = written(inner.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).filter("low < high").select("key", "n"), "mixed_lists")
    n_mixed = mixed.count()
    if not n_mixed:
        return comp
    blocks = F.ceil(F.col("n") / block).cast("int")
    spread = (
        inner.join(F.broadcast(mixed) if n_mixed <= 100_000 else mixed.hint("merge"), "key")
        .withColumn("blocks", blocks)
        .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "word", "node", "size", "component")
    )

    def every(key, word, node, size, component) -> Iterator[pa.RecordBatch]:
        runs = Runs(similarity, key, word, node, size)
        for x, y in runs.offsets(np.arange(len(key))):
            apart = component[x] != component[y]
            if apart.any():
                a, b = runs.near(x[apart], y[apart])
                yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    more = written(_across(_by_runs(spread, every, "a bigint, b bigint").distinct(), comp), "pairs")
    links = written(links.unionByName(verified(more, sets, similarity)), "links")
    return written(connected_components(links, "a", "b"), "components")
