"""Packing of tokenized documents into sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import json
import math
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.llm.common import sliced, table
from nearfold.scratch import written

CAPACITY = 2048


#: White space about which libraries might differ.
ODD = "\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


class Tokens:
    """Ids of texts as little-endian 32-bit numbers, the same as the tokenizers library gives.

    Latin-1 texts without special tokens and odd white space, for which the pre-tokenizers can't differ, go to a faster encoder
    over the same vocabulary; all others go to the library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.special = tuple(x["content"] for x in made["added_tokens"])
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
        ranks = {bytes(letters[c] for c in token): k for token, k in made["model"]["vocab"].items() if token not in self.special}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bool:
        if any(c in text for c in ODD) or any(x in text for x in self.special):
            return False
        try:
            return text.isascii() or bool(text.encode("latin-1"))
        except UnicodeEncodeError:
            return False

    def encode(self, text: str) -> bytes:
        ids = self.fast.encode_ordinary(text) if self.plain(text) else self.library.encode(text, add_special_tokens=False).ids
        return np.frombuffer(array("I", ids), np.uint32).astype("<u4", copy=False).tobytes() if ids else b""


@lru_cache(maxsize=2)
def tokens_of(path: str) -> Tokens:
    """One for each worker process."""
    return Tokens(path)


def token_pieces(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and its ids (binary, little-endian 32 bits) if asked for.

    A document is its ids and end_id. One longer than capacity is cut into pieces of capacity, of which the first is
    shorter where they don't come out even. Null texts count as empty and are the end id alone.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(path)
        for part in sliced(batches, "text"):
            rows = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids = tokens.encode(text or "") + end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    size = capacity if at else (n - 1) % capacity + 1
                    cut = ids[4 * at : 4 * (at + size)]
                    rows.append((doc, k, at, size, zlib.crc32(cut), cut) if with_ids else (doc, k, at, size, zlib.crc32(cut)))
                    at, k = at + size, k + 1
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


class Packing:
    """Bins of one block of lengths, and the genetic operations on them. A genome is the bin of each item, numbered from 0."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: list[int], spare: int = 0):
        self.lengths, self.capacity, self.rng, self.spare = lengths.astype(np.int64), capacity, np.random.default_rng(seed), spare
        self.least = -(-int(self.lengths.sum()) // capacity)

    def best_fit(self, bins: np.ndarray, fill: list[int], items: np.ndarray) -> np.ndarray:
        """Places items in the given order, each where least space is left, opening bins where it fits nowhere."""
        cap, lengths = self.capacity, self.lengths
        free: list[list[int]] = [[] for _ in range(cap + 1)]
        mask = 0
        for b, x in enumerate(fill):
            free[cap - x].append(b)
            mask |= 1 << (cap - x)
        for i, size in zip(items.tolist(), lengths[items].tolist()):
            fits = mask >> size
            if fits:
                space = size + (fits & -fits).bit_length() - 1
                b = free[space].pop()
                if not free[space]:
                    mask ^= 1 << space
            else:
                space, b = cap, len(fill)
                fill.append(0)
            fill[b] += size
            bins[i] = b
            free[space - size].append(b)
            mask |= 1 << (space - size)
        return bins

    def falling(self, items: np.ndarray, noise: float = 0.0) -> np.ndarray:
        keys = self.lengths[items] * (1 + noise * self.rng.random(len(items)))
        return items[np.argsort(-keys, kind="stable")]

    def fresh(self, noise: float) -> np.ndarray:
        return self.best_fit(np.full(len(self.lengths), -1), [], self.falling(np.arange(len(self.lengths)), noise))

    def fitness(self, genome: np.ndarray) -> tuple[int, float]:
        """More is better: fewer bins, then bins filled unevenly."""
        fill = np.bincount(genome, self.lengths)
        return -len(fill), float(((fill / self.capacity) ** 2).sum())

    def done(self, genome: np.ndarray) -> bool:
        """No fewer bins are possible; or, where the emptiest bins are packed again, the others waste a quarter of a bin at most."""
        fill = np.bincount(genome, self.lengths)
        return len(fill) <= self.least or bool(self.spare and (self.capacity - np.sort(fill)[self.spare :]).sum() <= self.capacity // 4)

    def cross(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Whole well-filled bins of other go into one; bins of one that hold a copy of their items are dissolved, and what is displaced is placed by best fit."""
        fill = np.bincount(other, self.lengths)
        good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
        chosen = self.rng.choice(good, max(1, len(good) // 3), replace=False)
        injected = np.isin(other, chosen)
        broken = np.unique(one[injected])
        stay = ~np.isin(one, broken)
        bins = np.full(len(one), -1)
        _, bins[injected] = np.unique(other[injected], return_inverse=True)
        n = len(chosen)
        if stay.any():
            _, kept = np.unique(one[stay], return_inverse=True)
            bins[stay] = kept + n
        # the emptiest bins are dissolved too, else their gaps stay
        fills = np.bincount(bins[bins >= 0], self.lengths[bins >= 0])
        worst = np.argsort(fills, kind="stable")[: max(1, len(fills) // 50)]
        bins[np.isin(bins, worst)] = -1
        held = bins >= 0
        _, bins[held] = np.unique(bins[held], return_inverse=True)
        fills = np.bincount(bins[held], self.lengths[held]).astype(int).tolist()
        displaced = self.exchange(bins, fills, np.flatnonzero(~held))
        return self.best_fit(bins, fills, self.falling(displaced))

    def exchange(self, bins: np.ndarray, fill: list[int], displaced: np.ndarray, most: int = 48) -> np.ndarray:
        """Exchanges one or two items of a bin for one or two displaced ones that fill it better; returns the items displaced then.

        What is displaced gets smaller or fewer, so that best fit places it more easily. Of many displaced items a random `most` are tried
        a bin, and bins in random order.
        """
        out = displaced.tolist()
        order = np.argsort(bins, kind="stable")
        ends = np.searchsorted(bins[order], np.arange(len(fill) + 1))
        for b in self.rng.permutation(len(fill)).tolist():
            gap = self.capacity - fill[b]
            if not gap or not out:
                continue
            own = order[ends[b] : ends[b + 1]]
            tried = np.array(out if len(out) <= most else [out[k] for k in self.rng.choice(len(out), most, replace=False)])
            taken, give = self._ones_and_twos(own), self._ones_and_twos(tried)
            at = np.searchsorted(give[0], taken[0] + gap, side="right") - 1
            gain = np.where(at >= 0, give[0][np.maximum(at, 0)] - taken[0], 0)
            best = int(gain.argmax())
            if gain[best] <= 0:
                continue
            leave = {int(x) for x in own[taken[1][best]]}
            enter = {int(x) for x in tried[give[1][at[best]]]}
            for x in leave:
                bins[x] = -1
            for x in enter:
                bins[x] = b
            fill[b] += int(gain[best])
            out = [x for x in out if x not in enter] + sorted(leave)
        return np.array(out, np.int64)

    def _ones_and_twos(self, items: np.ndarray, most: int = 24) -> tuple[np.ndarray, np.ndarray]:
        """Sums of all single items and of pairs among at most the first `most`, in order, and the positions of their items, the same twice for single ones."""
        n = len(items)
        i, j = np.triu_indices(min(n, most))
        more = np.arange(min(n, most), n)
        i, j = np.concatenate([i, more]), np.concatenate([j, more])
        size = self.lengths[items]
        sums = size[i] + np.where(i == j, 0, size[j])
        order = np.argsort(sums, kind="stable")
        return sums[order], np.stack([i, j], 1)[order]

    def evolve(self, genomes: list[np.ndarray], generations: int) -> list[np.ndarray]:
        """Best first. Ends early when the best is done."""
        ranked = sorted(((self.fitness(g), -k, g) for k, g in enumerate(genomes)), key=lambda x: x[:2], reverse=True)
        for t in range(generations):
            if len(self.lengths) < 2 or self.done(ranked[0][2]):
                break
            a, b = self.rng.choice(len(ranked), 2, replace=len(ranked) < 2)
            child = self.cross(ranked[a][2], ranked[b][2])
            ranked.append((self.fitness(child), -len(genomes) - t, child))
            ranked = sorted(ranked, key=lambda x: x[:2], reverse=True)[: len(genomes)]
        return [g for *_, g in ranked]


def pack(
    items: DataFrame, capacity: int = CAPACITY, block: int = 4096, islands: int = 2, population: int = 6, epochs: int = 3, generations: int = 12, spare: int = 8, seed: int = 7
) -> DataFrame:
    """(rid, sequence_id, place) for items (rid unique, length at most capacity), with as few sequences as it can.

    Items are spread by hash over blocks of about `block`; no task holds more. A block is evolved on several islands at once,
    each a row of its own; between epochs every island's elite migrates to the next island of its block. A block is done when
    its total length demands the bins that it needs, or all but its `spare` emptiest together waste a quarter of one at most. The `spare` emptiest bins of every block are dissolved, and their items go through the
    same in blocks of their own, until one block is left: so blocks lose that quarter each, and one sequence together.
    Items of the full capacity are sequences of their own. The state of each epoch is a table in the shared folder.
    """
    left, done, level = written(items.filter(F.col("length") < capacity).select("rid", "length"), "items"), [], 0
    while True:
        blocks = max(1, math.ceil(left.count() / block))
        placed = written(_pack_blocks(left, blocks, capacity, islands, population, epochs, generations, spare if blocks > 1 else 0, [seed, level]), "placed")
        done.append(placed.filter("not spare").select("rid", (F.col("sequence_id") + (level << 56)).alias("sequence_id"), "place"))
        if blocks == 1:
            break
        left, level = placed.filter("spare").select("rid", "length"), level + 1
    full = items.filter(F.col("length") == capacity).select("rid", (-1 - F.col("rid")).alias("sequence_id"), F.lit(0).cast("bigint").alias("place"))
    for x in done:
        full = full.unionByName(x)
    return full


def _pack_blocks(part: DataFrame, blocks: int, capacity: int, islands: int, population: int, epochs: int, generations: int, spare: int, seed: list[int]) -> DataFrame:
    """(rid, length, sequence_id, place, spare) of items spread over blocks that evolve each by itself; spare marks those in the emptiest bins."""
    spark = part.sparkSession
    held = written(
        part.groupBy(F.pmod(F.xxhash64("rid", F.lit(seed[0] + 1000 * seed[1])), F.lit(blocks)).alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("rid", F.col("length").cast("int").alias("length")))).alias("x"))
        .select("block", "x.rid", F.col("x.length").alias("lengths")),
        "blocks",
    )
    at_once = max(1, min(blocks * islands, 4 * spark.sparkContext.defaultParallelism, 100_000) if blocks * islands < 4000 else blocks * islands // 16)

    def run(epoch: int):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = {name: batch.column(name)[k] for name in batch.schema.names}
                    number, island = row["block"].as_py(), row["island"].as_py()
                    work = Packing(row["lengths"].values.to_numpy(), capacity, [*seed, number, island, epoch], spare)
                    if epoch == 0:
                        genomes = [work.fresh(0.0 if j == 0 and island == 0 else 0.15 * (j + island)) for j in range(population)]
                    else:
                        genomes = [np.frombuffer(g, "<i4").astype(np.int64) for g in [row["elite"].as_py(), *row["genomes"].as_py()]]
                    genomes = work.evolve(genomes, generations)[:population]
                    bins, total = work.fitness(genomes[0])
                    open_ = not work.done(genomes[0])
                    if not open_:
                        genomes = genomes[:1]  # nothing is left to win
                    yield pa.record_batch(
                        [pa.array([number]), pa.array([island], pa.int32()), pa.array([row["lengths"].as_py()], pa.list_(pa.int32())),
                         pa.array([[g.astype("<i4").tobytes() for g in genomes]], pa.list_(pa.binary())), pa.array([-bins]), pa.array([total]), pa.array([open_])],
                        ["block", "island", "lengths", "genomes", "bins", "fitness", "open"],
                    )

        return step

    schema = "block bigint, island int, lengths array<int>, genomes array<binary>, bins bigint, fitness double, open boolean"
    begin = held.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths")
    state = written(begin.repartition(at_once, "block", "island").mapInArrow(run(0), schema), "islands")
    for epoch in range(1, epochs):
        alive = state.groupBy("block").agg(F.min("open").alias("alive")).filter("alive").select("block")
        alive = written(alive, "alive")
        if alive.isEmpty():
            break
        elite = state.join(alive.hint("merge"), "block", "left_semi").select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("genomes")[0].alias("elite"))
        moved = state.join(elite.hint("shuffle_hash"), ["block", "island"])
        rest = state.join(alive.hint("merge"), "block", "left_anti")
        state = written(moved.repartition(at_once, "block", "island").mapInArrow(run(epoch), schema).unionByName(rest), "islands")
    best = state.groupBy("block").agg(F.max_by(F.col("genomes")[0], F.struct(-F.col("bins"), "fitness", -F.col("island"))).alias("genome"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                bins = np.frombuffer(batch.column("genome")[k].as_py(), "<i4").astype(np.int64)
                rid, lengths = batch.column("rid")[k].values.to_numpy(), batch.column("lengths")[k].values.to_numpy().astype(np.int64)
                order = np.argsort(bins, kind="stable")
                before = np.cumsum(lengths[order]) - lengths[order]
                first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
                offset = np.empty(len(bins), np.int64)
                offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
                fill = np.bincount(bins, lengths)
                few = min(spare, max(1, len(fill) // 4), len(fill) - 1)  # what is packed again is always a part
                emptiest = np.isin(bins, np.argsort(fill, kind="stable")[:few])
                number = batch.column("block")[k].as_py()
                yield pa.record_batch([pa.array(rid), pa.array(lengths), pa.array(bins + (number << 24)), pa.array(offset), pa.array(emptiest)], ["rid", "length", "sequence_id", "place", "spare"])

    return held.join(best, "block").select("block", "rid", "lengths", "genome").mapInArrow(place, "rid bigint, length bigint, sequence_id bigint, place bigint, spare boolean")


def packed_pieces(docs: DataFrame, path: str | None = None, with_ids: bool = False, capacity: int = CAPACITY, **options) -> DataFrame:
    """The pieces of documents, with the sequence each is in and its offset there. Rows that repeat are packed each; an empty table packs into nothing."""
    pieces = written(token_pieces(docs, path, capacity=capacity, with_ids=with_ids).withColumn("rid", F.monotonically_increasing_id()), "pieces")
    placed = pack(pieces.select("rid", "length"), capacity, **options)
    return pieces.join(placed, "rid").drop("rid").withColumnRenamed("place", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, each of at most capacity ids, from pieces that carry ids."""
    whole = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    return whole.select("sequence_id", F.aggregate(F.col("x.ids"), F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` into sequences of at most 2048 tokens."""
    return packed_pieces(table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and where they are packed."""
    return packed_pieces(docs)
