"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.llm.common import bounded_sample, sliced, table
from nearfold.scratch import written

SPACE = 1 << 20
EDGES = ".,;:!?\"'()[]{}#*$%&|<>-_/\\"


def terms_of(word: str) -> list[int]:
    """Hashes of a word without case and marks at its ends, and of its beginnings of 4 to 7 letters."""
    body = word.lower().strip(EDGES)
    if not body:
        return []
    names = ["w" + body] + [f"{n}{body[:n]}" for n in range(4, 8) if len(body) > n]
    return [xxhash.xxh32_intdigest(x.encode()) % SPACE for x in names]


class Machine:
    """Second-order factorization machine on sets of features, for two classes.

    score = sigmoid(w0 + sum of w_i + sum over pairs of <v_i, v_j>): a pair of terms weighs what their factors say, which
    is learned even for pairs that hardly ever met, and which additive weights can't express.
    """

    def __init__(self, n: int, factors: int = 8, seed: int = 3):
        self.rng = np.random.default_rng(seed)
        self.w0, self.w = 0.0, np.zeros(n)
        self.v = self.rng.normal(0, 0.05, (n, factors))

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        linear = np.bincount(doc, self.w[flat], minlength=len(rows))
        sums = np.zeros((len(rows), self.v.shape[1]))
        np.add.at(sums, doc, self.v[flat])
        squares = np.bincount(doc, (self.v[flat] ** 2).sum(1), minlength=len(rows))
        return self.w0 + linear + 0.5 * ((sums**2).sum(1) - squares)

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -30, 30)))

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, epochs: int = 30, least_steps: int = 3000, rate: float = 0.3, l2_w: float = 1e-5, l2_v: float = 1e-4, batch: int = 64) -> Machine:
        """Adagrad on the logistic loss, for `epochs` rounds or, where that is longer, least_steps batches."""
        share = np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99)
        self.w0 = float(np.log(share / (1 - share)))
        g0, gw, gv = 1e-8, np.full_like(self.w, 1e-8), np.full_like(self.v, 1e-8)
        for _ in range(max(epochs, -(-least_steps * batch // max(1, len(rows))))):
            order = self.rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                own = [rows[k] for k in chosen]
                flat = np.concatenate(own).astype(np.int64)
                doc = np.repeat(np.arange(len(own)), [len(r) for r in own])
                sums = np.zeros((len(own), self.v.shape[1]))
                np.add.at(sums, doc, self.v[flat])
                squares = np.bincount(doc, (self.v[flat] ** 2).sum(1), minlength=len(own))
                raw = self.w0 + np.bincount(doc, self.w[flat], minlength=len(own)) + 0.5 * ((sums**2).sum(1) - squares)
                err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[chosen]) / len(own)
                used, inverse = np.unique(flat, return_inverse=True)
                dw = np.bincount(inverse, err[doc], minlength=len(used)) + l2_w * self.w[used]
                dv = np.zeros((len(used), self.v.shape[1]))
                np.add.at(dv, inverse, err[doc][:, None] * (sums[doc] - self.v[flat]))
                dv += l2_v * self.v[used]
                d0 = err.sum()
                g0 += d0 * d0
                gw[used] += dw * dw
                gv[used] += dv * dv
                self.w0 -= rate * d0 / np.sqrt(g0)
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= rate * dv / np.sqrt(gv[used])
        return self


class _Features(dict):
    """word -> positions of those of its terms that the model has, computed once per distinct word while the cache lasts."""

    def __init__(self, position: dict[int, int]):
        self.position = position

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 500_000:
            self.clear()
        out = self[word] = tuple({self.position[t] for t in terms_of(word) if t in self.position})
        return out

    def of(self, text: str | None) -> np.ndarray:
        found: set[int] = set()
        for x in map(self.__getitem__, set((text or "").split())):
            if x:
                found.update(x)
        return np.array(sorted(found), np.int64)


def learn(docs: DataFrame, labels: DataFrame, sample: int = 12_000, features: int = 4096, least_gain: float = 4.5, factors: int = 8, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[int, int], Machine]:
    """(positions of the terms that the model has, the machine), from at most `sample` labelled rows of each kind, taken by hash.

    labels has doc_id and toxic. The terms are the at most `features` whose counts among the two kinds differ most, in
    different texts, by log likelihood ratio, and by least_gain at least: fewer labels give fewer terms, and none that chance
    explains. Added to them, without limit, are both terms of each pair that tells more than either does alone, by least_gain
    above what the best of so many pairs has by chance. Without `factors` the machine is linear. What goes to the driver are the sample's rows, in terms that may be either.
    """
    known = written(labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "toxic_labels")
    parts = [bounded_sample(known.filter(F.col("toxic") == y), sample).select(F.col("doc_id").alias("id"), "toxic") for y in (0, 1)]
    chosen = F.broadcast(written(parts[0].unionByName(parts[1]), "chosen"))
    mine = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id").select("toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text"):
            rows = [sorted({t for w in set((x or "").split()) for t in terms_of(w)}) for x in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(rows, pa.list_(pa.int32()))], ["toxic", "terms"])

    # copies count once, else their every word would tell
    seen = written(mine.mapInArrow(run, "toxic int, terms array<int>").groupBy("terms").agg(F.max("toxic").alias("toxic")), "terms")
    n = {r.toxic: r.n for r in seen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return {}, Machine(0)
    both = seen.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("c"), F.sum("toxic").alias("a")).filter("c >= 3")
    p = F.lit(n1 / (n0 + n1))
    a, b = F.col("a"), F.col("c") - F.col("a")
    gain = F.when(a > 0, a * F.log(a / (F.col("c") * p))).otherwise(0.0) + F.when(b > 0, b * F.log(b / (F.col("c") * (1 - p)))).otherwise(0.0)
    both = written(both.withColumn("gain", gain).withColumn("open", -(F.when(a > 0, a * F.log(a / F.col("c"))).otherwise(0.0) + F.when(b > 0, b * F.log(b / F.col("c"))).otherwise(0.0))), "counts")
    top = {r.term for r in both.filter(F.col("gain") >= least_gain).orderBy(F.desc("gain"), "term").limit(features).select("term").collect()}
    # no pair of a term gains more over it than what is open of its texts' labels
    m = both.filter(F.col("open") >= least_gain).count()
    least = float(np.log(max(1, m * (m - 1) / 2))) + least_gain
    mixed = both.filter(F.col("open") >= least)
    held = sorted(top | {r.term for r in mixed.select("term").collect()})
    place = np.full(SPACE, -1, np.int32)
    place[held] = np.arange(len(held))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column(1)
            at = place[terms.flatten().to_numpy(zero_copy_only=False)]
            until = np.concatenate([[0], np.cumsum(at >= 0)])[np.concatenate([[0], np.cumsum(pa.compute.list_value_length(terms).to_numpy(zero_copy_only=False))]).astype(np.int64)]
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(until.astype(np.int32), at[at >= 0])], ["toxic", "terms"])

    rows = seen.select("toxic", "terms").mapInArrow(narrow, "toxic int, terms array<int>").toArrow()
    sets = [x for part in rows.column("terms").chunks for x in np.split(part.flatten().to_numpy(), np.cumsum(part.value_lengths().to_numpy())[:-1])]
    toxic = rows.column("toxic").to_numpy()
    order = sorted(range(len(sets)), key=lambda k: (xxhash.xxh3_128_digest(sets[k].tobytes()), toxic[k]))  # the same whatever the partitions
    sets, labels_of = [sets[k] for k in order], toxic[order].astype(float)
    kept = np.array([t in top for t in held], bool)
    kept[paired_terms(docs.sparkSession, sets, labels_of, len(held), least)] = True
    new = np.cumsum(kept, dtype=np.int32) - 1
    sets = [new[x[kept[x]]] for x in sets]
    return {t: int(new[k]) for k, t in enumerate(held) if kept[k]}, Machine(int(kept.sum()), factors).fit(sets, labels_of)


def paired_terms(spark: SparkSession, sets: list[np.ndarray], labels: np.ndarray, n: int, least: float) -> list[int]:
    """The terms, of n, of pairs whose texts are toxic at another rate than those of either term, by log likelihood ratio of at least `least`.

    All pairs that share a text are counted, a term's with all others at a time, by tasks that hold the rows' terms.
    """
    kind = np.uint16 if n <= 1 << 16 else np.int32
    flat = np.concatenate([*(x.astype(kind) for x in sets), np.zeros(0, kind)])
    ends = np.cumsum([0, *map(len, sets)])
    toxic = labels > 0
    c = np.bincount(flat, minlength=n)
    a = sum((np.bincount(sets[k], minlength=n) for k in np.flatnonzero(toxic)), np.zeros(n, np.int64))
    parts = max(1, min(4 * spark.sparkContext.defaultParallelism, n // 16))

    def counts(rows: np.ndarray) -> np.ndarray:
        return np.bincount(np.concatenate([*(flat[ends[d] : ends[d + 1]] for d in rows.tolist()), flat[:0]]), minlength=n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rate = np.zeros(n, bool), a / np.maximum(c, 1)
        for part in (x for batch in batches for x in batch.column(0).to_pylist()):
            low, high = n * part // parts, n * (part + 1) // parts
            mine = np.flatnonzero((flat >= low) & (flat < high))
            mine = mine[np.argsort(flat[mine], kind="stable")]
            of_term = np.split(np.searchsorted(ends, mine, side="right") - 1, np.cumsum(c[low:high])[:-1]) if high > low else []
            for i, rows in zip(range(low, high), of_term):
                if not 0 < rate[i] < 1:
                    continue
                hits, misses = counts(rows[toxic[rows]]), counts(rows[~toxic[rows]])
                both = np.flatnonzero((hits + misses > 0) & (rate > 0) & (rate < 1))
                x, y, other = hits[both], misses[both], rate[both]
                gain = lambda p: x * np.log(np.maximum(x, 1) / ((x + y) * p)) + y * np.log(np.maximum(y, 1) / ((x + y) * (1 - p)))  # noqa: B023, E731
                near = both[np.minimum(gain(rate[i]), gain(other)) >= least]
                found[near] = True
                found[i] |= near.size > 0
        yield pa.record_batch([pa.array(np.flatnonzero(found))], ["term"])

    return sorted(r.term for r in spark.range(0, parts, 1, parts).mapInArrow(run, "term bigint").distinct().collect())


def score(docs: DataFrame, position: dict[int, int], machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text, between 0 and 1. Null and empty texts have no terms and get the model's base score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Features(position)
        for part in sliced(batches, "text"):
            rows = [features.of(t) for t in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(machine.scores(rows))], ["id", "score"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, score double").withColumnRenamed("id", id_col)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`; learned from labels of rows whose crc32(doc_id as text) mod 3 isn't 1.

    A null doc_id isn't held out. Rows that repeat are scored alike; other columns are never read.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, *learn(docs, labels.filter(~held)))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
