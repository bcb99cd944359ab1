"""Quality classifier by importance resampling over hashed n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.llm.common import bounded_sample, row_key, rows_of, sliced, table
from nearfold.scratch import written

WORDS, PAIRS, SHAPES = 4096, 4096, 64
BUCKETS = WORDS + PAIRS + 2 * SHAPES * SHAPES
BLANK = re.compile(rb"[\x20\x09-\x0D]")


def shape(word: str) -> int:
    """What a word looks like, as a number below 64: case, digits, symbols and length."""
    body = word.strip(".,;:?\"'()")
    case = 0 if body.islower() else 1 if body[:1].isupper() and body[1:].islower() or len(body) == 1 and body.isupper() else 2 if body.isupper() else 3
    odd = 3 if not any(c.isalnum() for c in body) else 2 if any(c in "#*$%&|<>!{}[]=\\^~@_" for c in body) else 1 if any(c.isdigit() for c in body) else 0
    size = 0 if len(word) < 4 else 1 if len(word) < 9 else 2 if len(word) < 20 else 3
    return case * 16 + odd * 4 + size


class _Codes(dict):
    """word -> hash and shape in one number, computed once per distinct word while the cache lasts."""

    def __missing__(self, word: bytes) -> int:
        out = (xxhash.xxh32_intdigest(word) << 6) | shape(word.decode("utf-8", "replace"))
        if len(word) <= 64:  # what is cached is bounded in bytes too
            if len(self) > 500_000:
                self.clear()
            self[word] = out
        return out


_codes = _Codes()


def cut(text: bytes, most: int) -> Iterator[tuple[bytes, bool]]:
    """(part, whether its first word is the last of the part before) of a text: parts of about `most` bytes between blanks, a longer word stays whole."""
    start = end = 0
    carried = False
    while end < len(text):
        blank = BLANK.search(text, min(len(text), end + most))
        end = blank.start() if blank else len(text)
        part = text[start:end].rstrip()
        yield part, carried
        last = part.rsplit(None, 1)[-1:]
        carried = bool(last)
        start = start + len(part) - len(last[0]) if last else end


def grams(texts: list[bytes], most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """grams_of all texts; a longer one that comes alone, as from sliced, in parts, so that what is held at once doesn't grow with it."""
    if len(texts) == 1 and len(texts[0]) > most:
        yield from (grams_of([part], carried) for part, carried in cut(texts[0], most))
    else:
        yield grams_of(texts)


def grams_of(texts: list[bytes], carried: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of all n-grams: words, pairs of words, and pairs of shapes with whether the same word comes twice. The first word of all is left out if carried."""
    split = [t.split() for t in texts]  # the six blanks
    sizes = [len(x) for x in split]
    code = np.fromiter((_codes[w] for x in split for w in x), np.int64, sum(sizes))
    doc = np.repeat(np.arange(len(texts)), sizes)
    word, look = code >> 6, code & 63
    a = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, np.int64)
    b = a + 1
    pair = (word[a] * 0x9E3779B1 + word[b] * 0x85EBCA77) >> 20
    buckets = [word[carried:] % WORDS, WORDS + pair % PAIRS, WORDS + PAIRS + (look[a] * SHAPES + look[b]) * 2 + (word[a] == word[b])]
    return np.concatenate(buckets), np.concatenate([doc[carried:], doc[a], doc[a]])


def count_grams(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, raw, target): n-grams of all documents, and of those whose ids are in `chosen`, which is of bounded size."""
    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        F.broadcast(chosen.select(F.col("doc_id").alias("id"), F.lit(True).alias("is_target")).distinct()), "id", "left"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for part in sliced(batches, "text"):
            good = np.array([bool(x) for x in part.column(1).to_pylist()])
            for bucket, doc in grams([t or b"" for t in part.column(0).cast(pa.binary()).to_pylist()]):
                counts[0] += np.bincount(bucket, minlength=BUCKETS)
                counts[1] += np.bincount(bucket[good[doc]], minlength=BUCKETS)
        at = np.flatnonzero(counts[0])
        yield pa.record_batch([pa.array(at), pa.array(counts[0][at]), pa.array(counts[1][at])], ["bucket", "raw", "target"])

    parts = marked.select("text", "is_target").mapInArrow(run, "bucket bigint, raw bigint, target bigint")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: list, smooth: float = 1.0) -> np.ndarray:
    """log of the target's probability of each bucket over the raw one's, add-one smoothed."""
    raw, target = np.full(BUCKETS, smooth), np.full(BUCKETS, smooth)
    for r in counts:
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def log_weights(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None) -> DataFrame:
    """(id, n_grams, log_weight, and key as _key if given): log of the target model's likelihood of a whole text over the raw model's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text"):
            n = part.num_rows
            sizes, sums = np.zeros(n, np.int64), np.zeros(n)
            for bucket, doc in grams([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]):
                sizes += np.bincount(doc, minlength=n)
                sums += np.bincount(doc, ratios[bucket], minlength=n)
            yield pa.record_batch(
                [part.column(0), pa.array(sizes), pa.array(sums), *part.columns[2:]],
                ["id", "n_grams", "log_weight", *part.schema.names[2:]],
            )

    more = [] if key is None else [key.alias("_key")]
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), *more).mapInArrow(
        run, "id bigint, n_grams bigint, log_weight double" + ", _key binary" * len(more)
    )


def kth_largest(rows: DataFrame, key: str, k: int, few: int = 2000) -> float:
    """The k-th largest value of a double column without nulls, found by counting in ever narrower ranges."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    while True:
        inside = rows.filter((F.col(key) >= low) & (F.col(key) <= high))
        width = (high - low) / 512
        if width <= abs(high) * 1e-13 + 1e-300:
            return low
        bins = F.least(F.floor((F.col(key) - low) / width), F.lit(511))
        found = inside.groupBy(bins.alias("bin")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()  # at most 512
        for r in sorted(found, key=lambda r: -r.bin):
            if k <= r.n:
                break
            k -= r.n
        low, high, n = r.low, r.high, r.n
        if low == high:
            return low
        if n <= few:
            ends = rows.filter((F.col(key) >= low) & (F.col(key) <= high)).select(key).collect()
            return sorted((x[0] for x in ends), reverse=True)[k - 1]


def best_cut(good: np.ndarray, bad: np.ndarray, loss: float) -> float:
    """The score at which losing good texts, `loss` times as grave, and passing bad ones cost least; midway between the two scores there."""
    if not len(good) or not len(bad):
        return -np.inf
    scores = np.concatenate([good, bad])
    order = np.argsort(scores, kind="stable")
    cost_good = np.concatenate([np.full(len(good), loss / len(good)), np.zeros(len(bad))])[order]
    cost_bad = np.concatenate([np.zeros(len(good)), np.full(len(bad), 1 / len(bad))])[order]
    cost = np.concatenate([[0], np.cumsum(cost_good)]) + cost_bad.sum() - np.concatenate([[0], np.cumsum(cost_bad)])
    at = int(np.argmin(cost))
    ends = scores[order]
    return -np.inf if at == 0 else np.inf if at == len(ends) else float((ends[at - 1] + ends[at]) / 2)


def gumbel(key: Column, seed: int) -> Column:
    """Standard Gumbel noise that depends on key and seed only."""
    return -F.log(-F.log((F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)))


def resample(
    docs: DataFrame, labels: DataFrame, share: float | None = None, sample: int = 20_000, scale: float = 8.0, loss: float = 8.0, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None
) -> DataFrame:
    """One row per row of docs: id, n_grams, log_weight, score, draw, kept.

    The raw model counts the n-grams of all documents, the target model those of at most `sample` documents labelled good
    (quality = 1), taken by hash. A text's log weight is the log of their ratio; score is its mean per n-gram, and draw is
    scale * score plus Gumbel noise of (doc_id, seed): the documents with the k largest draws are a sample without
    replacement in proportion to exp(scale * score). The mean, as if every text had `scale` n-grams, keeps long texts
    from winning by their length alone; `scale` is the inverse temperature: the smaller, the more chance decides.

    k is `share` of all documents that have words, or where share is None the number of them that score above the cut which
    tells good from bad best on the labelled samples (losing a good one counts `loss` times). Rows whose draw equals the k-th
    are all kept, such as repeated rows. Without any labels of either kind everything with words is kept. Null and empty
    texts have no weight and are rejected. Null ids share one noise. Other columns are ignored.
    """
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    marks = written(marks, "quality_labels")
    good, bad = (written(bounded_sample(marks.filter(F.col("quality") == q), sample).select("doc_id"), "chosen") for q in (1, 0))
    ratios = log_ratios(count_grams(docs, good, id_col, text_col).collect())  # one row per bucket
    weighed = log_weights(docs, ratios, id_col, text_col, key).withColumn("score", F.when(F.col("n_grams") > 0, F.col("log_weight") / F.col("n_grams")))
    drawn = written(weighed.withColumn("draw", scale * F.col("score") + gumbel(F.col("id"), seed)), "draws")
    real = drawn.filter("score is not null")
    n = real.count()
    if share is not None:
        k = int(n * share)
    else:
        # ids that repeat may bring more rows than the sample has: the same ones whatever the partitions
        known = [np.array([r.score for r in real.join(F.broadcast(x), real.id == x.doc_id).select("id", "score").orderBy(F.xxhash64("id"), "score").limit(2 * sample).collect()]) for x in (good, bad)]
        k = real.filter(F.col("score") >= best_cut(*known, loss)).count()
    least = kth_largest(real, "draw", k) if 0 < k <= n else np.inf
    return drawn.withColumn("kept", F.coalesce(F.col("draw") >= F.lit(float(least)), F.lit(False))).withColumnRenamed("id", id_col)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`, learned from all of them and from `labels`."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are drawn. Rows of one id and text are drawn or rejected together."""
    key = row_key(F.col("doc_id"), F.col("text"))
    gone = resample(docs, table(spark, sf_dir, "labels"), key=key).filter("not kept").select("_key").distinct()
    return rows_of(docs, gone, key, "left_anti")
