"""SentencePiece encoding and decoding: Viterbi over a trie of distinct marked words, forward scores shared along prefixes."""

from __future__ import annotations

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

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
NOTHING = (1 << 23) - 1


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            yield number, varint()
        elif kind == 2:
            n = varint()
            yield number, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield number, data[at : at + n]
            at += n


class Model:
    """A SentencePiece model file: pieces, scores, kinds and the settings that matter here."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.kind, self.byte_fallback, self.prefix, self.tight, normalizer = UNIGRAM, False, True, True, "identity"
        for number, value in _fields(data):
            if number == 1:
                x = dict(_fields(value))
                self.pieces.append(x[1].decode())
                self.scores.append(float(np.frombuffer(x.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kinds.append(x.get(3, NORMAL))
            elif number == 2:
                x = dict(_fields(value))
                self.kind, self.byte_fallback = x.get(3, UNIGRAM), bool(x.get(35, 0))
            elif number == 3:
                x = dict(_fields(value))
                normalizer = x.get(1, b"identity").decode()
                self.prefix, self.tight = bool(x.get(3, 1)), bool(x.get(4, 1))
                if x.get(2):
                    raise ValueError("only models without a character map are supported")
        if self.kind not in (UNIGRAM, BPE) or normalizer != "identity" or self.tight or USER in self.kinds:
            raise ValueError("only unigram and BPE models with the identity normalizer are supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece goes over the end of a marked word")


class Encoder:
    """Encodes marked words: runs of marks and what follows them, which no piece of the model goes beyond.

    Distinct words are sorted, which walks their trie depth-first: a stack holds the forward state of each prefix, and the
    next word goes on from the longest prefix it shares with the last one. The state at a position is the best score and
    the piece that ends there. For a unigram model that is the usual Viterbi maximum of summed scores. For a BPE model a
    path is allowed only if every two neighbouring pieces stay as they are when their characters are merged alone; exactly
    one path per prefix is, and it is the one that merging gives, so the forward state is its last piece. Characters that no
    piece begins or ends with are unknown: they stand alone, as their bytes if the model falls back to bytes.
    """

    def __init__(self, model: Model, most: int = 500_000, most_pairs: int = 1_000_000):
        self.model, self.most, self.most_pairs = model, most, most_pairs
        self.known: dict[str, bytes] = {}
        self.pair: dict[int, bool] = {}  # left piece * 2^24 + piece; without a left piece, 2^23 - 1
        # every suffix of a piece; its id where it is a piece itself, else -1
        self.suffix = {p[k:]: -1 for p in model.ids for k in range(len(p))} | model.ids
        if model.kind == BPE and any(c not in model.ids for p in model.ids for c in p):
            raise ValueError("a piece has a character that is no piece")

    def merge(self, text: str) -> list[str]:
        """Merges as the model's scores say, best first and leftmost among equals."""
        ids, scores = self.model.ids, self.model.scores
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _allowed(self, key: int) -> bool:
        """Whether a piece may follow the left one: merging the characters of both gives both."""
        left, piece = key >> 24, self.model.pieces[key & 0xFFFFFF]
        both = [piece] if left == NOTHING else [self.model.pieces[left], piece]
        if len(self.pair) >= self.most_pairs:
            self.pair.clear()
        out = self.pair[key] = self.merge("".join(both)) == both
        return out

    def _merged(self, word: str, shared: int, states: list[int]) -> None:
        """Forward states of a BPE model: the id of the piece that ends at each position, NOTHING after an unknown character."""
        suffix, pair = self.suffix.get, self.pair.get
        for end in range(shared + 1, len(word) + 1):
            start = end - 1
            found = NOTHING
            while start >= 0:
                i = suffix(word[start:end])
                if i is None:
                    break
                if i >= 0:
                    key = states[start] << 24 | i
                    ok = pair(key)
                    if ok is None:
                        ok = self._allowed(key)
                    if ok:
                        found = i
                        break
                start -= 1
            states.append(found)

    def _best(self, word: str, shared: int, states: list[tuple]) -> None:
        """Forward states of a unigram model: the best score of a prefix and the piece it ends with."""
        scores, suffix = self.model.scores, self.suffix.get
        worst = min(scores) - 10  # an unknown character costs more than any piece
        for end in range(shared + 1, len(word) + 1):
            best, start = (states[end - 1][0] + worst, None), end - 1
            while start >= 0 and (i := suffix(word[start:end])) is not None:
                if i >= 0 and states[start][0] + scores[i] > best[0]:
                    best = (states[start][0] + scores[i], i)
                start -= 1
            states.append(best)

    def words(self, distinct: list[str]) -> None:
        """Encodes words that aren't known yet, in sorted order."""
        todo = sorted(w for w in distinct if w not in self.known)
        if len(self.known) + len(todo) > self.most:
            self.known.clear()
            todo = sorted(distinct)
        bpe = self.model.kind == BPE
        pieces_of = self.model.pieces
        last, states = "", [NOTHING if bpe else (0.0, None)]
        for word in todo:
            if bpe and word.startswith(MARK * 2):
                # equal scores among runs of marks are settled by place, which the pairs don't tell
                self.known[word] = self._ids(self.merge_run(word))
                continue
            shared, most = 0, min(len(last), len(word))
            while shared < most and last[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :]
            (self._merged if bpe else self._best)(word, shared, states)
            last = word
            found, end = [], len(word)
            while end:
                i = states[end] if bpe else states[end][1]
                if i is None or i == NOTHING:
                    end -= 1
                    found += self._unknown(word[end])[::-1]
                else:
                    found.append(i)
                    end -= len(pieces_of[i])
            self.known[word] = array("I", found[::-1]).tobytes()

    def _unknown(self, c: str) -> list[int]:
        return [self.model.bytes[b] for b in c.encode()] if self.model.byte_fallback else [self.model.unknown]

    def merge_run(self, word: str) -> list[str]:
        """Merging by a heap, for long runs of marks: (score, place) order, n log n."""
        from heapq import heapify, heappop, heappush

        ids, scores = self.model.ids, self.model.scores
        parts: list[str | None] = list(word)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(parts):
                i = ids.get(parts[a] + parts[b])
                if i is not None:
                    heappush(heap, (-scores[i], a, b, parts[a], parts[b]))

        heapify(heap)
        for k in range(len(parts) - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, x, y = heappop(heap)
            if parts[a] != x or parts[b] != y or right[a] != b:
                continue
            parts[a], parts[b] = x + y, None
            right[a] = right[b]
            if right[b] < len(parts):
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in parts if p is not None]

    def _ids(self, pieces: list[str]) -> bytes:
        ids = self.model.ids
        return array("I", [i for p in pieces for i in ([ids[p]] if p in ids else self._unknown(p))]).tobytes()

    def split(self, text: str) -> list[str]:
        """Marked words: each begins where a mark follows another character."""
        marked = (MARK * self.model.prefix + text).replace(" ", MARK)
        if MARK * 2 not in marked:
            first, *rest = marked.split(MARK)
            return ([first] if first else []) + [MARK + w for w in rest]
        out, start = [], 0
        for at in range(1, len(marked)):
            if marked[at] == MARK != marked[at - 1]:
                out.append(marked[start:at])
                start = at
        return out + [marked[start:]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit numbers."""
        split = [self.split(t) if t else [] for t in texts]
        self.words(list({w for words in split for w in words}))
        known = self.known
        return [b"".join([known[w] for w in words]) for words in split]

    def decode(self, ids: list[int]) -> str:
        """The text: pieces, bytes put together, marks as spaces, without the leading one. Bytes that are no UTF-8 become replacement characters."""
        model, out, held = self.model, [], bytearray()

        def flush() -> None:
            while held:
                try:
                    out.append(held.decode())
                    held.clear()
                except UnicodeDecodeError as e:
                    out.append(held[: e.start].decode() + "�")
                    del held[: e.start + 1]

        for i in ids:
            kind, piece = model.kinds[i], model.pieces[i]
            if kind == BYTE:
                held.append(int(piece[3:5], 16))
                continue
            flush()
            if kind == NORMAL:
                out.append(piece)
            elif kind == UNKNOWN:
                out.append(" ⁇ ")
        flush()
        text = "".join(out)
        if model.prefix and text.startswith(MARK):
            text = text[1:]
        return text.replace(MARK, " ")


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(Model(path))


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the ids of every whole text, as the sentencepiece library gives them; none for null and empty texts.

    Distinct words are encoded once per slice of about 2 MB of texts and kept in a bounded cache, so memory doesn't grow
    with the table. Other columns are ignored, and rows that repeat are encoded each.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = encoder_of(path)
        for part in sliced(batches, "text"):
            ids = mine.encode([t or "" for t in part.column(1).to_pylist()])
            ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
            yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], ["id", "ids"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from ids; null ids give a null text."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = encoder_of(path)
        for batch in batches:
            texts = [None if x is None else mine.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id bigint, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes whole texts in one pass: id, n_ids, ids_crc32 (little-endian 32-bit ids), text_crc32 (UTF-8 of what was decoded), same."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = encoder_of(path)
        for part in sliced(batches, "text"):
            texts = [t or "" for t in part.column(1).to_pylist()]
            rows = []
            for i, text, ids in zip(part.column(0).to_pylist(), texts, mine.encode(texts)):
                back = mine.decode(np.frombuffer(ids, np.uint32).tolist())
                rows.append((i, len(ids) // 4, zlib.crc32(ids), zlib.crc32(back.encode()), back == text))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["id", "n_ids", "ids_crc32", "text_crc32", "same"])

    schema = "id bigint, n_ids bigint, ids_crc32 bigint, text_crc32 bigint, same boolean"
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`, encoded and decoded."""
    return round_trip(table(spark, sf_dir, "documents"))
