"""SimHash fingerprints of word shingles, and the posting lists of their positional bytes."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def hashes_of(text: bytes, shingle: int = 4) -> np.ndarray:
    """XXH64 (seed 42) of all shingles, repeats included; of the whole sequence where it has fewer words, nothing without any."""
    words = text.translate(LOWER).split()  # bytes.split() takes exactly the six blanks
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest, n = xxhash.xxh64_intdigest, len(words) - k + 1
    return np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts[:n].tolist(), ends[k - 1 :].tolist())), "<u8", n)


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if over half of the hashes have it set; zero without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = 4) -> int:
    return majority(hashes_of(text, shingle))


def covering_triples() -> list[tuple[int, int, int]]:
    """20 triples of the 8 byte positions, of which every four positions contain one (Turan's construction)."""
    a, b, c = (0, 1, 2), (3, 4, 5), (6, 7)
    found = [t for g in (a, b, c) for t in combinations(g, 3)]
    for two, one in ((a, b), (b, c), (c, a)):
        found += [(*p, x) for p in combinations(two, 2) for x in one]
    return [tuple(sorted(t)) for t in found]


#: How many posting lists a word of eight bytes is in.
LISTS = 20


def posting_keys(fp: Column) -> Column:
    """One number for each triple: which it is, and the three bytes there."""
    byte = lambda i: F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255).cast("bigint"))
    return F.array(
        *(
            F.lit(k << 24).cast("bigint") + byte(x) * 65536 + byte(y) * 256 + byte(z)
            for k, (x, y, z) in enumerate(covering_triples())
        )
    )
