import random
from itertools import combinations

import numpy as np
import xxhash

from nearfold.llm import simhash
from nearfold.llm.fingerprints import covering_triples, fingerprint
from nearfold.llm.simhash import near_dedup_stage, near_duplicates, near_links


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps):
    """The smallest index reachable over pairs of at most four differing bits, by comparing all."""
    label = list(range(len(fps)))
    pairs = [(a, b) for a, b in combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 4]
    while True:
        before = list(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


def test_every_four_positions_hold_a_triple():
    triples = set(covering_triples())
    assert len(triples) == 20
    assert all(triples & set(combinations(four, 3)) for four in combinations(range(8), 4))


def test_fingerprint_and_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    fps = [plain(t) for _, t in rows]
    want = {i: (f"{fps[k]:016x}", rows[c][0]) for k, ((i, _), c) in enumerate(zip(rows, classes(fps)))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == want


def test_odd_texts(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(5, None), (4, ""), (9, " \t\n"), (7, "One"), (8, "one"), (3, "a b c"), (2, "a b C"), (1, long), (6, long + " x"), (None, "one"), (None, "lonely words here"), (7, "One")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, fp string, n int")
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()]
    assert len(got) == len(rows)
    by = {i: (f, c) for i, f, c in got if i is not None}
    for i, t in rows:
        if i is not None:
            assert by[i][0] == f"{plain(t):016x}"
    assert by[4] == by[5] == by[9] == ("0" * 16, 4) and by[7][1] == by[8][1] == 7 and by[6][1] == by[1][1] == 1
    assert {c for i, f, c in got if i is None} == {7, None}
    # one row of each group: the one-word text with other blanks is no copy of "a b c"; both rows of (7, "One") are one document
    stay = near_dedup_stage(spark, docs, "")
    assert stay.columns == docs.columns and sorted(r.doc_id or -1 for r in stay.collect()) == [-1, 1, 2, 3, 4, 7, 7]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_links_against_all_pairs_with_small_blocks(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(60):
        at = rng.getrandbits(64)
        for _ in range(20):
            fps.add(at)
            for _ in range(rng.randint(1, 4)):
                at ^= 1 << rng.randrange(64)
    fps |= {rng.getrandbits(16) for _ in range(400)}  # lists that many share
    fps = sorted(fps)
    table = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp bigint")
    docs = {x: i for i, x in enumerate(fps)}
    for block in (20_000, 50):
        label = list(range(len(fps)))
        links = [(docs[int(np.int64(a).astype(np.uint64))], docs[int(np.int64(b).astype(np.uint64))]) for a, b in near_links(table, block=block).collect()]
        assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in links)
        while True:
            before = list(label)
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
            if before == label:
                break
        assert label == classes(fps)


def test_few_links_from_dense_runs():
    base = np.uint64(0)
    fp = np.array(sorted({int(base) | (1 << a) | (1 << b) for a in range(20) for b in range(20)}), np.uint64)
    a, b = simhash._links_of_runs(np.zeros(len(fp), np.int64), fp, 4)
    assert len(a) == len(fp) - 1 and len(b) == len(a)


def test_fingerprint_of_bytes():
    assert fingerprint(b"") == 0 and fingerprint(b"Word") == xxhash.xxh64_intdigest(b"word", 42)
