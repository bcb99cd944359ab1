import random

import numpy as np
import public_tokenizers
import sentencepiece

from nearfold.llm.pieces import MARK, NOTHING, NORMAL, UNIGRAM, Encoder, Model, decode, encode, round_trip

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_ids_and_texts_are_the_librarys(spark):
    library, mine, rng = sentencepiece.SentencePieceProcessor(model_file=PATH), Encoder(Model(PATH), most=50, most_pairs=500), random.Random(1)
    parts = ["a", "Word", " ", "  ", "   ", "\n", "\t", "don't", "é", "ß", "日本", MARK, MARK * 2, "😀", "<s>", "<unk>", "<0x41>", "the", "tion", "\x00x", " " * 40]
    texts = ["", " ", "  ", "a"] + ["".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(1500)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts.append("lang " * 20_000)
    for k in range(0, len(texts), 100):
        for text, ids in zip(texts[k : k + 100], mine.encode(texts[k : k + 100])):
            want = library.encode(text)
            assert np.frombuffer(ids, np.uint32).tolist() == want, text
            assert mine.decode(want) == library.decode(want)
    for _ in range(1000):
        ids = [rng.randrange(3, 259) if rng.random() < 0.6 else rng.randrange(3, 32000) for _ in range(rng.randint(1, 8))]
        assert mine.decode(ids) == library.decode(ids)


def test_unigram_viterbi_against_all_segmentations():
    model = Model(PATH)
    rng = random.Random(2)
    model.kind, model.byte_fallback = UNIGRAM, False
    pieces = ["<unk>", *sorted({"".join(rng.choices("ab▁", k=rng.randint(1, 3))) for _ in range(25)} - {"c"})]
    pieces = [p for p in pieces if MARK not in p.lstrip(MARK)]
    model.pieces, model.scores, model.kinds = pieces, [0.0] + [-rng.random() * 9 for _ in pieces[1:]], [2] + [NORMAL] * (len(pieces) - 1)
    model.ids, model.unknown = {p: i for i, p in enumerate(pieces) if i}, 0
    mine = Encoder(model)

    def best(word):
        if not word:
            return 0.0
        found = [model.scores[model.ids[word[:k]]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in model.ids]
        return max(found + [min(model.scores) - 10 + best(word[1:])])

    words = [MARK + "".join(rng.choices("abc", k=rng.randint(0, 7))) for _ in range(200)]
    mine.words(words)
    for w in words:
        ids = np.frombuffer(mine.known[w], np.uint32).tolist()
        assert abs(sum(model.scores[i] if i else min(model.scores) - 10 for i in ids) - best(w)) < 1e-9
    assert NOTHING > len(pieces)


def test_tables(spark):
    rows = [(1, "Hello  world\n", 1), (1, "Hello  world\n", 1), (2, None, 1), (3, "", 1), (None, "x", 1), (4, "wörd " * 50_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    back = decode(encode(docs)).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t, _ in rows)
    trip = round_trip(docs).collect()
    assert len(trip) == 6 and all(r.same for r in trip) and {r.n_ids for r in trip if r.doc_id in (2, 3)} == {0}
    assert round_trip(docs.limit(0)).count() == 0 and encode(docs.limit(0)).count() == 0
