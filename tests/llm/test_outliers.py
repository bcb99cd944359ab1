import re

import numpy as np
from pyspark.sql import functions as F

from nearfold.llm.outliers import FACTOR, LOG_DET, P, _concentrated, _start_of, base_statistics, chi2_quantile, chi2_tail, minimum_determinant, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_base_statistics(spark):
    texts = [None, "", " \n\t", "one", "a b\n\na b\n a b\na b ", "é#*$% &|<>!", "w " * 9, "x y z " * 400, "\v\f\r a", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 0", " ".join(f"v{i % 5000}" for i in range(30_000))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 2) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_words int, x0 int")
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (docs, real):
        want = {r.doc_id: plain(r.text) for r in df.collect()}
        got = base_statistics(df).collect()
        assert {r.id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == want
    judged = {r.doc_id: r for r in quality_rules(docs).collect()}
    assert len(judged) == len(texts)
    for i, t in enumerate(texts):
        n, *_, rep = plain(t)
        assert judged[i].base_failed == (n < 20 or 100 * rep > 30 * n)
    assert quality_rules(docs.limit(0)).count() == 0


def test_strays_are_rejected_and_groups_differ(spark):
    rng = np.random.default_rng(1)

    def text(size, symbols=0):
        return " ".join("".join(rng.choice(list("abcdefgh"), int(k))) + "#" * symbols for k in rng.integers(size - 1, size + 2, 200))

    rows = [(i, text(4 if i % 2 else 9), "de" if i % 2 else None, "s", "clash") for i in range(300)]
    rows += [(1000, text(9), "de", "s", ""), (1001, text(4), None, "s", ""), (1002, text(4, 3), "de", "s", ""), (1003, text(4), "de", "small", ""), (1003, text(4), "de", "small", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_rows string")
    out = quality_rules(docs.repartition(5))
    got = [(r.doc_id, r.kept) for r in out.collect()]
    assert len(got) == len(rows) and {i for i, k in got if not k} == {1000, 1001, 1002}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert out.filter(F.col("kept").isNull()).count() == 0


def test_clean_texts_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality_rules(docs).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in out}
    assert kept[1] > 0.95 and kept[0] < 0.1


def test_quantiles():
    for dof, x, tail in ((4, 9.487729, 0.05), (2, 5.991465, 0.05), (6, 12.591587, 0.05)):
        assert abs(chi2_tail(x, dof) - tail) < 1e-6 and abs(chi2_quantile(tail, dof) - x) < 1e-4


def test_least_determinant_of_the_starts(spark):
    """A quarter of strays in two groups: the estimate is that of the best start, stands still, and is not drawn to the strays."""
    rng = np.random.default_rng(4)
    rows = []
    for lang, centre in (("de", 1700), ("en", 1500)):
        mixed = rng.normal(size=(4, 4)) * 40
        x = rng.normal(size=(300, 4)) @ mixed + centre
        x[:70] = rng.normal(size=(70, 4)) * 15 + centre + [900, -500, 700, 400]
        rows += [(lang, "=s", *map(int, r)) for r in x]
    fit = spark.createDataFrame(rows, "lang string, source string, x0 bigint, x1 bigint, x2 bigint, x3 bigint").cache()
    best = {r.lang: r for r in minimum_determinant(fit, 0.75, 20).collect()}
    known = fit.groupBy("lang", "source").agg(F.count("*").alias("n_rows"), *(F.expr(f"percentile(x{i}, array(0.25, 0.5, 0.75)) AS q{i}") for i in range(P)))
    ends = {}
    for k in (0, 2):
        now = known.selectExpr("lang", "source", "n_rows", f"{k} AS start", *_start_of(k, "q{}[{}]"))
        last = []
        for _ in range(20):
            now = _concentrated(fit, now, 0.75)
            last.append({r.lang: (r.d, [r[f"m{i}"] for i in range(P)]) for r in now.selectExpr("*", f"{LOG_DET} AS d").collect()})
            if len(last) > 1 and last[-1] == last[-2]:
                break
        assert all(a[g][0] >= b[g][0] - 1e-9 for a, b in zip(last, last[1:]) for g in a)  # no step raises a determinant
        for lang, (d, m) in last[-1].items():
            ends.setdefault(lang, []).append((d, m))
    for lang, centre in (("de", 1700), ("en", 1500)):
        mean = [best[lang][f"m{i}"] for i in range(P)]
        assert mean == min(ends[lang])[1] or mean not in [m for _, m in ends[lang]]  # the start that isn't tried here may be better
        assert abs(best[lang].m0 - centre) < 60 and set(FACTOR) <= set(best[lang].asDict())
