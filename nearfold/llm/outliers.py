"""Quality rules: base thresholds, then robust multivariate outliers per language and source."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.llm.common import BLANKS, attach, table, words_of
from nearfold.scratch import written

WINDOW = 8
#: Statistics in thousandths: log of the word length (100 words of 5 letters added), log of symbols per hundred letters,
#: roots aside shares of repeated lines and of repeated words.
STATISTICS = (
    "CAST(floor(1000 * ln((word_chars + 500.0) / (n_words + 100.0)) + 0.5) AS BIGINT)",
    "CAST(floor(1000 * ln(1 + 100.0 * n_symbols / (word_chars + 100.0)) + 0.5) AS BIGINT)",
    "CAST(floor(1000.0 * n_dup_lines / (n_lines + 1.0) + 0.5) AS BIGINT)",
    "CAST(floor(1000.0 * n_repeat_words / (n_words + 1.0) + 0.5) AS BIGINT)",
)
#: Standard deviations that any group has at least, in the same thousandths: differences below them are no outliers.
FLOORS = (35.0, 100.0, 100.0, 100.0)
P = len(STATISTICS)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
#: The squared distances are counted in this many steps of ln(1 + d2); 4,096 are kept apart.
STEPS = 90
SUMS = [f"sum(x{i}) AS s{i}" for i in range(P)] + [f"sum(x{i} * x{j}) AS s{i}_{j}" for i, j in PAIRS]
TOTALS = [f"sum(s{i}) AS s{i}" for i in range(P)] + [f"sum(s{i}_{j}) AS s{i}_{j}" for i, j in PAIRS]


def chi2_tail(x: float, dof: int) -> float:
    """P(chi squared > x) for an even number of degrees of freedom."""
    term = total = 1.0
    for k in range(1, dof // 2):
        term *= x / 2 / k
        total += term
    return math.exp(-x / 2) * total


def chi2_quantile(tail: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_tail(mid, dof) > tail else (low, mid)
    return low


def centre_and_cholesky(scale: float) -> list[list[str]]:
    """Layers of SQL expressions from sums over a subset of n rows to its mean and the Cholesky factor of its covariance."""
    means = [f"CAST(s{i} AS DOUBLE) / n AS m{i}" for i in range(P)]
    layers = [means, [f"{scale!r} * (CAST(s{i}_{j} AS DOUBLE) / n - m{i} * m{j})" + (f" + {FLOORS[i] ** 2!r}" if i == j else "") + f" AS c{i}_{j}" for i, j in PAIRS]]
    for j in range(P):
        inner = "".join(f" - l{j}_{k} * l{j}_{k}" for k in range(j))
        layers.append([f"sqrt(greatest(c{j}_{j}{inner}, 1.0)) AS l{j}_{j}"])
        below = ["(c{0}_{1}{2}) / l{1}_{1} AS l{0}_{1}".format(i, j, "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j))) for i in range(j + 1, P)]
        if below:
            layers.append(below)
    return layers


FACTOR = [f"m{i}" for i in range(P)] + [f"l{i}_{j}" for i, j in PAIRS]
SOLVED = [["(x{0} - m{0}{1}) / l{0}_{0} AS z{0}".format(i, "".join(f" - l{i}_{j} * z{j}" for j in range(i)))] for i in range(P)]
D2 = " + ".join(f"z{i} * z{i}" for i in range(P))
BUCKET = f"CAST(least(4095, floor({STEPS} * ln(1 + d2))) AS BIGINT)"


#: What concentration starts from, by number: medians and quartiles; mean and covariance of the whole group; medians and floors.
STARTS = (0, 1, 2)
S_NAMES = ["n", *(f"s{i}" for i in range(P)), *(f"s{i}_{j}" for i, j in PAIRS)]
LOG_DET = " + ".join(f"ln(l{i}_{i})" for i in range(P))


def _start_of(k: int, quartile: str) -> list[str]:
    """Centre and scales of start 0 or 2; quartile(i, j) is where the quartiles are."""
    own = lambda i: f"greatest({FLOORS[i]!r}, ({quartile.format(i, 2)} - {quartile.format(i, 0)}) / 1.349)" if k == 0 else f"CAST({FLOORS[i]!r} AS DOUBLE)"
    return [f"CAST({quartile.format(i, 1)} AS DOUBLE) AS m{i}" for i in range(P)] + [f"CAST({own(i) if i == j else '0.0'} AS DOUBLE) AS l{i}_{j}" for i, j in PAIRS]


def let(value: Column, use) -> Column:
    """use(value) with value evaluated once a row, within lambdas too."""
    return F.transform(F.array(value), use)[0]


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of `window` words that a text has twice or more, the first included.

    Windows are compared by XXH64 over the hashes of their words. Texts all of whose windows differ are told by one
    distinct count; the others sort (hash, position), which costs n log n however long they are.
    """

    def of_windows(w: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: F.coalesce((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["h"] == F.get(s, i - 1)["h"], x["h"] == F.get(s, i + 1)["h"], F.lit(False)))
            return let(
                F.sort_array(F.transform(twice, lambda x: x["i"])),
                lambda at: F.aggregate(
                    F.transform(at, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - x, F.lit(window)))),
                    F.lit(0).cast("bigint"),
                    lambda a, x: a + x,
                ),
            )

        pairs = F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(let(F.sort_array(pairs), of_sorted))

    hashed = F.transform(words, lambda x: F.xxhash64(x))
    windows = let(hashed, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda i: F.xxhash64(F.slice(h, i, window))))
    return F.when(F.size(words) < window, F.lit(0).cast("bigint")).otherwise(let(windows, of_windows))


def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words) of whole texts; null counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        let(
            text,
            lambda t: F.struct(
                let(
                    words_of(t),
                    lambda w: F.struct(
                        F.size(w).cast("bigint").alias("n_words"),
                        F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("word_chars"),
                        repeat_words(w).alias("n_repeat_words"),
                    ),
                ).alias("w"),
                (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
                let(
                    F.filter(F.split(t, "\n"), lambda x: x.rlike("[^" + BLANKS[1:])),
                    lambda l: F.struct(F.size(l).cast("bigint").alias("n"), F.size(F.array_distinct(l)).cast("bigint").alias("d")),
                ).alias("l"),
            ),
        ).alias("s"),
    )
    return cut.select(
        "id", "lang", "source", "s.w.n_words", "s.w.word_chars", "s.n_symbols", (F.col("s.l.n") - F.col("s.l.d")).alias("n_dup_lines"), F.col("s.l.n").alias("n_lines"), "s.w.n_repeat_words"
    )


BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


def _layered(df: DataFrame, layers: list[list[str]]) -> DataFrame:
    for layer in layers:
        df = df.selectExpr("*", *layer)
    return df


def _concentrated(fit: DataFrame, factor: DataFrame, half: float) -> DataFrame:
    """Of each group and start, the sums over the `half` that is nearest by the start's factor, and the factor of these."""
    keys, xs = ["lang", "source"], [f"x{i}" for i in range(P)]
    packed = written(factor.groupBy(*keys, "n_rows").agg(F.collect_list(F.struct("start", *FACTOR)).alias("f")), "factors")
    every = attach(fit.select(*keys, *xs), packed, keys, "n_rows").select(*keys, *xs, "n_rows", F.explode("f").alias("f")).select(*keys, *xs, "n_rows", "f.*")
    near = _layered(every, SOLVED).selectExpr("*", f"{D2} AS d2").selectExpr(*keys, "start", *xs, "n_rows", f"{BUCKET} AS bucket")
    counted = near.groupBy(*keys, "start", "n_rows", "bucket").agg(F.count("*").alias("n"), *map(F.expr, SUMS))  # at most 4,096 rows a group and start
    running = counted.selectExpr("*", "sum(n) OVER (PARTITION BY lang, source, start ORDER BY bucket) - n AS before").filter(F.col("before") < half * F.col("n_rows"))
    sums = running.groupBy(*keys, "start", "n_rows").agg(F.sum("n").alias("n"), *map(F.expr, TOTALS))
    return written(_layered(sums, centre_and_cholesky(1.0)).select(*keys, "start", "n_rows", *S_NAMES, *FACTOR), "concentrated")


def minimum_determinant(fit: DataFrame, half: float, c_steps: int) -> DataFrame:
    """(lang, source, n_rows, centre and Cholesky factor): of all STARTS, each concentrated until its subset stands still, the one whose covariance has the least determinant."""
    keys = ["lang", "source"]
    quartiles = [F.expr(f"percentile(x{i}, array(0.25, 0.5, 0.75)) AS q{i}") for i in range(P)]
    known = written(fit.groupBy(*keys).agg(F.count("*").alias("n_rows"), *quartiles, *map(F.expr, SUMS)), "known")
    parts = [known.selectExpr(*keys, "n_rows", f"{k} AS start", *_start_of(k, "q{}[{}]")) for k in (0, 2)]
    whole = _layered(known.withColumn("n", F.col("n_rows")), centre_and_cholesky(1.0)).selectExpr(*keys, "n_rows", "1 AS start", *FACTOR)
    live = written(parts[0].unionByName(whole).unionByName(parts[1]), "starts")
    still, before = [], None
    for _ in range(c_steps):
        now = _concentrated(fit, live, half)
        if before is not None:
            same = [*keys, "start", *S_NAMES]
            still.append(written(now.join(before.select(*same).hint("merge"), same, "left_semi"), "still"))
            now = written(now.join(before.select(*same).hint("merge"), same, "left_anti"), "moving")
        live = before = now
        if now.isEmpty():
            break
    for x in still:
        live = live.unionByName(x)
    names = [*keys, "n_rows", *S_NAMES]
    best = live.selectExpr("*", f"{LOG_DET} AS log_det").groupBy(*keys).agg(F.min_by(F.struct(*names[2:]), F.struct("log_det", "start")).alias("b")).select(*keys, "b.*")
    return written(_layered(best, centre_and_cholesky(consistency(half))).select(*keys, "n_rows", *FACTOR), "factor")


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", half: float = 0.75, c_steps: int = 20, least_group: int = 50, tail: float = 1e-6
) -> DataFrame:
    """One row per row of docs: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance2.

    Texts that pass the base rules are held against the minimum covariance determinant of their language and source: from
    each of three starts, concentration steps take the `half` of the group that is nearest (whole steps of distance, so ties stay
    together) and estimate its mean and covariance, until the subset stands still, c_steps at most; the estimate of least determinant
    holds. A text is rejected if its squared Mahalanobis distance, made consistent for a normal distribution, exceeds the
    chi-squared quantile of `tail`.

    Groups of fewer than least_group texts are estimated together, by language. Every covariance gets the squared FLOORS on
    its diagonal: it never is singular, and a group of equal texts rejects nothing but real strays. Null languages and
    sources are groups of their own with the empty ones. Sums are exact integers, so the result doesn't depend on partitions. Null
    texts count as empty and fail; an empty table gives an empty one; repeated rows are judged alike; other columns are ignored.
    """
    stats = written(base_statistics(docs, id_col, text_col).selectExpr("*", f"{BASE_FAILED} AS base_failed", *(f"{x} AS x{i}" for i, x in enumerate(STATISTICS))), "statistics")
    fit = stats.filter("NOT base_failed")
    keys, shown = ["lang", "source"], ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    xs = [f"x{i}" for i in range(P)]
    sizes = written(fit.groupBy(*keys).agg(F.count("*").alias("n_rows")), "sizes")
    pooled = F.when(F.col("n_rows") >= least_group, F.concat(F.lit("="), F.col("source"))).otherwise("*")
    fit = written(attach(fit, sizes, keys, "n_rows").withColumn("source", pooled).select(*keys, *shown, *xs), "fit")
    factor = minimum_determinant(fit, half, c_steps)
    measured = _layered(attach(fit, factor, keys, "n_rows"), SOLVED).selectExpr(*shown, f"{D2} AS distance2")
    judged = measured.withColumn("kept", F.col("distance2") <= chi2_quantile(tail, P))
    failed = stats.filter("base_failed").select(*shown, F.lit(None).cast("double").alias("distance2"), F.lit(False).alias("kept"))
    return judged.unionByName(failed).withColumnRenamed("id", id_col)


def consistency(half: float) -> float:
    """What the covariance of the nearest `half` is multiplied by to estimate that of the whole normal distribution."""
    return half / (1 - chi2_tail(chi2_quantile(1 - half, P), P + 2))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`."""
    return quality_rules(table(spark, sf_dir, "documents")).drop("distance2")


def oracle(half: float = 0.75, c_steps: int = 20, least_group: int = 50, tail: float = 1e-6) -> str:
    """The same in SQL: base statistics by grouping windows, then every concentration step as its own tables."""
    xs = ", ".join(f"x{i}" for i in range(P))
    ctes = [
        "d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents)",
        r"w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d)",
        f"v AS (SELECT rid, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS win FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW}))",
        "v2 AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM v) WHERE c > 1)",
        f"v3 AS (SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n_repeat_words FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM v2) GROUP BY rid)",
        r"l AS (SELECT rid, count(*) AS n_lines, count(DISTINCT line) AS n_diff FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid)",
        "b AS (SELECT rid, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, "
        "CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_lines - n_diff, 0) AS BIGINT) AS n_dup_lines, "
        "CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN v3 USING (rid) LEFT JOIN l USING (rid))",
        f"s AS MATERIALIZED (SELECT *, {BASE_FAILED} AS base_failed, " + ", ".join(f"{x} AS x{i}" for i, x in enumerate(STATISTICS)) + " FROM b)",
        f"fit AS MATERIALIZED (SELECT rid, lang, CASE WHEN count(*) OVER (PARTITION BY lang, source) >= {least_group} THEN '=' || source ELSE '*' END AS source, {xs} FROM s WHERE NOT base_failed)",
    ]
    known = ", ".join([f"quantile_cont(x{i}, {q}) AS q{i}_{k}" for i in range(P) for k, q in enumerate((0.25, 0.5, 0.75))] + SUMS)
    ctes.append(f"known AS MATERIALIZED (SELECT lang, source, count(*) AS n_rows, count(*) AS n, {known} FROM fit GROUP BY lang, source)")

    def chain(name: str, source: str, layers: list[list[str]]) -> str:
        for k, layer in enumerate(layers):
            ctes.append(f"{name}_{k} AS (SELECT *, {', '.join(layer)} FROM {source})")
            source = f"{name}_{k}"
        return source

    at = chain("first", "known", centre_and_cholesky(1.0))
    plain = [f"SELECT lang, source, n_rows, {k} AS start, {', '.join(_start_of(k, 'q{}_{}'))} FROM known" for k in (0, 2)]
    ctes.append(f"f0 AS MATERIALIZED ({' UNION ALL '.join(plain)} UNION ALL SELECT lang, source, n_rows, 1 AS start, {', '.join(FACTOR)} FROM {at})")
    for step in range(c_steps):
        ctes.append(f"j{step} AS (SELECT rid, fit.lang, fit.source, start, {xs}, n_rows, {', '.join(FACTOR)} FROM fit JOIN f{step} USING (lang, source))")
        at = chain(f"z{step}", f"j{step}", [*SOLVED, [f"{D2} AS d2"], [f"{BUCKET} AS bucket"]])
        ctes.append(f"c{step} AS (SELECT lang, source, start, n_rows, bucket, count(*) AS n, {', '.join(SUMS)} FROM {at} GROUP BY ALL)")
        ctes.append(f"r{step} AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, start ORDER BY bucket) - n AS before FROM c{step})")
        ctes.append(f"t{step} AS (SELECT lang, source, start, n_rows, sum(n) AS n, {', '.join(TOTALS)} FROM r{step} WHERE before < {half} * n_rows GROUP BY ALL)")
        at = chain(f"e{step}", f"t{step}", centre_and_cholesky(1.0))
        ctes.append(f"f{step + 1} AS MATERIALIZED (SELECT lang, source, start, n_rows, {', '.join([*S_NAMES, *FACTOR])} FROM {at})")
    ctes.append(f"best AS (SELECT lang, source, n_rows, {', '.join(S_NAMES)} FROM f{c_steps} QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY {LOG_DET}, start) = 1)")
    at = chain("last", "best", centre_and_cholesky(consistency(half)))
    ctes.append(f"f AS (SELECT lang, source, n_rows, {', '.join(FACTOR)} FROM {at})")
    ctes.append(f"j AS (SELECT rid, {xs}, {', '.join(FACTOR)} FROM fit JOIN f USING (lang, source))")
    at = chain("z", "j", [*SOLVED, [f"{D2} AS d2"]])
    return "WITH " + ",\n".join(ctes) + (
        f"\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(d2 <= {chi2_quantile(tail, P)!r}, false) AS kept FROM s LEFT JOIN {at} USING (rid)"
    )


OP8_SQL = oracle()
