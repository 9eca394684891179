"""Quality rules: robust multivariate outliers among text statistics, per language and source, or where these have few rows per
language or over all.

A minimum-covariance-determinant estimate of centre and scatter is found by concentration steps from two starts, medians with
median absolute deviations, and means with the full covariance: keep the share ``h`` of a group's rows with the least distances
(by grades of half a percent), estimate again, until the determinant falls no more.  The start that ends lower counts.
Statistics are held as integers in thousandths, so all sums are exact and the verdicts do not depend on the partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, Workspace, checkpointed, join_groups, let, text_or_empty, words

#: Transformed statistics, with the least scale each is given (in natural-log units), for groups where it hardly varies.
#: They are so small that where the centre is 0, each share alone can pass the limit: symbols beyond 6 %, duplicate lines beyond
#: 27 % and repeated words beyond 12 %, of which the base rule leaves up to 20 %.
STATISTICS = {"word_length": 0.08, "symbol_share": 0.7, "dup_line_share": 0.65, "repeat_share": 0.5}
#: A line that stands again brings repeated words, so the least scales of these two (by number) go together, with this correlation.
TOGETHER, CORRELATION = (3, 2), 0.5
GROUP = ["lang", "source"]
#: What an estimate is made of: 0 a language's source, 1 a language (source null), 2 all rows (both null).
FIT = ["level", "fit_lang", "fit_source"]


def _chi2_cdf(x: float, df: int) -> float:
    """For even ``df``."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(df // 2))


def chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, df) < p else (low, mid)
    return high


def _n_repeat_words(w: Column) -> Column:
    """Words that lie in some 5-word window found twice or more in the text."""

    def covered(h: Column) -> Column:
        at = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        repeated = lambda s: F.filter(s, lambda x, i: ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | ((i + 1 < F.size(s)) & (s[F.least(i + 1, F.size(s) - 1)]["h"] == x["h"])))
        starts = F.array_sort(F.transform(let(at, repeated), lambda x: x["i"]))
        step = lambda a, x: F.struct((a["n"] + x + 5 - F.greatest(a["end"], x)).alias("n"), (x + 5).alias("end"))
        return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"])

    def windows(wh: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(wh) - 5), lambda i: F.xxhash64(*(wh[i + k] for k in range(5))))

    hashes = let(F.transform(w, lambda x: F.xxhash64(x)), windows)
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(F.size(w) >= 6, some).otherwise(0).cast("bigint")


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts of the base rules, base_failed, and the transformed statistics (null where it failed)."""
    text, has_word = text_or_empty(), lambda line: F.length(F.regexp_replace(line, WORD_GAP, "")) > 0
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in GROUP), text.alias("text"), words(text).alias("w"))
    lines = F.filter(F.split("text", "\n", -1), has_word)
    counted = read.select(
        "doc_id", *GROUP, F.size("w").cast("bigint").alias("n_words"), F.length(F.regexp_replace("text", WORD_GAP, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup"))).alias("lines"), _n_repeat_words(F.col("w")).alias("n_repeat_words"),
    )
    flat = counted.withColumns({"n_lines": F.col("lines.n"), "n_dup_lines": F.col("lines.dup"), "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))}).drop("lines")
    logs = {
        "word_length": F.log(F.col("word_chars") / F.col("n_words")), "symbol_share": F.log1p(1000 * F.col("n_symbols") / F.col("word_chars")),
        "dup_line_share": F.log1p(100 * F.col("n_dup_lines") / F.col("n_lines")), "repeat_share": F.log1p(100 * F.col("n_repeat_words") / F.col("n_words")),
    }
    return flat.withColumns({k: F.when(~F.col("base_failed"), F.round(1000 * v)).cast("bigint") for k, v in logs.items()})


def _distance(xs: list[Column], centre: list[Column], factor: list[list[Column]]) -> Column:
    """Squared Mahalanobis distance by forward substitution with the Cholesky factor."""
    ys: list[Column] = []
    for i, x in enumerate(xs):
        rest = x - centre[i]
        for j in range(i):
            rest = rest - factor[i][j] * ys[j]
        ys.append(rest / factor[i][i])
    return sum((y * y for y in ys[1:]), ys[0] * ys[0])


def _fitted(rows: DataFrame, level: Column) -> DataFrame:
    """``rows`` with the key of the estimate of that level that they belong to."""
    kept = rows.withColumn("level", level)
    return kept.withColumns({"fit_lang": F.when(F.col("level") < 2, F.col("lang")), "fit_source": F.when(F.col("level") < 1, F.col("source"))})


def _levels(stats: DataFrame, min_rows: int) -> tuple[DataFrame, int]:
    """Per language and source the level whose estimate judges it, and how many of them there are."""
    groups = checkpointed(stats.groupBy(*GROUP).agg(F.sum(F.when(F.col("base_failed"), 0).otherwise(1)).alias("rows")))
    langs = checkpointed(groups.groupBy("lang").agg(F.sum("rows").alias("lang_rows")))
    level = F.when(F.col("rows") >= min_rows, 0).when(F.col("lang_rows") >= min_rows, 1).otherwise(2)
    return checkpointed(join_groups(groups, langs, ["lang"], langs.count()).select(*GROUP, level.alias("level"))), groups.count()


def _least_scatter(floors: list[float], i: int, j: int) -> float:
    """In the units of the stored statistics."""
    return 1e6 * floors[i] * floors[j] * (1.0 if i == j else CORRELATION if (i, j) == TOGETHER else 0.0)


def _factored(scattered: DataFrame, d: range) -> DataFrame:
    """Columns l_i_j: the Cholesky factor of the scatter c_i_j."""
    out = scattered
    for i in d:
        for j in range(i + 1):
            rest = F.col(f"c_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-6))) if i == j else rest / F.col(f"l_{j}_{j}"))
    return out.drop(*(f"c_{i}_{j}" for i in d for j in range(i + 1)))


def _estimates(kept: DataFrame, names: list[str], floors: list[float], keys: list[str]) -> DataFrame:
    """Per group of ``keys``: n, centre m_i, and the Cholesky factor l_i_j of the scatter, to which the least scatter is added."""
    d = range(len(names))
    sums = kept.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(names[i]).alias(f"s_{i}") for i in d), *(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s_{i}_{j}") for i in d for j in range(i + 1)))
    out = sums.withColumns({f"m_{i}": F.col(f"s_{i}") / F.col("n") for i in d})
    out = _factored(out.withColumns({f"c_{i}_{j}": F.col(f"s_{i}_{j}") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}") + F.lit(_least_scatter(floors, i, j)) for i in d for j in range(i + 1)}), d)
    return out.select(*keys, "n", *(f"m_{i}" for i in d), *(f"l_{i}_{j}" for i in d for j in range(i + 1)), sum((F.log(f"l_{i}_{i}") for i in d), F.lit(0.0)).alias("log_det"))


def reject_outliers(docs: DataFrame, h: float = 0.75, p: float = 0.9999, min_rows: int = 40) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept.

    ``kept`` is false where a base rule fails, or where the squared robust distance within the row's language and source is
    beyond the chi-square quantile ``p``.  A group with fewer than ``min_rows`` rows that pass the base rules is judged by the
    estimate of all rows of its language, and where that has too few as well, by the estimate of the whole table.
    Null languages and sources are groups of their own.  Null and empty texts have no words and fail.  Repeated rows are
    judged each.  An empty table gives no rows.  Only doc_id, text, lang and source are read.
    """
    names, floors = list(STATISTICS), list(STATISTICS.values())
    d, space = range(len(names)), Workspace(docs.sparkSession, "outliers")
    plain = checkpointed(text_statistics(docs))
    levels, n_levels = _levels(plain, min_rows)
    stats = _fitted(join_groups(plain, levels, GROUP, n_levels), F.col("level"))
    used = checkpointed(_fitted(levels, F.col("level")).select(*FIT).distinct())
    passed = plain.where("not base_failed").select(*GROUP, *names)
    rows = join_groups(_fitted(passed, F.explode(F.array(*map(F.lit, range(3))))), used, FIT, used.count(), "inner").select(*FIT, *names)

    medians = checkpointed(rows.groupBy(*FIT).agg(F.count("*").alias("rows"), *(F.percentile(n, F.lit(0.5)).alias(f"m_{i}") for i, n in enumerate(names))))
    n_groups = medians.count()
    spread = join_groups(rows, medians, FIT, n_groups).groupBy(*FIT).agg(F.max("rows").alias("n"), *(F.max(f"m_{i}").alias(f"m_{i}") for i in d), *(F.percentile(F.abs(F.col(n) - F.col(f"m_{i}")), F.lit(0.5)).alias(f"mad_{i}") for i, n in enumerate(names)))
    wide = spread.withColumns({f"c_{i}_{j}": ((1.4826 * F.col(f"mad_{i}")) ** 2 if i == j else F.lit(0.0)) + F.lit(_least_scatter(floors, i, j)) for i in d for j in range(i + 1)})
    first, second = _factored(wide.drop(*(f"mad_{i}" for i in d)), d), _estimates(rows, names, floors, FIT).drop("log_det")
    starts = first.withColumn("start", F.lit(0)).unionByName(second.withColumn("start", F.lit(1)))
    model = space.table(starts.withColumns({"log_det": F.lit(math.inf), "lower": F.lit(True)}), "model-0")

    def measured(rows: DataFrame, model: DataFrame, n: int) -> DataFrame:
        joined = join_groups(rows, model, FIT, n)
        square = _distance([F.col(n) for n in names], [F.col(f"m_{i}") for i in d], [[F.col(f"l_{i}_{j}") for j in range(i + 1)] for i in d])
        return joined.withColumn("distance", square).drop(*(c for c in model.columns if c not in (*FIT, "n", "start")))

    at, run = 0, [*FIT, "start"]
    while not model.where("lower").isEmpty():  # each time the determinant of some group falls, and it has a least value
        graded = measured(rows, model.where("lower"), 2 * n_groups).withColumn("grade", F.floor(200 * F.log1p("distance")).cast("int"))
        limits = graded.groupBy(*run).agg(F.percentile("grade", F.lit(h)).alias("limit"))
        inner = join_groups(graded, limits, run, 2 * n_groups, "inner").where(F.col("grade") <= F.ceil("limit"))
        new = _estimates(inner.select(*run, *names), names, floors, run)
        now = F.struct(*(F.col(c) for c in new.columns if c not in run)).alias("now")
        pairs = join_groups(model, new.select(*run, now), run, 2 * n_groups)
        falls = F.coalesce(F.col("lower") & (F.col("now.log_det") < F.col("log_det") - 1e-3), F.lit(False))
        at += 1
        model = space.table(pairs.select(*run, *(F.when(falls, F.col(f"now.{c}")).otherwise(F.col(c)).alias(c) for c in new.columns if c not in run), falls.alias("lower")), f"model-{at}")
    best = F.min_by(F.struct(*(c for c in model.columns if c not in (*run, "n", "lower"))), F.struct("log_det", "start"))
    model = space.table(model.groupBy(*FIT).agg(best.alias("m")).select(*FIT, "m.*"), "model")
    space.drop(but=("model",))

    within = chi2_quantile(h, len(names))
    correction = h / _chi2_cdf(within, len(names) + 2)  # the inner rows alone would make the scatter too small
    judged = measured(stats, model, n_groups)
    verdict = ~F.col("base_failed") & F.coalesce(F.col("distance") / correction <= chi2_quantile(p, len(names)), F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.alias("kept"), (F.col("distance") / correction).alias("distance"))
