"""Quality rules by a hashed n-gram log-likelihood ratio, in DataFrame operations only.

Every text's words and neighbouring word pairs are hashed to ``buckets``. Two multinomials over the buckets are counted:
one of the trusted target texts and one of the whole raw corpus; both are smoothed. A text's score is the mean, over its
n-grams, of the log ratio of its bucket's probabilities; a text is kept if its score reaches the threshold. Hard rules on
counts of words and repeated passages come first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that a repeated passage has at least.
WINDOW = 8
_BLANK = r"[\x20\x09-\x0D]+"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it occurs."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(text, _BLANK), lambda w: w != "")


def n_grams(tokens: Column, buckets: int) -> Column:
    """The buckets of all words and of all pairs of neighbouring words."""

    def both(h: Column) -> Column:
        pairs = F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), F.slice(h, 2, F.greatest(F.size(h), F.lit(0))), lambda a, b: F.xxhash64(a, b))
        return F.transform(F.concat(h, pairs), lambda x: F.pmod(x, F.lit(buckets)).cast("int"))

    return _let(F.transform(tokens, lambda w: F.xxhash64(w)), both)


def repeated_words(tokens: Column) -> Column:
    """How many words lie in a window of ``WINDOW`` words that occurs at least twice in the text."""

    def covered(h: Column) -> Column:
        def windows(key: Column) -> Column:
            # Sorted by content, equal windows are neighbours.
            order = F.array_sort(F.transform(key, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
            same = lambda s, i, j: (F.when((j < 0) | (j >= F.size(s)), F.lit(False)).otherwise(F.get(s, j)["x"] == F.get(s, i)["x"]))
            again = lambda s: F.array_sort(F.transform(F.filter(s, lambda e, i: same(s, i, i - 1) | same(s, i, i + 1)), lambda e: e["i"]))
            cover = lambda at: F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1), p + WINDOW) - p)), F.lit(0), lambda n, x: n + x)
            return F.when(F.size(F.array_distinct(key)) == F.size(key), F.lit(0)).otherwise(_let(order, lambda s: _let(again(s), cover)))

        positions = F.sequence(F.lit(1), F.size(h) - (WINDOW - 1))
        key = F.transform(positions, lambda i: F.xxhash64(*(F.get(h, i + (j - 1)) for j in range(WINDOW))))
        return F.when(F.size(h) < WINDOW, F.lit(0)).otherwise(_let(key, windows))

    return _let(F.transform(tokens, lambda w: F.xxhash64(w)), covered).cast("long")


def repeated_lines(text: Column) -> Column:
    """How many lines with a word equal an earlier line of the text."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def base_columns(text: Column) -> dict[str, Column]:
    """The counts that the hard rules use, from a text that isn't null."""
    return {
        "n_words": F.size(words(text)).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, _BLANK, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": repeated_lines(text),
        "n_repeat_words": repeated_words(words(text)),
    }


def log_ratios(docs: DataFrame, trusted: DataFrame, *, buckets: int, smoothing: float) -> DataFrame:
    """One row with an array ``ratios``: log(p_target / p_raw) of every bucket, from counts over all of ``docs``."""
    # Sorted by id at every size: the trusted ids grow with the corpus and are never broadcast.
    texts = docs.join(trusted.select("doc_id").distinct().withColumn("_target", F.lit(1)).hint("merge"), "doc_id", "left")
    grams = texts.select(F.explode(n_grams(words(F.coalesce("text", F.lit(""))), buckets)).alias("bucket"), F.coalesce("_target", F.lit(0)).alias("target"))
    counted = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("target").alias("target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    # From here on there are ``buckets`` rows, whatever the input.
    whole = every.join(counted, "bucket", "left").na.fill(0, ["raw", "target"])
    row = whole.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))), lambda x: F.struct(x["raw"].alias("raw"), x["target"].alias("target"))).alias("n"),
        F.sum("raw").alias("all_raw"),
        F.sum("target").alias("all_target"),
    )
    share = lambda n, of: (n + F.lit(smoothing)) / (F.col(of) + F.lit(smoothing * buckets))
    return row.select(F.transform("n", lambda x: F.log(share(x["target"], "all_target") / share(x["raw"], "all_raw"))).alias("ratios"))


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    *,
    buckets: int = 1 << 15,
    smoothing: float = 1.0,
    threshold: float = -0.1,
    min_words: int = 20,
    max_repeat_percent: int = 30,
) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``kept`` and ``score`` of every row of ``docs(doc_id, text)``.

    ``trusted(doc_id)`` names the target texts. A null text is empty; a text without words has score 0 and fails the base
    rules. A text is kept if it passes them and its score is at least ``threshold`` (equality keeps). Without any trusted
    text all ratios are those of a uniform target. Repeated rows are each judged and each counted; further columns are
    ignored; an empty table gives an empty result. The only thing sent to every task is the array of ``buckets`` ratios.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    trusted = trusted.select(F.col("doc_id").cast("long").alias("doc_id"))
    # ``buckets`` numbers come to the driver, whatever the input, and go back as one constant of the plan.
    counted = log_ratios(docs, trusted, buckets=buckets, smoothing=smoothing).first()["ratios"]
    ratios = F.split(F.lit(",".join(map(repr, counted))), ",").cast("array<double>")
    text = F.coalesce("text", F.lit(""))

    def mean(grams: Column) -> Column:
        total = F.aggregate(grams, F.lit(0.0), lambda s, b: s + F.get(ratios, b))
        return F.when(F.size(grams) > 0, total / F.size(grams)).otherwise(F.lit(0.0))

    scored = docs.select("doc_id", *(c.alias(n) for n, c in base_columns(text).items()), _let(n_grams(words(text), buckets), mean).alias("score"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
