"""Quality rules: base statistics and a hashed n-gram log-likelihood ratio.

Words are the runs ``[^\\x20\\x09-\\x0D]+``. The method compares two multinomials
over hashed n-grams: one of a trusted target (documents labelled good), one of
the raw corpus. An n-gram here is a pair of neighbouring word *shapes* (runs of
capitals, other letters and digits each shrink to one mark; punctuation stays),
so the ratio generalises over languages and invented words. A document's score
is the mean log ratio over its n-grams, and every document is thresholded
deterministically: ``llr >= threshold``.

Everything on this path is DataFrame functions. Texts are read once: base
statistics and the buckets of their n-grams go to a written table, from which
both counts and scores are taken. What is shuffled is one short bucket array per document for the
join with the labels, and at most ``buckets`` rows a task for the counts. The
model is ``buckets`` doubles whatever the corpus size.

Defined cases: null or empty text has no words, fails the base rules and is
dropped; with no trusted n-grams the ratio is 0 for all and only the base rules
decide; repeated rows are scored alike and counted each; very long texts are one
row's arrays; a score at the threshold is kept; a null ``doc_id`` is never trusted;
other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.storage import materialise

SPACE = r"[\x20\x09-\x0D]+"
BUCKETS = 4096
THRESHOLD = -0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once and hands it to ``body``."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def shapes_of(text: Column) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{Lu}+", "A")
    t = F.regexp_replace(t, r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}\p{M}]+", "a")
    return words_of(F.regexp_replace(t, r"\p{N}+", "9"))


def gram_buckets(text: Column, buckets: int) -> Column:
    """One hashed bucket for each word: its shape with the next one's."""
    return let(
        shapes_of(text),
        lambda s: F.transform(s, lambda a, i: (F.crc32(F.concat(a, F.lit(" "), F.coalesce(F.get(s, i + 1), F.lit(""))).cast("binary")) % buckets).cast("int")),
    )


def _repeated(words: Column) -> Column:
    """Words in 3-word windows that the text has at least twice."""
    windows = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.struct(F.concat(w, F.lit(" "), F.get(words, i + 1), F.lit(" "), F.get(words, i + 2)).alias("k"), i.alias("i")),
    )
    return let(
        F.sort_array(windows),
        lambda s: F.size(
            F.array_distinct(
                F.flatten(
                    F.transform(
                        # No neighbour at an end compares as null, which is not kept.
                        F.filter(s, lambda x, j: (x["k"] == F.get(s, j - 1)["k"]) | (x["k"] == F.get(s, j + 1)["k"])),
                        lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2),
                    )
                )
            )
        ),
    )


def base_statistics(text: Column) -> Column:
    """struct<n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words>, all long."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        words_of(t),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeated(w).cast("long").alias("n_repeat_words"),
        ),
    )


def fit_ratio(grams: DataFrame, labels: DataFrame, key: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """One row: ``weights array<double>``, log target share over log raw share of
    every bucket in ``grams(key, grams)`` (add-one smoothed; all 0 without a trusted n-gram)."""
    trusted = labels.where(F.col("quality") == 1).select(F.col(key).alias("key")).where("key is not null").distinct().withColumn("__t", F.lit(1))
    counts = (
        # Rows without a key are dealt by a hash of their n-grams, not to one task.
        grams.select(F.col(key).alias("__k"), F.when(F.col(key).isNull(), F.xxhash64("grams")).alias("__salt"), "grams")
        .join(trusted.withColumn("__none", F.lit(None).cast("long")), F.col("__k").eqNullSafe(F.col("key")) & F.col("__salt").eqNullSafe(F.col("__none")), "left")
        .select(F.coalesce("__t", F.lit(0)).alias("t"), F.explode("grams").alias("b"))
        .groupBy("b")
        .agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("good"))
    )
    # At most `buckets` rows from here on.
    one = counts.agg(F.sum("raw").alias("n"), F.sum("good").alias("m"), F.map_from_entries(F.collect_list(F.struct("b", F.struct("raw", "good")))).alias("c"))
    m, n = F.coalesce("m", F.lit(0)), F.coalesce("n", F.lit(0))
    nothing = F.struct(F.lit(0).cast("long").alias("raw"), F.lit(0).cast("long").alias("good"))
    return one.select(
        F.transform(
            F.sequence(F.lit(0), F.lit(buckets - 1)),
            lambda b: let(F.coalesce(F.try_element_at("c", b), nothing), lambda x: F.when(m == 0, 0.0).otherwise(F.log((x["good"] + 1) / (m + buckets)) - F.log((x["raw"] + 1) / (n + buckets)))),
        ).alias("weights")
    )


def quality_rules(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None, buckets: int = BUCKETS, threshold: float = THRESHOLD, rules: str = "__rules") -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with the struct
    ``rules``: base statistics, base_failed, llr, kept."""
    columns = docs.columns if keep is None else keep
    t = F.col(text)
    doc = F.struct(*[F.col(f"`{c}`") for c in columns])
    featured = materialise(docs.select(F.col(key).alias("key"), doc.alias("doc"), base_statistics(t).alias("base"), gram_buckets(t, buckets).alias("grams")), "quality-features")
    scored = featured.withColumn("w", fit_ratio(featured, labels.withColumnRenamed(key, "key"), "key", buckets).scalar()).withColumn(
        "llr", let(F.col("w"), lambda w: F.aggregate("grams", F.lit(0.0), lambda acc, b: acc + F.get(w, b)))
    )
    b = F.col("base")
    failed = (b["n_words"] < MIN_WORDS) | (100 * b["n_repeat_words"] > MAX_REPEAT_PERCENT * b["n_words"])
    llr = F.round(F.col("llr") / F.greatest(b["n_words"], F.lit(1)), 6)
    return scored.select(
        "doc.*",
        F.struct(
            *[b[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
            failed.alias("base_failed"),
            llr.alias("llr"),
            (~failed & (llr >= threshold)).alias("kept"),
        ).alias(rules),
    )
