"""Operator 5: quality rules with thresholds from mergeable quantile sketches of each language and source. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, WORD, Workspace

#: Rates that are judged: what is counted, out of what, and how many of it come at once (a window that repeats covers three words).
METRICS = {"symbol_share": ("n_symbols", "word_chars", 1), "dup_line_share": ("n_dup_lines", "n_lines", 1), "repeat_share": ("n_repeat_words", "n_words", 3), "word_length": ("word_chars", "n_words", 1)}
#: The metrics that have a fence below too; too few symbols or repeats are no fault.
TWO_SIDED = ("word_length",)


def _repeat_words(words: Column) -> list[tuple[str, Column]]:
    """Steps to the words in three-word windows that stand twice or more in a text: sort the window hashes, mark equal neighbours, sum the stretches covered. n log n in the words."""
    h, sorted_, at = F.col("_h"), F.col("_p"), F.col("_at")
    return [
        ("_h", F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))),
        ("_p", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))),
        (
            "_at",
            F.sort_array(
                F.filter(
                    F.transform(
                        F.sequence(F.lit(0), F.size(sorted_) - 1),
                        lambda j: F.when((j > 0) & (F.get(sorted_, j - 1)["h"] == F.get(sorted_, j)["h"]) | F.coalesce(F.get(sorted_, j + 1)["h"] == F.get(sorted_, j)["h"], F.lit(False)), F.get(sorted_, j)["i"]),
                    ),
                    lambda x: x.isNotNull(),
                )
            ),
        ),
        ("n_repeat_words", F.coalesce(F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")), lambda a: a["n"]), F.lit(0).cast("long"))),
    ]


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts of every whole text, one row per row of docs; no text goes on."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), text.alias("_t"))
    df = df.withColumn("_w", F.regexp_extract_all("_t", F.lit(f"({WORD})"), F.lit(1)))
    df = df.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""))
    for name, step in _repeat_words(F.col("_w")):
        df = df.withColumn(name, step)
    return df.select(
        "doc_id",
        "lang",
        "source",
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        "n_repeat_words",
    )


def _shares() -> dict[str, Column]:
    return {m: F.col(n) / F.greatest(F.lit(1), d) for m, (n, d, _) in METRICS.items()}


def thresholds(counts: DataFrame, *, k: int = 2000, fence: float = 3.0, least_docs: int = 200, tail: float = 0.85) -> DataFrame:
    """(lang, source, top_<metric>, low_<metric> of two-sided ones): fences `fence` times as far past a tail quantile as that is from the median.

    Each (lang, source) has a sketch of each metric, built on the map side first; sketches merge upwards to languages
    and to all. A group's own fence counts by its share of least_docs documents, the rest is its language's, and so on
    upwards: a thin group moves smoothly from its language's level to its own.
    """
    shares = counts.where(~F.col("base_failed")).select("lang", "source", *[c.alias(m) for m, c in _shares().items()])
    fine = shares.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(F.col(m), F.lit(k)).alias(m) for m in METRICS])
    by_lang = fine.groupBy(F.col("lang").alias("lang1")).agg(F.sum("n").alias("n1"), *[F.kll_merge_agg_double(F.col(m), F.lit(k)).alias(f"{m}_1") for m in METRICS])
    by_all = fine.agg(F.sum("n").alias("n0"), *[F.kll_merge_agg_double(F.col(m), F.lit(k)).alias(f"{m}_0") for m in METRICS])

    def fenced(sketch: str, q: float) -> Column:
        end, middle = (F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(x)) for x in (q, 0.5))
        return end + fence * (end - middle)

    def own(n: str) -> Column:
        return F.least(F.lit(1.0), F.col(n) / least_docs)

    def blended(m: str, q: float) -> Column:
        lang = own("n1") * fenced(f"{m}_1", q) + (1 - own("n1")) * fenced(f"{m}_0", q)
        return F.greatest(F.lit(0.0), own("n") * fenced(m, q) + (1 - own("n")) * lang)

    # by_all is one row
    joined = fine.join(by_lang, F.col("lang").eqNullSafe(F.col("lang1"))).crossJoin(F.broadcast(by_all))
    return joined.select("lang", "source", *[blended(m, tail).alias(f"top_{m}") for m in METRICS], *[blended(m, 1 - tail).alias(f"low_{m}") for m in TWO_SIDED])


def _past(m: str, fence: float) -> Column:
    """Whether a count is past its fence by more than chance: outside the score interval, `fence` deviations wide, of a Poisson count at the fence's rate. So the width follows from the document's size."""
    n, d, unit = METRICS[m]
    seen, half = F.col(n) / unit, fence * fence / 2

    def bound(rate: str, sign: int) -> Column:
        expected = F.col(rate) * F.greatest(F.lit(1), d) / unit
        return expected + half + sign * fence * F.sqrt(expected + half / 2)

    out = F.coalesce(seen > bound(f"top_{m}", 1), F.lit(False))
    return out | F.coalesce(seen < bound(f"low_{m}", -1), F.lit(False)) if m in TWO_SIDED else out


def apply_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_words: int = 50, fence: float = 3.0, **options) -> DataFrame:
    """Counts, base_failed and kept of every document; kept is false where it is past a fence of its language and source by more than chance.

    A null text counts as none: no words, so it fails the base rule. Null languages and sources form groups of their
    own. Repeated rows and null ids are judged row by row. Documents that fail the base rule play no part in the
    sketches. An empty table gives no rows.
    """
    space = Workspace(docs.sparkSession, "rules")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = space.save(measure(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, source_col=source_col).withColumn("base_failed", failed), "counts")
    tops = space.save(thresholds(counts, fence=fence, **options).withColumnRenamed("lang", "_lang").withColumnRenamed("source", "_source"), "thresholds")
    judged = counts.join(tops, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    past = F.lit(False)
    for m in METRICS:
        past = past | _past(m, fence)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~past).alias("kept"))
