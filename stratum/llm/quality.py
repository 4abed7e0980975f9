"""Quality rules with adaptive thresholds (DataFrame functions only).

Each document gets a few measures. For every language and source a mergeable quantile sketch of each
measure is built: the numbers of documents in bins that are as wide as a 128th of their values at most. Sketches are merged, by adding up, into those of
the language and of the whole corpus. The bounds of a
group come from its own quantiles, drawn towards those of its language by its size: the spread is that from the median to
the quartile, which junk does not reach while it is less than a quarter of the group. A document outside
the bounds of its group is rejected. Two fixed base rules come first.

Defined results: a null or empty text has no words and fails the base rules; a null language or source
is a group of its own; an empty table gives no rows; other columns of the input, whatever their names, do not matter.
Equal rows get equal verdicts, and the verdicts depend on the table's rows only, not on their order or partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
UNIT = 1_000_000  # measures are whole numbers of such parts
BITS = 8  # binary digits that a bin of the sketches tells apart
SHRINK = 200  # rows of its language that a group's own quantiles are weighed against
REACH = 10.0  # distance of a bound from the median, in distances of the outer quartile

#: Measure: (sides that are bounded, least distance of a bound from the median, in millionths).
MEASURES = {
    "symbol_share": ("upper", 50_000),
    "dup_line_share": ("upper", 300_000),
    "repeat_share": ("upper", 300_000),
    "word_length": ("both", 500_000),
}


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def measured(df: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """`keep` and the base counts q_words, q_chars, q_symbols, q_dup_lines, q_repeat, all long."""
    body = F.coalesce(F.col(text), F.lit(""))
    kept = [f"q_keep{i}" for i in range(len(keep))]
    bare = body
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    one = df.select(
        *[c.alias(k) for c, k in zip(keep, kept, strict=True)],
        _words(F.col(text)).alias("q_w"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("q_lines"),
        (F.length(body) - F.length(bare)).cast("long").alias("q_symbols"),
    )
    n = F.size("q_w")
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("q_w", i), F.get("q_w", i + 1), F.get("q_w", i + 2))))
    two = one.select(
        *kept,
        "q_symbols",
        n.cast("long").alias("q_words"),
        F.length(F.array_join("q_w", "")).cast("long").alias("q_chars"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("q_dup_lines"),
        grams.alias("q_grams"),
    )
    # Few texts repeat a window; only those sort theirs.
    repeats = F.coalesce(F.size("q_grams") != F.size(F.array_distinct("q_grams")), F.lit(False))
    three = two.withColumn("q_sorted", F.when(repeats, F.sort_array(F.transform("q_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i: F.coalesce((i > 0) & (F.get("q_sorted", i - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce(F.get("q_sorted", i + 1)["h"] == x["h"], F.lit(False))
    four = three.withColumn("q_at", F.sort_array(F.transform(F.filter("q_sorted", same), lambda x: x["i"])))
    covered = F.aggregate(F.transform("q_at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("q_at", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return four.select(*[F.col(k).alias(k) for k in kept], "q_words", "q_chars", "q_symbols", "q_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("q_repeat"))


def base_failed() -> Column:
    return (F.col("q_words") < 50) | (100 * F.col("q_repeat") > 50 * F.col("q_words"))


def _shares() -> dict[str, Column]:
    """The measures in millionths, as whole numbers, so that they are the same wherever they are computed."""
    return {
        "symbol_share": F.expr(f"q_symbols * {UNIT} div greatest(q_chars, 1)"),
        "dup_line_share": F.expr(f"q_dup_lines * {UNIT} * 10 div greatest(q_words, 1)"),  # repeated lines for ten words
        "repeat_share": F.expr(f"q_repeat * {UNIT} div greatest(q_words, 1)"),
        "word_length": F.expr(f"q_chars * {UNIT} div greatest(q_words, 1)"),
    }


def bin_of(value: Column) -> Column:
    """The least number with the first BITS binary digits of this one: a bin of the sketch."""
    shift = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(rows: DataFrame, lang: str, source: str) -> DataFrame:
    """The sketch of each measure of each group: q_lang, q_source, measure, bin, n. Sketches merge by adding up; a group has some hundreds of bins at most."""
    pairs = ", ".join(f"'{m}', {m}" for m in MEASURES)
    each = rows.select(F.col(lang).alias("q_lang"), F.col(source).alias("q_source"), F.expr(f"stack({len(MEASURES)}, {pairs}) AS (measure, value)"))
    return each.groupBy("q_lang", "q_source", "measure", bin_of(F.col("value")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, by: list[str], prefix: str) -> DataFrame:
    """The number of rows and the three quartiles of each measure, by some of the sketch's columns: the sketches of the others are merged."""
    merged = sketch.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))
    up = W.partitionBy(*by, "measure")
    summed = merged.select(*by, "measure", "bin", F.sum("n").over(up).alias("total"), F.sum("n").over(up.orderBy("bin")).alias("below"))
    found = [F.min(F.when(4 * F.col("below") >= k * F.col("total"), F.col("bin"))).cast("double").alias(f"{prefix}{k}") for k in (1, 2, 3)]
    return summed.groupBy(*by, "measure").agg(F.max("total").alias(f"{prefix}n"), *found)


def thresholds(rows: DataFrame, lang: str, source: str, scratch: Scratch) -> DataFrame:
    """Bounds (q_lang, q_source, lo_M, hi_M for each measure M) of every group of `rows` that passed the base rules."""
    sketch = scratch.save(sketches(rows, lang, source), "sketches")
    group, tongue, whole = quartiles(sketch, ["q_lang", "q_source"], "g"), quartiles(sketch, ["q_lang"], "l"), quartiles(sketch, [], "w")
    tongue = tongue.withColumnsRenamed({"q_lang": "l_lang", "measure": "l_measure"})
    joined = group.join(tongue, F.col("q_lang").eqNullSafe(F.col("l_lang")) & (F.col("measure") == F.col("l_measure"))).join(whole.withColumnRenamed("measure", "w_measure"), F.col("measure") == F.col("w_measure"))
    within = lambda k: (F.col(f"l{k}") * F.col("ln") + F.col(f"w{k}") * SHRINK) / (F.col("ln") + SHRINK)
    drawn = lambda k: (F.col(f"g{k}") * F.col("gn") + within(k) * SHRINK) / (F.col("gn") + SHRINK)
    drawn_ = joined.select("q_lang", "q_source", "measure", *[drawn(k).alias(f"d{k}") for k in (1, 2, 3)])
    out = []
    for m, (sides, least) in MEASURES.items():
        pick = lambda c, m=m: F.max(F.when(F.col("measure") == m, c))
        out.append(pick(F.col("d2") + F.greatest((F.col("d3") - F.col("d2")) * REACH, F.lit(float(least)))).alias(f"hi_{m}"))
        out.append(pick(F.col("d2") - F.greatest((F.col("d2") - F.col("d1")) * REACH, F.lit(float(least))) if sides == "both" else F.lit(-1.0)).alias(f"lo_{m}"))
    return drawn_.groupBy("q_lang", "q_source").agg(*out)


def judge(df: DataFrame, keep: list[str], text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """`keep`, the base counts, q_base_failed and q_kept for each row of df."""
    spark = df.sparkSession
    rows = measured(df, text, [*[F.col(c) for c in keep], F.col(lang), F.col(source)])
    rows = rows.withColumn("q_base_failed", base_failed())
    for m, c in _shares().items():
        rows = rows.withColumn(m, c)
    n = len(keep)
    scratch = Scratch(spark, "quality")
    rows = scratch.save(rows, "measures")  # read twice instead of measuring twice
    # One row for each group. Spark broadcasts the table only if its files are small enough, and then the documents are not shuffled.
    bounds = scratch.save(thresholds(rows.where(~F.col("q_base_failed")), f"q_keep{n}", f"q_keep{n + 1}", scratch), "bounds")
    scratch.drop("sketches")
    within = F.lit(True)
    for m in MEASURES:
        within &= F.coalesce(F.col(m).cast("double").between(F.col(f"lo_{m}"), F.col(f"hi_{m}")), F.lit(True))
    joined = rows.join(bounds, F.col(f"q_keep{n}").eqNullSafe(F.col("q_lang")) & F.col(f"q_keep{n + 1}").eqNullSafe(F.col("q_source")), "left")
    return joined.select(*[F.col(f"q_keep{i}").alias(c) for i, c in enumerate(keep)], "q_words", "q_chars", "q_symbols", "q_dup_lines", "q_repeat", "q_base_failed", (~F.col("q_base_failed") & within).alias("q_kept"))
