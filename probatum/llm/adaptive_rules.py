"""Quality rules with adaptive thresholds, in DataFrame functions only.

1. One pass over the texts gives counts for every document and rates per thousand of them.
2. A quantile sketch per (lang, source, measure) counts values cut to six significant bits, so a
   quantile is off by at most one part in 32. Sketches merge by adding counts: the sketch of a
   language, and of everything, come from those of its sources, and the result doesn't depend on
   how rows are dealt out. Documents that fail the base rule are out of them.
3. A measure's limit comes from its main body: from the first quartile up, percentile by percentile, to the last one
   before a jump, or the 99th. A jump is more than the relative MARGIN and what EVENTS events make of a median document of
   the group, whose size comes from sketches too. After a jump the limit lies a quarter of the way into the gap; without one
   it is the 99th percentile plus MARGIN, and a measure that is 0 up to there teaches nothing: then the limit of its
   language counts, then that of the whole corpus, else none. The same holds for a group of fewer than LEAST_DOCS documents.
   So junk sets no limit unless it is three quarters of a group, and groups differ as their bodies and gaps do.
4. A document goes if a count is over what the limit allows a text of its size by more than TAIL standard deviations of
   such a count (of events as rare as that, so short texts get more room than long ones). No count is fixed.
5. Documents are joined with their limits (nulls in lang or source form groups of their own).

Defined cases: null text is the empty text (fails the base rule); an empty table gives an empty
result; repeated rows are judged one by one; a table without lang or source has one null group; documents
of a corpus in which none passes the base rule have no limits; further columns are neither read nor returned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, text_of, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: measure: (its count, what the count is measured by, what one event adds to the count).
MEASURES = {"m_symbols": ("n_symbols", "word_chars", 1), "m_upper": ("n_upper", "word_chars", 1), "m_bangs": ("n_bangs", "n_words", 1), "m_dup_lines": ("n_dup_lines", "n_lines", 1), "m_repeats": ("n_repeat_words", "n_words", 2 * WINDOW), "m_same": ("n_same_words", "n_words", 1)}
SIZES = ("word_chars", "n_words", "n_lines")
#: A half: (2 + 1) / 2 in whole numbers.
MARGIN = (3, 2)
EVENTS = 4
TAIL = 3
LEAST_DOCS = 50


def _let(value, body):
    """Evaluate value once for a body of lambdas that use it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(word_array):
    """Words within windows of 8 that occur at least twice in the text, the first ones included."""

    def covered(starts):
        return F.aggregate(
            F.transform(starts, lambda s, k: F.coalesce(F.least(F.lit(WINDOW), F.get(starts, k + 1) - s), F.lit(WINDOW))),
            F.lit(0),
            lambda a, b: a + b,
        )

    def found(ordered):
        twice = F.filter(ordered, lambda x, k: (F.get(ordered, k + 1)["h"] == x["h"]).eqNullSafe(True) | ((k > 0) & (F.get(ordered, F.greatest(k - 1, F.lit(0)))["h"] == x["h"])))
        return _let(F.array_sort(F.transform(twice, lambda x: x["i"])), covered)

    def windows(h):
        last = F.size(h) - WINDOW
        return _let(
            F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])),
            lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(
                _let(F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), found)
            ),
        )

    return F.when(F.size(word_array) <= WINDOW, F.lit(0)).otherwise(_let(F.transform(word_array, lambda w: F.xxhash64(w)), windows)).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the measures of every document."""
    group = [(F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c) for c in ("lang", "source")]
    text = text_of(docs)
    base = docs.select("doc_id", *group, text.alias("t"), words(text).alias("w"))
    lines = F.filter(F.split(F.col("t"), "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")
    counted = base.select(
        "doc_id", "lang", "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        (F.length("t") - F.length(F.translate("t", "!", ""))).cast("long").alias("n_bangs"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
        F.size(F.filter("w", lambda x, i: x == F.get("w", i - 1))).cast("long").alias("n_same_words"),
    )
    rate = lambda a, b: F.floor(F.col(a) * 1000 / F.greatest(F.col(b), F.lit(1))).cast("long")
    return (
        counted.withColumn("n_dup_lines", F.col("lines.dup").cast("long"))
        .withColumn("n_lines", F.col("lines.n").cast("long"))
        .drop("lines")
        .withColumns({m: rate(count, by) for m, (count, by, _) in MEASURES.items()})
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    )


def sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, value, n): mergeable counts of values cut to six significant bits."""
    pairs = ", ".join(f"'{m}', {m}" for m in (*MEASURES, *SIZES))
    long = measured.where("not base_failed").selectExpr("lang", "source", f"stack({len(MEASURES) + len(SIZES)}, {pairs}) as (measure, v)")
    low = "greatest(length(bin(v)) - 6, 0)"
    return long.withColumn("value", F.expr(f"shiftleft(shiftright(v, {low}), {low})")).groupBy("lang", "source", "measure", "value").agg(F.count("*").alias("n"))


def merged(sketches: DataFrame) -> DataFrame:
    """Sketches of (lang, source) as level 0, of languages as level 1 and of everything as level 2."""
    lang = sketches.groupBy("lang", "measure", "value").agg(F.sum("n").alias("n"))
    every = lang.groupBy("measure", "value").agg(F.sum("n").alias("n"))
    none = F.lit(None).cast("string")
    return (
        sketches.select(F.lit(0).alias("level"), "lang", "source", "measure", "value", "n")
        .unionByName(lang.select(F.lit(1).alias("level"), "lang", none.alias("source"), "measure", "value", "n"))
        .unionByName(every.select(F.lit(2).alias("level"), none.alias("lang"), none.alias("source"), "measure", "value", "n"))
    )


def limits(sketches: DataFrame) -> DataFrame:
    """(lang, source, l_<measure>...): the limit of each measure for every group, in quarters of a thousandth; null for none."""
    group = Window.partitionBy("level", "lang", "source", "measure")
    cells = merged(sketches).withColumn("total", F.sum("n").over(group)).withColumn("up", F.sum("n").over(group.orderBy("value")))
    # Percentiles that fall into a cell: above first, up to last.
    cells = cells.withColumn("first", F.expr("100 * (up - n) div total")).withColumn("last", F.expr("100 * up div total"))
    cells = cut(cells, "cells")  # a row for each cell of a sketch
    sizes = cells.where(F.col("measure").isin(*SIZES) & (F.col("first") < 50) & (F.col("last") >= 50))
    sizes = sizes.groupBy(F.col("level").alias("z_level"), F.col("lang").alias("z_lang"), F.col("source").alias("z_source")).agg(*[F.max(F.when(F.col("measure") == z, F.col("value"))).alias(f"z_{z}") for z in SIZES])
    held = cells.where(~F.col("measure").isin(*SIZES)).where("last > first and last >= 25 and first < 99")
    held = held.join(sizes, (F.col("level") == F.col("z_level")) & F.col("lang").eqNullSafe(F.col("z_lang")) & F.col("source").eqNullSafe(F.col("z_source")))
    of = lambda column: reduce(lambda e, m: e.when(F.col("measure") == m, column(m)), MEASURES, F.when(F.lit(False), F.lit(0)))
    size, event = F.greatest(of(lambda m: F.col(f"z_{MEASURES[m][1]}")), F.lit(1)), of(lambda m: F.lit(MEASURES[m][2]))
    after = F.lead("value").over(group.orderBy("value"))
    jump = (MARGIN[1] * size * F.col("after") > MARGIN[0] * size * F.col("value") + MARGIN[1] * EVENTS * 1000 * event) | F.col("after").isNull()
    ends = held.withColumn("after", after).where(jump)
    wide = ends.groupBy("level", "lang", "source").agg(F.max("total").alias("total"), *[F.min(F.when(F.col("measure") == m, F.struct("value", "after"))).alias(f"l_{m}") for m in MEASURES])
    body = lambda m: F.when(F.col(f"l_{m}.after").isNotNull(), 3 * F.col(f"l_{m}.value") + F.col(f"l_{m}.after")).when(F.col(f"l_{m}.value") > 0, 4 * MARGIN[0] * F.col(f"l_{m}.value") / MARGIN[1])
    wide = cut(wide.withColumns({f"l_{m}": body(m).cast("long") for m in MEASURES}), "limits")
    named = lambda level, prefix: [F.col("total").alias(f"{prefix}_total"), *[F.col(f"l_{m}").alias(f"{prefix}_{m}") for m in MEASURES]]
    own = wide.where("level = 0").select("lang", "source", *named(0, "o"))
    lang = wide.where("level = 1").select(F.col("lang").alias("g_lang"), *named(1, "g"))
    every = wide.where("level = 2").select(*named(2, "a"))
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("g_lang"))).join(F.broadcast(every), F.lit(True))  # one row
    pick = lambda m: F.coalesce(F.when(F.col("o_total") >= LEAST_DOCS, F.col(f"o_{m}")), F.when(F.col("g_total") >= LEAST_DOCS, F.col(f"g_{m}")), F.col(f"a_{m}"))
    return joined.select("lang", "source", *[pick(m).alias(f"l_{m}") for m in MEASURES])


def judge(docs: DataFrame) -> DataFrame:
    """Counts, rates, base verdict, limits and kept for every document."""
    measured = cut(measures(docs), "measures")
    found = limits(sketch(measured)).withColumnsRenamed({"lang": "x_lang", "source": "x_source"})
    joined = measured.join(found, F.col("lang").eqNullSafe(F.col("x_lang")) & F.col("source").eqNullSafe(F.col("x_source")), "left")
    due = {m: F.col(f"l_{m}") * F.col(by) / 4000.0 for m, (_, by, _) in MEASURES.items()}
    beyond = [F.col(count) - due[m] > TAIL * F.sqrt(event * due[m]) for m, (count, _, event) in MEASURES.items()]
    failed = reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in beyond])
    return joined.withColumn("kept", ~F.col("base_failed") & ~failed).drop("x_lang", "x_source")


__all__ = ["judge", "limits", "measures", "merged", "repeat_words", "sketch"]
