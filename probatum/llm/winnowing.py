"""Benchmark decontamination by winnowing, in DataFrame functions only.

1. A text's words are its runs of letters, digits and characters beyond ASCII, A-Z lower-cased. Every K words are hashed, and of
   every SPAN - K + 1 hashes in a row, which cover SPAN words, the least is kept. Neighbouring windows that keep the same
   hash form a run; a run is one fingerprint, about a third as many as words. An equal span of SPAN words keeps an equal
   hash on both sides, so none can be missed. An item of fewer words is one window, kept by the hash of all of it; only for lengths
   that occur among items, every document's windows of that length are hashed as well.
2. Fingerprints of documents meet those of items by a broadcast of the items' distinct hashes, counted first: beyond MARKS they
   are taken in blocks by hash, with a pass over the documents for each. Texts aren't shuffled: a fingerprint that meets one
   goes on with the words of its run.
3. A hit is extended: each window of its run is compared, word for word, with the items' windows. The words that windows cover
   are a document's spans, and the items that have them its items.

Defined cases: a null text has no words, and an item without words no window; repeated rows are judged alike, one by one, and so are rows of
one doc_id with different texts; an item_id that occurs with several texts has the windows of all; an item without an id
marks words but isn't listed; an empty benchmark finds nothing, an empty table gives an empty result; further columns, whatever
their names, are ignored. Hashes of 64 bits only choose what is compared, but for rows of one doc_id, told apart by a hash of their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_ascii

K, SPAN = 6, 10
#: Distinct hashes that are broadcast at once (some 100 MB in an executor), and rows of items' windows.
MARKS, WINDOWS = 2_000_000, 500_000
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _let(value: Column, body) -> Column:
    """Evaluate value once for a body that uses it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def terms(text: Column) -> Column:
    plain = F.octet_length(text) == F.length(text)
    return F.array_remove(F.split(F.when(plain, F.lower(text)).otherwise(lower_ascii(text)), GAPS), "")


def _run(mark: Column, start: Column, length: Column, width: Column) -> Column:
    return F.struct(mark.alias("mark"), start.cast("int").alias("start"), length.cast("int").alias("length"), width.cast("int").alias("width"))


def _winnowed(words: Column, k: int, span: int) -> Column:
    """Runs (mark, start, length, width) of windows of span words that keep the same hash; length counts words."""

    def runs(least):
        starts = F.filter(F.sequence(F.lit(0), F.size(least) - 1), lambda i: ~F.get(least, i).eqNullSafe(F.get(least, i - 1)))
        of = lambda at: F.transform(at, lambda s, j: _run(F.get(least, s), s, F.coalesce(F.get(at, j + 1), F.size(least)) - s + span - 1, F.lit(span)))
        return _let(starts, of)

    def kept(grams):
        return _let(F.transform(F.sequence(F.lit(0), F.size(grams) - (span - k + 1)), lambda i: F.least(*[F.get(grams, i + j) for j in range(span - k + 1)]) if span > k else F.get(grams, i)), runs)

    def grams(hashes):
        return _let(F.transform(F.sequence(F.lit(0), F.size(hashes) - k), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)])), kept)

    return F.when(F.size(words) >= span, _let(F.transform(words, lambda w: F.xxhash64(w)), grams))


def _short(words: Column, width: int, whole: bool) -> Column:
    """Every window of fewer words than a span, as a run of its own; of texts of just that length, if whole."""
    at = lambda i: _run(F.xxhash64(F.lit(-width), *[F.get(words, i + j) for j in range(width)]), i, F.lit(width), F.lit(width))
    fits = F.size(words) == width if whole else F.size(words) >= width
    return F.when(fits, F.transform(F.sequence(F.lit(0), F.size(words) - width), at))


def _windows(found: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, width, win): every window of runs (keys, start, width, held: the run's words)."""
    at = F.sequence(F.lit(0), F.size("held") - F.col("width"))
    each = F.transform(at, lambda j: F.struct((F.col("start") + j).alias("pos"), F.array_join(F.slice("held", j + 1, F.col("width")), " ").alias("win")))
    return found.select(*keys, "width", F.inline(each))


def item_windows(items: DataFrame, k: int = K, span: int = SPAN) -> DataFrame:
    """(item_id, mark, width, win) of every item."""
    text = F.col("text").cast("string") if "text" in items.columns else F.lit(None).cast("string")
    words = items.select("item_id", terms(text).alias("w"))
    none = F.array().cast("array<struct<mark: bigint, start: int, length: int, width: int>>")
    runs = F.concat(*[F.coalesce(x, none) for x in (_winnowed(F.col("w"), k, span), *[_short(F.col("w"), n, True) for n in range(1, span)])])
    found = words.select("item_id", "w", F.inline(runs)).select("item_id", "mark", "start", "width", F.slice("w", F.col("start") + 1, F.col("length")).alias("held"))
    return _windows(found, "item_id", "mark").select("item_id", "mark", "width", "win").distinct()


def _met(docs: DataFrame, marks: DataFrame, blocks: int, lengths: list[int], k: int, span: int) -> DataFrame:
    """A row for each document (doc_id, h, n_words), and one for each of its runs that meets an item's (start, width, held)."""
    text = F.col("text").cast("string") if "text" in docs.columns else F.lit(None).cast("string")
    words = docs.select("doc_id", F.xxhash64(text).alias("h"), terms(text).alias("w"))
    none = F.array().cast("array<struct<mark: bigint, start: int, length: int, width: int>>")
    runs = [F.coalesce(x, none) for x in (_winnowed(F.col("w"), k, span), *[_short(F.col("w"), n, False) for n in lengths])]
    out = None
    for block in range(blocks):
        own = F.array(_run(F.lit(None).cast("long"), F.lit(0), F.lit(0), F.lit(0)))
        each = words.select("doc_id", "h", "w", F.inline(F.concat(own, *runs) if block == 0 else F.concat(*runs)))
        here = marks.where(F.pmod("mark", F.lit(blocks)) == block).select(F.col("mark").alias("met"))
        rows = each.join(F.broadcast(here), F.col("mark") == F.col("met"), "left").where(F.col("mark").isNull() | F.col("met").isNotNull())  # at most MARKS, on average
        size = F.when(F.col("mark").isNull(), F.coalesce(F.size("w"), F.lit(0)).cast("long"))
        rows = rows.select("doc_id", "h", size.alias("n_words"), "start", "width", F.when(F.col("mark").isNotNull(), F.slice("w", F.col("start") + 1, F.col("length"))).alias("held"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _merged(spans: Column) -> Column:
    """Sorted (start, end) whose overlaps and joints are closed."""
    last = lambda a: F.element_at(a, -1)
    span = lambda s, e: F.array(F.struct(s.alias("start"), e.alias("end")))
    grow = lambda a, x: F.when((F.size(a) > 0) & (F.get(a, F.size(a) - 1)["end"] >= x["start"]), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), span(last(a)["start"], F.greatest(last(a)["end"], x["end"])))).otherwise(F.concat(a, F.array(x)))
    return F.aggregate(spans, F.array().cast("array<struct<start: int, end: int>>"), grow)


def decontaminate(docs: DataFrame, items: DataFrame, k: int = K, span: int = SPAN, marks_at_once: int = MARKS) -> DataFrame:
    """doc_id, n_words, n_hit, spans (of words, end exclusive), items (sorted ids) and contaminated of every document."""
    windows = cut(item_windows(items, k, span), "windows")
    lengths = sorted(r.width for r in windows.where(F.col("width") < span).select("width").distinct().collect())  # below span
    marks = windows.select("mark").distinct()
    blocks = max(1, -(-marks.count() // marks_at_once))
    met = cut(_met(docs, marks, blocks, lengths, k, span), "met")

    pairs = windows.select("win", "item_id").distinct()
    pairs = F.broadcast(pairs) if pairs.count() <= WINDOWS else pairs
    hits = _windows(met.where("held is not null"), "doc_id", "h").join(pairs, "win")
    ends = F.array_sort(F.collect_set(F.struct(F.col("pos").alias("start"), (F.col("pos") + F.col("width")).alias("end"))))
    # A document's windows, and the items that it lists: both are its own row's.
    found = hits.select("doc_id", "h", "pos", "width", "item_id").distinct().groupBy("doc_id", "h").agg(ends.alias("ends"), F.array_sort(F.collect_set("item_id")).alias("items"))
    found = found.select(F.col("doc_id").alias("f_id"), F.col("h").alias("f_h"), _merged(F.col("ends")).alias("spans"), "items")
    every = met.where("n_words is not null").select("doc_id", "h", "n_words")
    joined = every.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & F.col("h").eqNullSafe(F.col("f_h")), "left")
    hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]), F.lit(0).cast("long"))
    return joined.select(
        "doc_id", "n_words", hit.alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<start: int, end: int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), (hit > 0).alias("contaminated"),
    )


def digest_of(items: Column) -> Column:
    """SHA-256 of ids as text, sorted as text and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ","), 256)
