"""Spelling variants: words at an edit distance of one, found by asymmetric q-chunks, and the form that each belongs to.

1. Runs of letters are counted over whole texts: combined within each task first, so that a frequent word is no hot key.
2. Of two words, the shorter (of equal ones, the lesser), of n characters, gives two disjoint chunks of q = n div 2 characters: its first
   ones and its last. The other gives its positional grams of q characters, for the n that it can meet, at all places within one of
   a chunk's. An edit touches one chunk at most; the other is a gram, shifted by one at most: chunks join grams on n, chunk and content.
3. Many words share a chunk. What lies beside it, before the last chunk or after the first, differs by that one edit at most, so its first
   half or its last is equal as well, at the same end. Rows therefore join on chunk and half at once, and a group holds
   words that agree in three quarters of their characters, not all that share a beginning.
4. What meets is verified by the edit distance of characters. A word's form is its most frequent neighbour, if that is RATIO times as
   frequent; forms are followed to the last by doubling, in as many rounds as the length of the longest chain has binary digits.

All joins are merges, said by hints: their sides grow with the words, and Spark takes a side for small by the files that it comes from,
although each word gives up to 4 chunks and 20 grams; its driver would then have to hold them.

Defined cases: a null text has no words; a null doc_id counts as the empty text before the colon; repeated rows count
as often as they occur; a table without such words gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_ascii

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: A word in so many loses a character, chosen by its hash.
DROPPED = 199
LETTERS = r"A-Za-zÀ-ÿ"


def damaged(doc_id: Column, word: Column) -> Column:
    """The word without the character that its hash says, if its hash says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word))
    at = F.pmod(h, F.length(word).cast("long")).cast("int")
    return F.when(F.pmod(h, F.lit(DROPPED)) == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def words_of(docs: DataFrame, length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): runs of letters of so many characters, lower-cased in A-Z, with their counts over all texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")) if "text" in docs.columns else F.lit("")
    # Shorter runs can't become longer; a match of so many letters takes its whole run.
    runs = docs.select(F.col("doc_id").alias("doc_id"), F.explode(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{length},}}"), 0)).alias("run"))
    words = runs.select(damaged(F.col("doc_id"), lower_ascii(F.col("run"))).alias("word"))
    return words.where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def _keys(word: Column, n: Column, which: int, at: Column, q: Column) -> Column:
    """What a word is joined by, if its gram of q characters at a place (from 0) is the first (0) or last (1) chunk of a word of n."""
    rest = F.substr(word, at + q + 1, F.length(word)) if which == 0 else F.substr(word, F.lit(1), at)
    half = ((n - q) / 2).cast("int")
    gram = F.substr(word, at + 1, q)
    return F.array(F.xxhash64(n, F.lit(2 * which), gram, F.substr(rest, F.lit(1), half)), F.xxhash64(n, F.lit(2 * which + 1), gram, F.substr(rest, F.length(rest) - half + 1, half)))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b) of all pairs of words (word, n) at an edit distance of one, each once."""
    w, size = F.col("word"), F.length("word")
    q = (size / 2).cast("int")
    chunks = words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.explode(F.array_distinct(F.concat(_keys(w, size, 0, F.lit(0), q), _keys(w, size, 1, size - q, q)))).alias("key"))
    grams = []
    for n in (size, size - 1):
        q = (n / 2).cast("int")
        for which, at in ((0, F.lit(0)), (0, F.lit(1)), (1, n - q - 1), (1, n - q), (1, n - q + 1)):
            grams.append(F.when((at >= 0) & (at <= size - q), _keys(w, n, which, at, q)).otherwise(F.array().cast("array<bigint>")))
    grams = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.explode(F.array_distinct(F.concat(*grams))).alias("key"))
    shorter = F.length("a") < F.length("b")
    met = chunks.join(grams.hint("merge"), "key").where(shorter | ((F.length("a") == F.length("b")) & (F.col("a") < F.col("b"))))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct()


def forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n_near, form, form_n) of words that have neighbours: the most frequent one, of equal ones the least, if frequent enough."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    best = F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("word")))
    g = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min("n_a").alias("own"), best.alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("own")
    return g.select("word", "n_near", F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form): a form is more frequent than its word, so every chain ends."""
    now = cut(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("further"))
        moved = cut(now.join(ahead.hint("merge"), F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, length: int = LEAST_LENGTH, count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = cut(words_of(docs, length, count), "words")
    found = cut(forms(words, near_pairs(words), ratio), "forms")
    ends = roots(found.where("form is not null").select("word", "form"))
    out = words.join(found.hint("merge"), "word", "left").join(ends.hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
