"""Quality classifier without labels: voting heuristics, expectation-maximisation, a hashed linear scorer.

1. Labellers vote junk (0), good (1) or abstain (-1) on measures of a document. Votes overlap, disagree and err:
   most kinds of junk are seen by several labellers, some of which are loose.
2. Documents are counted by vote pattern (at most 3^labellers rows). Expectation-maximisation over these
   counts, which is the same as over all documents, estimates for either class how often each labeller
   that votes says junk, and the share of good documents; a pattern's posterior is its label. An abstention
   speaks for neither class. Nothing is pinned: a labeller's accuracy follows from its agreement with the others.
3. A linear scorer on hashed features (distinct word shapes and steps of the measures) is fitted to these
   posteriors on a bounded sample: SAMPLE documents with the least hashes (of id, votes and features) and as many of those
   with a junk vote, weighted back to their shares. All documents are scored, within the JVM.
4. A document is kept if its score is at least 0.5.

Defined cases: a null text is empty and judged as such; repeated rows are judged one by one, and rows that tie for the
sample's last places are equal in all that is fitted; ids may be missing or all the same; with no rows nothing is fitted; with only one class all posteriors
agree; further columns, whatever their names, are carried by keep() only.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of, words

#: Bound of the rows that the scorer is fitted on, for each of its two strata.
SAMPLE = 8_000
DIMS = 4_096
#: Pseudo-documents of each class and labeller, and the share of junk votes among them.
PRIOR, JUNK_VOTES = 10.0, (0.2, 0.02)


def _rate(a: Column, b: Column, by: int = 1000) -> Column:
    return F.floor(a * by / F.greatest(b, F.lit(1))).cast("long")


def measures(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id and measures of every document; with all its columns in a struct doc, if whole."""
    text = text_of(docs)
    keep = ["doc"] if whole else []
    base = docs.select("doc_id", *([F.struct(*[F.col(c) for c in docs.columns]).alias("doc")] if whole else []), text.alias("t"), words(text).alias("w"))
    without = lambda chars: F.length("t") - F.length(F.translate("t", chars, ""))
    n = F.size("w")
    chars = F.length(F.translate("t", " \t\n\x0b\x0c\r", ""))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(x) > 0)
    shaped = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", r"\p{Lu}+", "A"), r"[\p{Ll}\p{Lo}]+", "a"), r"\p{Nd}+", "0")
    got = base.select(
        "doc_id", *keep,
        n.alias("n_words"),
        _rate(without("#*$%&<>@^~="), chars).alias("symbols"),
        _rate(without("|"), n).alias("bars"),
        _rate(without("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), chars).alias("upper"),
        _rate(without("!?"), n).alias("bangs"),
        _rate(F.size(F.array_distinct("w")), n).alias("distinct"),
        _rate(without("."), n).alias("stops"),
        _rate(F.size(F.filter("w", lambda x: F.length(x) == 1)), n).alias("single"),
        _rate(chars, n, 10).alias("length"),
        F.transform(F.array(lines), lambda x: _rate(F.size(x) - F.size(F.array_distinct(x)), F.size(x)))[0].alias("same_lines"),
        F.array_distinct(F.transform(F.array_distinct(words(shaped)), lambda s: F.substring(s, 1, 12))).alias("shapes"),
    )
    return got


#: (name, junk if, good if); in parts per thousand, and tenths of a character for length.
LABELLERS = (
    ("symbols", "symbols > 60", "symbols < 15"),
    ("bars", "bars > 150", "bars < 20"),
    ("single", "n_words >= 10 and single > 180", "single < 100"),
    ("upper", "upper > 400", "upper < 150"),
    ("capitals", "n_words >= 10 and upper > 60", "upper < 40"),
    ("bangs", "bangs > 200", "bangs < 40"),
    ("distinct", "n_words >= 20 and distinct * sqrt(n_words) < 2200", "distinct * sqrt(n_words) > 3000"),
    ("variety", "n_words >= 20 and distinct * sqrt(n_words) < 6000", "n_words >= 20 and distinct * sqrt(n_words) > 8000"),
    ("same_lines", "same_lines > 500", "same_lines < 250"),
    ("stops", "n_words >= 30 and stops < 20", "stops between 20 and 400"),
    ("length", "n_words >= 10 and (length > 65 or length < 40)", "length between 43 and 60"),
    ("words", "n_words < 3", "n_words >= 8"),
)


def votes() -> Column:
    return F.array(*[F.expr(f"CASE WHEN {junk} THEN 0 WHEN {good} THEN 1 ELSE -1 END") for _, junk, good in LABELLERS])


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500):
    """(posterior of good per pattern, share of good, rates [class, labeller] of junk among a labeller's votes).

    Classes are junk (0) and good (1); estimation starts from 'good has no junk vote' and moves on from there.
    """
    junk, good = (patterns == 0).astype(float), (patterns == 1).astype(float)
    p = np.where(junk.any(1), 0.02, 0.98) if len(patterns) else np.zeros(0)
    share, rates = 0.5, np.tile(np.array(JUNK_VOTES)[:, None], patterns.shape[1])
    for _ in range(rounds):
        w = np.stack([counts * (1 - p), counts * p])
        share = float((w[1].sum() + 1) / (w.sum() + 2))
        said = w @ junk
        rates = (said + PRIOR * np.array(JUNK_VOTES)[:, None]) / (said + w @ good + PRIOR)
        z = np.log(share / (1 - share)) + junk @ np.log(rates[1] / rates[0]) + good @ np.log((1 - rates[1]) / (1 - rates[0]))
        new = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        moved, p = np.abs(new - p).max(initial=0), new
        if moved < 1e-9:
            break
    return p, share, rates


def accuracies(patterns: np.ndarray, counts: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Of each labeller's votes, the share that agrees with the posteriors."""
    right = (counts * p) @ (patterns == 1) + (counts * (1 - p)) @ (patterns == 0)
    return right / np.maximum(counts @ (patterns >= 0), 1)


def hashed() -> Column:
    """Places of a document's features among DIMS weights, each once, so that no text has more than DIMS."""
    steps = [F.concat(F.lit(f"{m}~"), F.floor(F.log2(F.col(m) + 1.0) * 2).cast("string")) for m in ("n_words", "symbols", "bars", "upper", "bangs", "distinct", "stops", "single", "length", "same_lines")]
    both = F.concat(F.array(*steps), F.transform("shapes", lambda s: F.concat(F.lit("#"), s)))
    return F.array_distinct(F.transform(both, lambda s: F.pmod(F.xxhash64(s), F.lit(DIMS)).cast("int")))


def fit(rows: list[tuple[list[int], float, float]], rounds: int = 60, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by adaptive gradient steps: rows of (places, label, weight). Features are scaled to 1/sqrt(n)."""
    w, b = np.zeros(DIMS), 0.0
    if not rows:
        return w, 20.0
    at = np.concatenate([np.asarray(r[0], np.int64) for r in rows])
    of = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    scale = (1 / np.sqrt([max(len(r[0]), 1) for r in rows]))[of]
    y, k = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    k = k / k.sum()
    g2, gb2 = np.full(DIMS, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(of, weights=w[at] * scale, minlength=len(rows)) + b
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * k
        g = np.bincount(at, weights=e[of] * scale, minlength=DIMS) + decay * w
        gb = e.sum()
        g2, gb2 = g2 + g * g, gb2 + gb * gb
        w, b = w - rate * g / np.sqrt(g2), b - rate * gb / np.sqrt(gb2)
    return w, float(b)


def _scored(docs: DataFrame, sample: int, whole: bool = False) -> DataFrame:
    measured = measures(docs, whole).withColumn("votes", votes()).withColumn("places", hashed())
    rows = cut(measured.select("doc_id", *(["doc"] if whole else []), "votes", "places"), "votes")
    counted = rows.groupBy("votes").agg(F.count("*").alias("n")).collect()  # at most 3^12 patterns
    patterns = np.array([r.votes for r in counted], np.int64).reshape(len(counted), len(LABELLERS))
    p, _, _ = expectation_maximisation(patterns, np.array([r.n for r in counted], float))
    label = {tuple(r.votes): float(x) for r, x in zip(counted, p, strict=True)}
    total = sum(r.n for r in counted)
    doubted = sum(r.n for r in counted if 0 in r.votes)
    part = rows.select("votes", "places", F.xxhash64(F.lit(3), "doc_id", "votes", "places").alias("h"))
    data = []
    for sub, n in ((part.where(~F.array_contains("votes", 0)), total - doubted), (part.where(F.array_contains("votes", 0)), doubted)):
        # The least hashes lie below this bound, so that no task sends a whole sample of its own.
        below = int(-(2**63) + 2**64 * min(1.0, 2 * sample / max(n, 1)))
        least = lambda df: df.orderBy("h", "votes", "places").limit(sample).collect()
        got = least(sub.where(F.col("h") < below) if below < 2**63 else sub)
        if len(got) < min(sample, n):  # few different rows, each many times
            got = least(sub)
        data += [(r.places, label[tuple(r.votes)], n / max(len(got), 1)) for r in got]
    w, b = fit(data)
    table = docs.sparkSession.createDataFrame([(list(k), v) for k, v in label.items()], "votes array<int>, posterior double")
    return score(rows, w, b).join(F.broadcast(table), "votes")  # at most 3^12 patterns


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, votes, posterior, score and kept for every document."""
    return _scored(docs, sample).select("votes", "doc_id", "score", "kept", "posterior")


def score(rows: DataFrame, w: np.ndarray, b: float) -> DataFrame:
    weights = F.from_json(F.lit(json.dumps([round(float(x), 9) for x in w])), "array<double>")
    total = F.aggregate("places", F.lit(0.0), lambda a, i: a + F.get(weights, i))
    z = F.lit(b) + total / F.sqrt(F.greatest(F.size("places"), F.lit(1)))
    return rows.withColumn("score", 1 / (1 + F.exp(-z))).withColumn("kept", F.col("score") >= 0.5).drop("places")


def keep(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that the classifier keeps, with their columns; they travel with their votes, so nothing is joined."""
    return _scored(docs, sample, True).where("kept").select("doc.*")
