"""Mixing sources to target weights by subset sums over exact token lengths.

1. Documents are counted by (source, exact length); only these counts enter the fitting.
2. Sources in code-point order, null last, weigh 1, 2, 3, 1, ... and share all words; a target stops at
   3 times its source's size and the excess is shared again by weight.
3. A target is whole copies of the source plus a remaining budget. The budget takes the same share of
   every length, rounded down; what is left is fitted by a bounded-knapsack dynamic programme over the
   spare documents of each length (a bitset of reachable sums), after the longest lengths that fit have
   brought it below a fixed window.
4. Of each length, the number of documents decided on is selected by a seeded hash of id, size and text: up to a
   hash, which is found from counts by the hash's first byte and a ranking of the one bucket in which the cut falls. Documents are
   then decided one by one by their length's row of the plan, which is broadcast up to BROADCAST rows and joined on a
   salted key beyond, so a length that holds a third of all rows is never in one task and texts aren't shuffled.
   Where the cut falls among equal rows, these are numbered by partition.

Defined cases: null texts have size 0 and are never taken; equal rows are interchangeable; an empty table
gives an empty result; a table without a source column has one null source; further columns may have any name. The
driver holds a row for each source.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, n_words, text_of

CAP = 3
WINDOW = 1 << 16
SEED = 17
#: Rows of a plan (some 60 bytes each) that are broadcast, and the salts of a key beyond.
BROADCAST = 400_000
SALTS = 32


def targets(sizes: dict, cap: int = CAP) -> dict:
    """Target of each source from its size; sources in code-point order, None last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total = sum(sizes.values())
    full: set = set()
    while True:
        rest, left = [s for s in order if s not in full], total - cap * sum(sizes[s] for s in full)
        whole = sum(weight[s] for s in rest)
        share = {s: left * weight[s] / whole for s in rest}
        over = {s for s in rest if share[s] > cap * sizes[s]}
        if not over:
            return {s: float(cap * sizes[s]) if s in full else share[s] for s in order}
        full |= over


def fit(lengths: list[int], spare: list[int], budget: int) -> list[int]:
    """How many documents of each length to take so that the sum comes as near below budget as it can.

    Exact within WINDOW of the budget: takes are greedy from the longest length down to a remainder of
    less than WINDOW, then a bounded knapsack over what is spare.
    """
    taken = [0] * len(lengths)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        if budget < WINDOW:
            break
        n = min(spare[i], (budget - WINDOW // 2) // lengths[i] if budget - WINDOW // 2 >= lengths[i] else 0)
        taken[i] += n
        budget -= n * lengths[i]
    budget = max(0, budget)
    mask, reach, steps = (1 << (budget + 1)) - 1, 1, []
    for i in reversed(order):
        left, size = min(spare[i] - taken[i], budget // lengths[i]), 1
        while left > 0 and not reach >> budget & 1:
            n = min(size, left)
            steps.append((i, n, reach))
            reach |= (reach << n * lengths[i]) & mask
            left, size = left - n, size * 2
    at = reach.bit_length() - 1
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += n
            at -= n * lengths[i]
    return taken


def plan_source(lengths: list[int], counts: list[int], target: float) -> tuple[int, list[int]]:
    """(whole copies of all documents, how many documents of each length get one copy more)."""
    size = sum(a * b for a, b in zip(lengths, counts, strict=True))
    if not size:
        return 0, [0] * len(lengths)
    whole = min(CAP, int(target // size))
    budget = round(target - whole * size) if whole < CAP else 0
    even = [n * budget // size for n in counts]
    more = fit(lengths, [n - e for n, e in zip(counts, even, strict=True)], budget - sum(a * b for a, b in zip(lengths, even, strict=True)))
    return whole, [a + b for a, b in zip(even, more, strict=True)]


KEY = ["mix_source", "mix_size"]


def sized(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, source, size, a seeded hash and the row's partition for every document; with all columns in a struct doc, if whole."""
    source = (F.col("source") if "source" in docs.columns else F.lit(None)).cast("string")
    kept = F.struct(*[F.col(c) for c in docs.columns]) if whole else F.lit(0)
    got = docs.select("doc_id", source.alias("mix_source"), n_words(text_of(docs)).alias("mix_size"), F.xxhash64(text_of(docs)).alias("mix_text"), kept.alias("doc"))
    return got.select("doc_id", *KEY, F.xxhash64(F.lit(SEED), "doc_id", "mix_size", "mix_text").alias("mix_hash"), F.spark_partition_id().alias("mix_part"), "doc")


def _by_key(rows: DataFrame, plan: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """Rows with the plan's row of their source and size; mix_hash salts the key of a large plan."""
    plan = plan.withColumnsRenamed({"mix_source": "p_source", "mix_size": "p_size"})
    on = F.col("mix_source").eqNullSafe(F.col("p_source")) & (F.col("mix_size") == F.col("p_size"))
    if few:
        return rows.join(F.broadcast(plan), on, how).drop("p_source", "p_size")  # BROADCAST rows at most
    plan = plan.withColumn("p_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(plan, on & (F.pmod("mix_hash", F.lit(SALTS)) == F.col("p_salt")), how).drop("p_source", "p_size", "p_salt")


def _decided(docs: DataFrame, whole: bool = False, broadcast: int = BROADCAST) -> DataFrame:
    """sized() rows with source_size, target and copies."""
    spark = docs.sparkSession
    rows = cut(sized(docs, whole), "sized")
    hist = cut(rows.groupBy(*KEY).agg(F.count("*").alias("n")), "histogram")
    few = hist.count() <= broadcast
    # One row for each source.
    per = hist.groupBy("mix_source").agg(F.sum(F.col("mix_size") * F.col("n")).alias("source_size")).toPandas()
    sizes = {None if pd.isna(s) else s: int(n) for s, n in zip(per["mix_source"], per["source_size"], strict=True)}
    goal = targets(sizes) if sizes else {}
    goals = spark.createDataFrame([(s, sizes[s], goal[s]) for s in sizes], "s string, source_size long, target double")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("mix_size")
        live = pdf[pdf["mix_size"] > 0]
        whole, extra = plan_source([int(x) for x in live["mix_size"]], [int(x) for x in live["n"]], float(pdf["target"].iloc[0]))
        taken = dict(zip(live["mix_size"], extra, strict=True))
        return pdf.assign(whole=[whole if z else 0 for z in pdf["mix_size"]], extra=[taken.get(z, 0) for z in pdf["mix_size"]])

    # A source has a row for each length here, not for each document.
    joined = hist.join(goals, F.col("mix_source").eqNullSafe(F.col("s"))).drop("s")
    plans = cut(joined.groupBy("mix_source").applyInPandas(plan, "mix_source string, mix_size long, n long, source_size long, target double, whole int, extra long"), "plan")

    part = plans.where("extra > 0 and extra < n").select(*KEY, "extra")
    slim = rows.select(*KEY, "mix_hash", F.shiftright("mix_hash", 56).alias("bucket"))
    counts = slim.groupBy(*KEY, "bucket").agg(F.count("*").alias("b_n"))
    by_bucket, by_hash = (Window.partitionBy(*KEY).orderBy(c) for c in ("bucket", "mix_hash"))
    falls = _by_key(counts.withColumn("mix_hash", F.col("bucket")), part, few).withColumn("up", F.sum("b_n").over(by_bucket))  # 256 rows at most
    falls = falls.where("up >= extra and up - b_n < extra").select(*KEY, F.col("bucket").alias("at"), (F.col("extra") - F.col("up") + F.col("b_n")).alias("of_bucket"))
    edge = _by_key(slim, falls, few).where("bucket = at").groupBy(*KEY, "mix_hash").agg(F.count("*").alias("ties"), F.first("of_bucket").alias("of_bucket"))
    edge = edge.withColumn("up", F.sum("ties").over(by_hash)).where("up >= of_bucket and up - ties < of_bucket")
    cuts = edge.select(F.col("mix_source").alias("c_source"), F.col("mix_size").alias("c_size"), F.col("mix_hash").alias("cut_hash"), "ties", (F.col("of_bucket") - F.col("up") + F.col("ties")).alias("of_ties"))
    plans = plans.join(cuts, F.col("mix_source").eqNullSafe(F.col("c_source")) & (F.col("mix_size") == F.col("c_size")), "left").drop("c_source", "c_size")
    plans = cut(plans, "cuts")

    full = _by_key(rows, plans, few)
    one = F.when(F.col("extra") >= F.col("n"), F.col("n") > 0).when(F.col("extra") == 0, False).when(F.col("mix_hash") == F.col("cut_hash"), F.col("of_ties") == F.col("ties")).otherwise(F.col("mix_hash") < F.col("cut_hash"))
    full = full.withColumn("one", one.cast("int"))
    split = (F.col("mix_hash") == F.col("cut_hash")) & (F.col("of_ties") < F.col("ties"))
    if plans.where("of_ties < ties").limit(1).count():
        loose = full.where(split)
        in_part = Window.partitionBy(*KEY, "mix_part").orderBy("mix_hash", F.xxhash64("doc"))
        held = loose.groupBy(*KEY, "mix_part").agg(F.count("*").alias("c"))
        before = held.withColumn("offset", F.sum("c").over(Window.partitionBy(*KEY).orderBy("mix_part")) - F.col("c"))  # a row for each partition
        before = before.select(F.col("mix_source").alias("b_source"), F.col("mix_size").alias("b_size"), F.col("mix_part").alias("b_part"), "offset")
        same = F.col("mix_source").eqNullSafe(F.col("b_source")) & (F.col("mix_size") == F.col("b_size")) & (F.col("mix_part") == F.col("b_part"))
        placed = loose.withColumn("nth", F.row_number().over(in_part)).join(before, same)
        placed = placed.withColumn("one", (F.col("nth") + F.col("offset") <= F.col("of_ties")).cast("int")).drop("nth", "b_source", "b_size", "b_part", "offset")
        full = full.where(~F.coalesce(split, F.lit(False))).unionByName(placed)
    return full.withColumn("copies", (F.col("whole") + F.col("one")).cast("long"))


def mix(docs: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """doc_id, size, source, source_size, target, copies and taken for every document."""
    got = _decided(docs, broadcast=broadcast)
    return got.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source").alias("source"), "source_size", "target", "copies", (F.col("copies") * F.col("mix_size")).alias("taken"))


def apply(docs: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """The documents themselves, each as often as the mix takes it."""
    got = _decided(docs, True, broadcast).where("copies > 0")
    return got.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


__all__ = ["apply", "fit", "mix", "plan_source", "targets"]
