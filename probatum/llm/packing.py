"""Optimal length buckets: a dynamic programme over the global histogram, then token-budget batches.

1. A document's length is its number of tokens by a byte-level vocabulary, whose path is a parameter. Documents are
   counted by exact length; the histogram has one row for each distinct length.
2. A dynamic programme chooses at most K bucket boundaries, each a length that occurs, so that the padding
   of all documents to their bucket's boundary is least. The largest length is always a boundary: nothing
   is cut off.
3. Inside a bucket a batch holds as many rows as fit its token budget at the bucket's length, at least one.
   Places are dense numbers: rows are numbered within hash shares of a bucket and shares are offset by the
   counts before them, so no bucket is sorted in one task and only a bucket's last batch is not full.

Defined cases: null texts have length 0 and share the first bucket; repeated rows are packed one by one; an
empty table gives an empty result; clashing columns (bucket, batch, ...) are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut
from .token_attribution import VOCABULARY, totals

BUCKETS = 8
BUDGET = 65_536
SHARE = 20_000


def boundaries(lengths, counts, k: int = BUCKETS) -> list[int]:
    """At most k boundaries that minimise padding, the largest length among them.

    cost[j][i]: least padded total of the i shortest lengths in j buckets. The best split never moves
    left as i grows, so each layer is solved by divide and conquer in n log n steps.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    order = np.argsort(lengths)
    lengths, counts = lengths[order], counts[order]
    n = len(lengths)
    if n <= k:
        return [int(x) for x in lengths]
    docs = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    best = np.concatenate([[0.0], docs[1:] * lengths])
    splits = []
    for j in range(2, k + 1):
        nxt, at = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        work = [(j, n, j - 1, n - 1)]
        while work:
            lo, hi, a, b = work.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            s = np.arange(a, min(b, mid - 1) + 1)
            cost = best[s] + (docs[mid] - docs[s]) * lengths[mid - 1]
            i = int(np.argmin(cost))
            nxt[mid], at[mid] = cost[i], s[i]
            work += [(lo, mid - 1, a, int(s[i])), (mid + 1, hi, int(s[i]), b)]
        best, splits = nxt, [*splits, at]
    out, i = [], n
    for at in reversed(splits):
        out.append(int(lengths[i - 1]))
        i = int(at[i])
    return [*reversed([*out, int(lengths[i - 1])])]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, share: int = SHARE, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_length, rows_per_batch, batch, place and padding for every document."""
    spark = docs.sparkSession
    rows = cut(totals(docs, vocabulary), "lengths")
    # One row for each distinct length.
    hist = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).toPandas()
    bounds = boundaries(hist["n_tokens"], hist["n"], buckets) if len(hist) else []
    held = [int(hist.loc[(hist["n_tokens"] <= b) & (hist["n_tokens"] > a), "n"].sum()) for a, b in zip([-1, *bounds], bounds, strict=False)]
    table = [(i, b, max(1, budget // max(1, b)), max(1, -(-n // share))) for i, (b, n) in enumerate(zip(bounds, held, strict=True))]
    dim = spark.createDataFrame(table, "bucket int, bucket_length long, rows_per_batch long, shares int")  # at most K rows
    which = F.lit(0)
    for b in bounds[:-1]:
        which = which + (F.col("n_tokens") > b).cast("int")
    placed = rows.withColumn("bucket", which.cast("int")).join(F.broadcast(dim), "bucket")
    placed = placed.withColumn("h", F.xxhash64(F.lit(29), F.col("doc_id"), F.col("n_tokens"))).withColumn("share", F.pmod("h", "shares").cast("int"))
    counts = placed.groupBy("bucket", "share").agg(F.count("*").alias("c"))
    before = counts.withColumn("offset", F.sum("c").over(Window.partitionBy("bucket").orderBy("share")) - F.col("c")).drop("c")  # a row for each 20,000 documents
    numbered = placed.withColumn("k", F.row_number().over(Window.partitionBy("bucket", "share").orderBy("h", "doc_id")))
    whole = numbered.join(before, ["bucket", "share"]).withColumn("k", F.col("k") + F.col("offset") - 1)
    return whole.select(
        "doc_id", "n_tokens", "bucket", "bucket_length", "rows_per_batch",
        F.expr("k div rows_per_batch").alias("batch"), (F.col("k") % F.col("rows_per_batch")).alias("place"), (F.col("bucket_length") - F.col("n_tokens")).alias("padding"),
    )
