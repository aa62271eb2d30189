"""Merkle roots over ordered leaves: leaf 0x00 + data, node 0x01 + left + right, an odd last node is promoted.

Aligned runs of RUN nodes are folded ten levels at once, each run in one row, so a table of n leaves takes
log(n) / log(RUN) shuffles and no row holds more than RUN hashes.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import merkle_leaf, merkle_node

EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
RUN = 1024


def _up(nodes: list[bytes]) -> list[bytes]:
    return [hashlib.sha256(b"\1" + nodes[i] + nodes[i + 1]).digest() if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]


def _root(nodes: list[bytes]) -> bytes:
    while len(nodes) > 1:
        nodes = _up(nodes)
    return nodes[0]


def _fold(runs: pd.Series) -> pd.Series:
    return runs.map(lambda hs: _root([bytes.fromhex(h) for h in hs]).hex())


def leaves(rows: DataFrame, index: str, data: str) -> DataFrame:
    """(i, h): hashed leaves; index is dense from 0."""
    return rows.select(F.col(index).cast("long").alias("i"), merkle_leaf(F.col(data)).alias("h"))


def folded(nodes: DataFrame) -> DataFrame:
    """(i, h) of the nodes that stand RUN times as high."""
    runs = nodes.groupBy(F.expr(f"i div {RUN}").alias("i")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("i").alias("k"), "h"))), lambda x: x["h"]).alias("hs"))
    return runs.select("i", F.pandas_udf(_fold, "string")(F.col("hs")).alias("h"))


def above(nodes: DataFrame) -> DataFrame:
    """(i, h) of the level above nodes (i, h), in expressions only."""
    side = lambda k: F.max(F.when(F.col("i") % 2 == k, F.col("h")))
    pairs = nodes.groupBy(F.expr("i div 2").alias("i")).agg(side(0).alias("l"), side(1).alias("r"))
    return pairs.select("i", F.when(F.col("r").isNull(), F.col("l")).otherwise(merkle_node(F.col("l"), F.col("r"))).alias("h"))


def root(rows: DataFrame, index: str, data: str) -> str:
    now, n = leaves(rows, index, data), rows.count()
    while n > 1:
        now, n = folded(now), -(-n // RUN)
    top = now.first()
    return top.h if top else EMPTY


def proof(rows: DataFrame, index: str, data: str, at: int) -> list[tuple[str, bool]]:
    """Sibling hashes of a leaf upwards, and whether each stands on the left. Only the leaf's own runs come to the driver."""
    now, n, out = leaves(rows, index, data), rows.count(), []
    if not 0 <= at < n:
        raise IndexError(at)
    while n > 1:
        run = [bytes.fromhex(r.h) for r in now.where(F.expr(f"i div {RUN}") == at // RUN).orderBy("i").collect()]  # RUN rows at most
        k, whole = at % RUN, n > RUN
        for _ in range(RUN.bit_length() - 1):
            if len(run) == 1 and not whole:
                break
            if (k ^ 1) < len(run):
                out.append((run[k ^ 1].hex(), bool(k % 2)))
            run, k = _up(run), k // 2
        now, n, at = folded(now), -(-n // RUN), at // RUN
    return out


def verify(data: bytes, path: list[tuple[str, bool]], top: str) -> bool:
    """Whether a proof leads from a leaf's data to the root."""
    h = hashlib.sha256(b"\0" + data).digest()
    for sibling, left in path:
        other = bytes.fromhex(sibling)
        h = hashlib.sha256(b"\1" + (other + h if left else h + other)).digest()
    return h.hex() == top
