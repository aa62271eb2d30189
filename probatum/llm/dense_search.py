"""Ranked lexical search by dense blocks: term weights of items times impacts of documents, exact in float64.

1. Items are taken in blocks of so many items and terms. All documents are read once for each block:
   terms are hashed within a batch's buffers, looked up among the block's sorted hashes, and counted. What is kept of
   a document is its number of terms and the counts of the items' terms, in the shared folder.
2. Counts give the number of documents with a term, from which follow its whole-number weight, the number of documents and of all terms.
3. A task scores tiles of documents against tiles of items. A tile of items has a compact vocabulary of its own: the terms of its
   items, cut where a sum could reach 2^53. Weights (items x terms) times impacts (terms x documents) is one
   matrix product in float64, whose factors, products and partial sums are all whole numbers below 2^53, hence exact in any order; parts
   are added as 64-bit integers.
4. Of each product, whatever is not below the TOP-th score of its item is merged by (score, doc_id) into the task's best; equal scores
   are all looked at before they are cut. The tasks' best are ranked by two windows, of an item's share of tasks and of an item.

Defined cases: a null text, of a document or an item, has no terms and takes no part; rows of one item_id are one item with the terms of all; a
repeated document is ranked as often as it occurs; documents without doc_id come after others of equal score; a document
of any length is one column of a tile; no documents or no items give an empty result; further columns, whatever their names,
are ignored. Terms are told apart by hashes of 64 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut
from .hashing import buffers, slices, word_hashes

TOP = 10
#: Items of a block, and their terms (16 bytes each on the driver and with every task; their weights are dense tiles of ITEM_TILE items).
ITEMS, PAIRS = 4_096, 262_144
ITEM_TILE, TERM_TILE, DOC_TILE = 64, 4_096, 1_024
#: No sum of whole numbers up to here is rounded; impacts are below so much.
EXACT, IMPACT = 2**53, 1_000_000
#: Every byte that is no letter, digit or part of a character beyond ASCII becomes a space.
_PLAIN = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms in order, A-Z lower-cased, and the offsets of each text among them."""
    data, offsets = buffers(texts)
    plain = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(_PLAIN[data].tobytes())])
    return word_hashes(plain)


def _text(df: DataFrame):
    return (F.col("text").cast("string") if "text" in df.columns else F.lit(None).cast("string")).alias("text")


def _item_terms(batches):
    for batch in batches:
        h, at = term_hashes(batch.column("text"))
        of = np.repeat(np.arange(batch.num_rows), np.diff(at))
        yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(of)), pa.array(h.view(np.int64))], ["item_id", "term"])


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) with terms as hashes, each once."""
    return items.select(F.col("item_id").cast("long").alias("item_id"), _text(items)).mapInArrow(_item_terms, "item_id long, term long").distinct()


def _counted(vocabulary: np.ndarray):
    """Batches of (doc_id, text) -> doc_id, n, places in the vocabulary and their counts; vocabulary: sorted hashes."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                h, at = term_hashes(batch.column("text"))
                of = np.repeat(np.arange(batch.num_rows), np.diff(at))
                place = np.searchsorted(vocabulary, h)
                hit = vocabulary[np.minimum(place, len(vocabulary) - 1)] == h
                pair, tf = np.unique(of[hit] * len(vocabulary) + place[hit], return_counts=True)
                doc, term = pair // len(vocabulary), pair % len(vocabulary)
                ends = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), *lists], ["doc_id", "n", "terms", "tf"])

    return run


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 8 m), with m = 10 + (90 n n_docs) div n_terms; Python's integers where 64 bits could be too few."""
    if len(n) and int(n.max()) * 90 * n_docs >= 2**63:
        m = 10 + np.array([90 * int(x) * n_docs // n_terms for x in n], np.int64)
    else:
        m = 10 + 90 * n * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Tile:
    """Some items, their compact vocabulary and weights, in parts whose sums stay exact."""

    def __init__(self, first: int, item: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: int):
        own = np.unique(term)
        self.first, self.items = first, int(item.max()) + 1 if len(item) else 0
        step = max(1, min(terms, (EXACT - 1) // (IMPACT * max(int(weight[own].max(initial=1)), 1))))
        self.parts = []
        for k in range(0, len(own), step):
            part = own[k : k + step]
            w = np.zeros((self.items, len(part)))
            here = (term >= part[0]) & (term <= part[-1])
            w[item[here], np.searchsorted(part, term[here])] = weight[term[here]]
            self.parts.append((part, w))

    def scores(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
        total = np.zeros((self.items, n_docs), np.int64)
        for part, w in self.parts:
            at = np.minimum(np.searchsorted(part, term), len(part) - 1)
            hit = part[at] == term
            dense = np.zeros((len(part), n_docs))
            dense[at[hit], doc[hit]] = impact[hit]
            total += (w @ dense).astype(np.int64)
        return total


class Best:
    """The first TOP (score, doc_id) of some items, highest score first, then least id, ids that are null last."""

    def __init__(self, items: int, top: int):
        self.top, self.rows, self.low = top, [None] * items, np.zeros(items, np.int64)

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        floor = np.maximum(self.low[first : first + len(scores)], 1)
        if scores.shape[1] > self.top:
            floor = np.maximum(floor, np.partition(scores, -self.top, axis=1)[:, -self.top])
        at, doc = np.nonzero(scores >= floor[:, None])
        for i in np.unique(at):
            d = doc[at == i]
            new = (scores[i, d], null[d], ids[d])
            old = self.rows[first + i]
            s, z, x = new if old is None else [np.concatenate(p) for p in zip(old, new, strict=True)]
            order = np.lexsort((x, z, -s))[: self.top]
            self.rows[first + i] = s[order], z[order], x[order]
            if len(order) == self.top:
                self.low[first + i] = s[order[-1]]


def _ranked(tiles: list[Tile], items: int, n_docs: int, n_terms: int, top: int, doc_tile: int):
    """Batches of (doc_id, n, terms, tf) -> (item, doc_id, score): a task's best of each item."""

    def run(batches):
        best = Best(items, top)
        for whole in batches:
            for k in range(0, whole.num_rows, doc_tile):
                batch = whole.slice(k, doc_tile)
                lists, ids = batch.column("terms"), batch.column("doc_id")
                size = np.diff(lists.offsets.to_numpy())
                doc = np.repeat(np.arange(batch.num_rows), size)
                term, tf = lists.flatten().to_numpy(), batch.column("tf").flatten().to_numpy().astype(np.int64)
                impact = impacts(tf, batch.column("n").to_numpy()[doc], n_docs, n_terms)
                null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
                for tile in tiles:
                    best.add(tile.first, tile.scores(term, doc, impact, batch.num_rows), ids, null)
        for i, rows in enumerate(best.rows):
            if rows is not None:
                s, z, x = rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i, np.int64)), pa.array(x, pa.int64(), mask=z), pa.array(s)], ["item", "doc_id", "score"])

    return run


def _search(docs: DataFrame, ids: list, item: np.ndarray, term: np.ndarray, top: int, tiles: tuple[int, int, int]) -> DataFrame:
    """(item_id, rank, doc_id, score) of one block of items; (item, term): places in ids and hashes, sorted by item."""
    spark = docs.sparkSession
    item_tile, term_tile, doc_tile = tiles
    vocabulary, place = np.unique(term, return_inverse=True)
    counted = cut(docs.mapInArrow(_counted(vocabulary), "doc_id long, n long, terms array<int>, tf array<int>"), "counts")
    n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # a row for each term of the block
        df[r.t] = r.df
    weight = weights(df, n_docs)
    parts = []
    for k in range(0, len(ids), item_tile):
        a, b = np.searchsorted(item, [k, k + item_tile])
        if b > a:
            parts.append(Tile(k, item[a:b] - k, place[a:b], weight, term_tile))
    best = counted.where(F.size("terms") > 0).mapInArrow(_ranked(parts, len(ids), n_docs, max(n_terms, 1), top, doc_tile), "item long, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = best.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(64))).withColumn("r", F.row_number().over(Window.partitionBy("item", "share").orderBy(*order))).where(F.col("r") <= top)
    rows = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    names = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "item long, item_id long")
    return rows.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # a block's items


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = ITEMS, pairs: int = PAIRS, tiles: tuple[int, int, int] = (ITEM_TILE, TERM_TILE, DOC_TILE)) -> DataFrame:
    """item_id, rank, doc_id, score: each item's best documents with a score above 0.

    Items are dealt by hash into blocks of so many items, and pairs of item and term, on average.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text(docs))
    every = cut(item_terms(items), "items")
    n_pairs, n_items = every.agg(F.count("*"), F.count_distinct(F.struct("item_id"))).first()
    blocks = max(1, -(-n_items // block), -(-n_pairs // pairs))
    out = None
    for k in range(blocks):
        rows = every.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).toArrow()  # a block
        ids = sorted(rows.column("item_id").unique().to_pylist(), key=lambda x: (x is None, x))
        if not ids:
            continue
        at = {x: i for i, x in enumerate(ids)}
        item = np.array([at[x] for x in rows.column("item_id").to_pylist()], np.int64)
        order = np.argsort(item, kind="stable")
        found = _search(slim, ids, item[order], rows.column("term").to_numpy().view(np.uint64)[order], top, tiles)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
