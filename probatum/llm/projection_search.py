"""Nearest neighbours by low-dimensional stable projections, kd-trees and a chi-square stopping test.

Largest inner product is made least distance by one more coordinate: with M the largest norm, x gets
sqrt(M^2 - |x|^2) and a query 0, so distance^2 = |q|^2 + M^2 - 2 q.x. Norms are dealt into bands of a factor
of two with an M each, so that one long vector doesn't drown all distances. Vectors are projected on M_DIMS
Gaussian directions: a pair's squared projected distance over its squared distance follows chi-square with
M_DIMS degrees of freedom.

1. Every row is indexed. A kd-tree over the projections of a bounded sample (SAMPLE rows) cuts space into
   regions; a region with more than SHARD rows is dealt into shards by hash. Each shard's kd-tree is built once and
   written to the shared folder with the bounds of its projections. Of equal vectors, the k+1 rows with the least ids are
   indexed, as no more of them can be among k nearest.
2. A query first visits the shard that promises most. There it takes projected neighbours in the order of their
   distance r, verifies each in double precision, and stops once chi2_cdf(r^2 / d_k^2) >= CONFIDENCE, d_k being its
   k-th distance so far: an unseen vector nearer than d_k would lie beyond r with at most 1 - CONFIDENCE
   probability. The first LEAST neighbours are taken untested, as d_k means little before.
3. With what it has found, the same test on the bounds of the other shards tells which ones it visits too, in the same way.

Queries that meet at a shard are dealt into blocks: a task holds one shard and one block whatever the table's size.

Defined cases: null, zero, null-holding or non-finite vectors take no part, as query or candidate; vectors
of different lengths never meet; rows with a null vec_id take no part; rows that share a vec_id are candidates and queries
one by one, and only a query's own row isn't its candidate; fewer than k candidates give all; an empty table
gives an empty result.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

M_DIMS = 16
CONFIDENCE = 0.95
LEAST = 512
LEAF = 64
SHARD = 16_384
BLOCK = 1_024
#: Rows that regions are fitted on.
SAMPLE = 20_000
#: Neighbours verified between two looks at the test (or an eighth of those before), and leaves opened at first.
STEP = 64
OPEN = 8


def chi2_cdf(x: np.ndarray, m: int = M_DIMS) -> np.ndarray:
    """Of an even number of degrees of freedom: 1 - exp(-x/2) * sum of (x/2)^i / i! below m/2."""
    h = np.minimum(x, 1e3) / 2
    term, total = np.ones_like(h), np.ones_like(h)
    for i in range(1, m // 2):
        term = term * h / i
        total = total + term
    return 1 - np.exp(-h) * total


def stop_ratio(confidence: float, m: int = M_DIMS) -> float:
    """The r^2 / d_k^2 from which chi2_cdf is at least confidence."""
    low, high = 0.0, 1e3
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(np.array([mid]), m)[0] < confidence else (low, mid)
    return high


def directions(dims: int, m: int = M_DIMS, seed: int = 11) -> np.ndarray:
    """For vectors of dims components and the one more."""
    return np.random.default_rng(seed).standard_normal((dims + 1, m))


class Regions:
    """A complete kd-tree of a depth over sampled projections; its leaves are the regions."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth if len(points) >= 8 << depth else max(0, int(log2(max(len(points), 8) / 8)))
        self.axis, self.at = np.zeros((1 << self.depth) - 1, np.int64), np.zeros((1 << self.depth) - 1)
        parts = [points]
        for level in range(self.depth):
            halves = []
            for k, part in enumerate(parts):
                node = (1 << level) - 1 + k
                axis = int(np.argmax(part.max(0) - part.min(0))) if len(part) else 0
                mid = float(np.median(part[:, axis])) if len(part) else 0.0
                self.axis[node], self.at[node] = axis, mid
                halves += [part[part[:, axis] < mid], part[part[:, axis] >= mid]]
            parts = halves

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] >= self.at[node])
        return node - ((1 << self.depth) - 1)


class Shard:
    """Rows in the order of a kd-tree's leaves: ids, vectors, projections, where leaves begin, and the largest squared norm."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, points: np.ndarray, top: float, leaf: int = LEAF):
        order, work, begins = np.arange(len(points)), [(0, len(points))], []
        while work:
            a, b = work.pop()
            if b - a <= leaf:
                begins.append(a)
                continue
            part = points[order[a:b]]
            axis = int(np.argmax(part.max(0) - part.min(0)))
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, axis], mid, kind="introselect")]
            work += [(a, a + mid), (a + mid, b)]
        self.ids, self.x, self.points, self.begins, self.top = ids[order], x[order], points[order], np.array(sorted(begins)), top
        self.low, self.high = (f.reduceat(self.points, self.begins) for f in (np.minimum, np.maximum))

    def pack(self) -> bytes:
        head = np.array([len(self.ids), self.x.shape[1], self.points.shape[1], len(self.begins)], np.int64)
        return b"".join(a.tobytes() for a in (head, np.array([self.top]), self.ids, self.x, self.points, self.begins, self.low, self.high))

    @classmethod
    def unpack(cls, body: bytes) -> Shard:
        n, d, m, leaves = np.frombuffer(body, np.int64, 4).tolist()
        s, at = cls.__new__(cls), 32
        for name, kind, shape in (("top", float, (1,)), ("ids", np.int64, (n,)), ("x", float, (n, d)), ("points", float, (n, m)), ("begins", np.int64, (leaves,)), ("low", float, (leaves, m)), ("high", float, (leaves, m))):
            count = int(np.prod(shape))
            setattr(s, name, np.frombuffer(body, kind, count, at).reshape(shape))
            at += 8 * count
        s.top = float(s.top[0])
        return s

    def neighbours(self, point: np.ndarray):
        """(squared projected distances, places) of all rows, nearest first, in pieces; leaves are opened as needed."""
        reach = box_distance(self.low, self.high, point)
        order = np.argsort(reach, kind="stable")
        ends = np.append(self.begins[1:], len(self.ids))
        opened, more, far, rest = 0, OPEN, np.zeros(0), np.zeros(0, np.int64)
        while opened < len(order) or len(rest):
            new = order[opened : opened + more]
            opened, more = opened + len(new), more * 2
            sizes = ends[new] - self.begins[new]
            fresh = np.arange(sizes.sum()) + np.repeat(self.begins[new] - np.cumsum(sizes) + sizes, sizes)
            off = self.points.take(fresh, 0) - point
            at, r2 = np.concatenate([rest, fresh]), np.concatenate([far, np.einsum("ij,ij->i", off, off)])
            sure = r2 < reach[order[opened]] if opened < len(order) else np.ones(len(r2), bool)
            turn = np.argsort(r2[sure])
            yield r2[sure][turn], at[sure][turn]
            far, rest = r2[~sure], at[~sure]


def box_distance(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Least squared distances from a point to boxes."""
    return (np.maximum(np.maximum(low - point, point - high), 0) ** 2).sum(1)


def search(shard: Shard, name: int, q: np.ndarray, point: np.ndarray, k: int, known: np.ndarray, least: int, ratio: float):
    """(ids, inner products, verified) of rows other than the query's own that are among the k best, beside known inner products."""
    own = np.flatnonzero(shard.ids == name)
    own = next(iter(own[(shard.x[own] == q).all(1)]), -1)
    q2 = float(q @ q)
    slack = 1e-12 * (q2 + shard.top)
    found, score, verified, done = np.full(len(known), -1), known, 0, False
    kth = float(known.min()) if len(known) >= k else -np.inf
    for r2, at in shard.neighbours(point):
        a = 0
        while a < len(at) and not done:
            stop = ratio * max(q2 + shard.top - 2 * kth, 0) + 1e3 * slack
            b = int(np.searchsorted(r2, stop)) if np.isfinite(stop) else len(at)
            b = min(max(b, a + least - verified), a + max(STEP, verified // 8), len(at))
            if b <= a:
                done = True
                break
            s = shard.x.take(at[a:b], 0) @ q
            verified += b - a
            good = (s >= kth - slack) & (at[a:b] != own)
            if good.any():
                found, score = np.concatenate([found, at[a:b][good]]), np.concatenate([score, s[good]])
                if len(score) >= k:
                    kth = max(kth, float(np.partition(score, len(score) - k)[len(score) - k]))
                    good = score >= kth - slack
                    found, score = found[good], score[good]
            a = b
        if done:
            break
    found = found[found >= 0]
    exact = np.zeros(len(found))
    for d in range(len(q)):  # left to right, as a plain loop adds
        exact += q[d] * shard.x[found, d]
    return shard.ids[found], exact, verified


FOUND = "q long, query_id long, vec_id long, score double, verified long"


def _visit(pairs: DataFrame, index: DataFrame, k: int, least: int, ratio: float, block: int) -> DataFrame:
    """FOUND rows of (q, id, v, point, known, shard): k neighbours at most, and a row without vec_id that counts the verified."""
    sizes = pairs.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    held = F.broadcast(sizes)  # a row for each shard
    asks = pairs.join(held, "shard").withColumn("block", F.pmod(F.xxhash64("q"), "blocks").cast("int")).drop("blocks").withColumnsRenamed({"shard": "a_shard", "block": "a_block"})
    bodies = index.select("shard", "body").join(held, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        shard = Shard.unpack(left["body"].iloc[0]) if len(left) and len(right) else None
        for r in right.itertuples() if shard else ():
            ids, score, verified = search(shard, r.id, np.asarray(r.v, float), np.asarray(r.point, float), k, np.asarray(r.known, float), least, ratio)
            order = np.lexsort((ids, -score))[:k]
            rows += zip([r.q] * len(order), [r.id] * len(order), ids[order].tolist(), score[order].tolist(), [0] * len(order), strict=True)
            rows.append((r.q, r.id, None, None, verified))
        got = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pd.DataFrame({c: pd.array(v, t) for c, v, t in zip(("q", "query_id", "vec_id", "score", "verified"), got, ("Int64", "Int64", "Int64", "Float64", "Int64"), strict=True)})

    return bodies.groupBy("shard", "block").cogroup(asks.groupBy("a_shard", "a_block")).applyInPandas(meet, FOUND)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_column: str = "vec_id", column: str = "embedding", shard: int = SHARD, block: int = BLOCK, confidence: float = CONFIDENCE, least: int = LEAST, m: int = M_DIMS) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each row whose id is divisible by every, and how many rows it has verified."""
    spark, ratio = vectors.sparkSession, stop_ratio(confidence, m)
    good = "{0} is not null and size({0}) > 0 and forall({0}, v -> v is not null and v = v and abs(v) < double('Infinity')) and exists({0}, v -> v <> 0)".format(column)
    rows = vectors.where(good).where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.transform(F.col(column).cast("array<double>"), lambda x: x + 0.0).alias("v"))  # + 0.0: no negative zero
    rows = rows.withColumn("dims", F.size("v")).withColumn("h", F.xxhash64("v")).withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b))
    rows = rows.withColumn("band", F.floor(F.log2("norm") / 2 + 0.5).cast("int"))  # unit vectors are amid a band

    # Of equal vectors the least ids, dropped before the shuffle too, so that a common vector isn't gathered.
    nth = F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))
    slim = cut(rows.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth"), "vectors")
    bands = slim.groupBy("dims", "band").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect()  # a row for each vector length and factor of two
    tops = {(r.dims, r.band): r.top * (1 + 1e-12) for r in bands}
    held: dict[int, int] = {}
    for r in bands:
        held[r.dims] = held.get(r.dims, 0) + r.n
    regions = {d: Regions(np.zeros((0, m)), 0) for d in held}
    large = [d for d, n in held.items() if n > shard]
    if large:
        picked: dict[int, list] = {}
        for r in slim.where(F.col("dims").isin(large)).orderBy(F.xxhash64(F.lit(5), "h", "id")).limit(SAMPLE).select("dims", "v").collect():
            picked.setdefault(r.dims, []).append(r.v)
        regions.update({d: Regions(np.array(x) @ directions(d, m)[:-1], ceil(log2(held[d] / shard))) for d, x in picked.items()})

    def project(batches):
        for pdf in batches:
            for (dims, band), part in pdf.groupby(["dims", "band"]):
                g, x = directions(int(dims), m), np.stack(part["v"].to_numpy())
                flat = x @ g[:-1]
                points = flat + np.sqrt(np.maximum(tops[int(dims), int(band)] - part["norm"].to_numpy(), 0))[:, None] * g[-1]
                yield pd.DataFrame({"dims": part["dims"], "band": part["band"], "region": regions[int(dims)].of(flat).astype(np.int32), "id": part["id"], "h": part["h"], "v": part["v"], "point": list(points)})

    placed = cut(slim.mapInPandas(project, "dims int, band int, region int, id long, h long, v array<double>, point array<double>"), "projections")
    table, number = [], 0
    for r in placed.groupBy("dims", "band", "region").agg(F.count("*").alias("n")).collect():  # a row for each region and band
        table.append((r.dims, r.band, r.region, number, ceil(r.n / shard), tops[r.dims, r.band]))
        number += table[-1][4]
    dealt = placed.join(F.broadcast(spark.createDataFrame(table, "dims int, band int, region int, first int, shards int, top double")), ["dims", "band", "region"])
    dealt = dealt.withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("id", "h"), "shards")).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "h"])
        s = Shard(pdf["id"].to_numpy(), np.stack(pdf["v"].to_numpy()), np.stack(pdf["point"].to_numpy()), float(pdf["top"].iloc[0]))
        return pd.DataFrame([(int(pdf["shard"].iloc[0]), s.x.shape[1], s.top, s.low.min(0), s.high.max(0), s.pack())], columns=["shard", "dims", "top", "low", "high", "body"])

    index = cut(dealt.select("shard", "top", "id", "h", "v", "point").groupBy("shard").applyInPandas(build, "shard int, dims int, top double, low array<double>, high array<double>, body binary"), "index")
    boxes = {}  # for each vector length: shards, their largest squared norms and bounds; a row for each shard
    for d, part in index.select("shard", "dims", "top", "low", "high").toPandas().groupby("dims"):
        boxes[int(d)] = (part["shard"].to_numpy(), part["top"].to_numpy(), np.stack(part["low"].to_numpy()), np.stack(part["high"].to_numpy()))

    def home(batches):
        for pdf in batches:
            points, shards = [], []
            for v in pdf["v"]:
                number, top, low, high = boxes[len(v)]
                p = np.asarray(v, float) @ directions(len(v), m)[:-1]
                promise = top - box_distance(low, high, p) / m
                middle = (((low + high) / 2 - p) ** 2).sum(1)
                shards.append(int(number[np.lexsort((middle, -promise))[0]]))
                points.append(p)
            yield pd.DataFrame({"q": pdf["q"], "id": pdf["id"], "v": pdf["v"], "point": points, "known": [[]] * len(points), "shard": np.array(shards, np.int32)})

    def others(batches):
        for pdf in batches:
            keep, shards = [], []
            for i, r in enumerate(pdf.itertuples()):
                number, top, low, high = boxes[len(r.v)]
                q2, kth = float(np.dot(r.v, r.v)), min(r.known) if len(r.known) >= k else -np.inf
                open_ = (number != r.shard) & (q2 * top >= max(kth, 0) ** 2) & (box_distance(low, high, np.asarray(r.point)) <= ratio * np.maximum(q2 + top - 2 * kth, 0) + 1e-9 * (q2 + top))
                keep += [i] * int(open_.sum())
                shards.append(number[open_])
            out = pdf.iloc[keep][["q", "id", "v", "point", "known"]]
            yield out.assign(shard=np.concatenate(shards).astype(np.int32) if shards else np.zeros(0, np.int32))

    pair = "q long, id long, v array<double>, point array<double>, known array<double>, shard int"
    asked = rows.where(F.col("id") % every == 0).select(F.monotonically_increasing_id().alias("q"), "id", "v")
    first = cut(asked.mapInPandas(home, pair), "home")
    near = cut(_visit(first, index, k, least, ratio, block), "nearby")
    scores = near.groupBy(F.col("q").alias("s_q")).agg(F.collect_list("score").alias("scores"))  # k at most
    known = first.join(scores, F.col("q") == F.col("s_q")).select("q", "id", "v", "point", F.col("scores").alias("known"), "shard")
    rest = cut(known.mapInPandas(others, pair), "others")
    found = near.unionByName(_visit(rest, index, k, 0, ratio, block))
    each = Window.partitionBy("q")
    ranked = found.withColumn("rank", F.row_number().over(each.orderBy(F.desc_nulls_last("score"), "vec_id"))).withColumn("verified", F.sum("verified").over(each))
    return ranked.where((F.col("rank") <= k) & F.col("vec_id").isNotNull()).select("query_id", "rank", "vec_id", "score", "verified")
