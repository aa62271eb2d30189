"""N-gram Jaccard self-join by a prefix tree, with exact links.

1. A document's set is its distinct word-shingle hashes (64 bits). Documents with equal sets form a class,
   named by a 128-bit digest; from here on only one document of each class takes part.
2. Where to look: if two sets reach the threshold t, their sizes are within t of each other and they differ
   in at most d = (a+b)(1-t)/(1+t) shingles. Hashes are dealt into d+2 parts by value (for a size class both
   belong to), so at least two parts are equal: each set sends one signature for each part. A part that is
   empty is left out, unless more than one part of the set is. Equal signatures give edges to the least
   class; each partition joins its own copies first, so a hot signature reaches the shuffle once for each
   partition. A passage that many documents share gives no edge, as a whole part must be equal.
   Below t = 0.85 parts hold so few shingles that passages shared by many documents chain them, which costs time
   but no link: candidates="parts" still looks that way. Unless told so, signatures are then 64 bands of 6 min-hashes,
   which miss a pair at 0.8 with a probability of (1 - 0.8^6)^64 < 4e-9.
3. The components of these edges bound the join. A component is dealt into steps of size, of a factor 1/t, and
   a step into blocks by hash, of so many sets and so many shingles. A pair of blocks of the same step or of neighbouring ones
   is one unit of work; sets of other steps can't link. So memory and the longest task follow the
   block and not the component, nor the length of its texts.
4. Shingles have one order, the same in every unit: by how often their bucket of 2^16 occurs among all sets that are joined, most often
   first, then by hash. Buckets are counted once, where the sets lie, and their ranks, a table of fixed size, travel with the
   tasks. The ordered sets of one block form a prefix tree, whose unary chains are single edges; shingles that only one set
   of a unit has match nothing and are left out of it, not of the sizes. The sets of the other block walk
   the tree all at once: a node holds the overlap of its path with each of them, shared by all sets below.
   A set leaves a subtree when overlap + what can still match, bounded by the lengths that remain on both
   sides, can't reach the threshold. What arrives at a leaf is a link, with its exact overlap.
5. Components of the links name the groups.

Defined cases: a null text is empty; an empty set has no links and is its own component; rows with a null
doc_id link with nothing and have a null component; repeated rows are copies of each other; rows that share a doc_id
but not their text are documents of their own, each with the component of its text; an empty table
gives an empty result; further columns, whatever their names, are ignored. Sets are told apart by 128 bits,
components by 64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import connected_components, cut
from .hashing import mix, slices, word_hashes

BLOCK = 128
#: Shingles of a block (on average, and unless one set has more) and counters that walk a tree at once.
SHINGLES = 1 << 22
CELLS = 1 << 24
RATIO = 1.25
#: Classes with links (32 bytes each) that are broadcast.
BROADCAST = 1_000_000
FLUSH = 2_000_000
#: Buckets of shingles whose counts give the order.
BUCKET_BITS = 16
#: Below a threshold of EXACT, parts would hold too few shingles to tell documents apart.
EXACT = 0.85
BANDS, ROWS = 64, 6
_FACTORS = np.random.default_rng(77).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than width make one shingle."""
    h, at = word_hashes(texts)
    rolled = np.zeros(0, np.uint64)
    if len(h) >= width:
        n = len(h) - width + 1
        rolled = h[:n].copy()
        for k in range(1, width):
            rolled = mix(rolled * _A + h[k : k + n] + np.uint64(k))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(rolled[a : b - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            x = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                x = mix(x * _B + h[k])
            out.append(x)
        else:
            out.append(h[:0])
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums over a set, as signed numbers."""
    a = mix(mix(s ^ _B).sum(dtype=np.uint64, keepdims=True) + np.full(1, len(s), np.uint64) * _A)
    b = mix(s * _C + _A).sum(dtype=np.uint64, keepdims=True)
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


class Classes:
    """Size classes in which two sets that reach num/den have a class in common."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.lows = num, den, [1]
        self.ratio = max(RATIO, den / num)

    def low(self, c: int) -> int:
        while len(self.lows) <= c:
            self.lows.append(max(self.lows[-1] + 1, int(np.ceil(self.lows[-1] * self.ratio))))
        return self.lows[c]

    def of(self, n: int) -> list[tuple[int, int]]:
        """(class, differing shingles at most) of each class in which a set of n has partners."""
        c = 0
        while self.low(c + 1) <= n:
            c += 1
        out = []
        while not out or self.num * self.low(c) <= self.den * n:
            most = self.low(c + 1) - 1
            out.append((c, 2 * most * (self.den - self.num) // (self.den + self.num)))
            c += 1
        return [(c, d) for c, d in out if d]  # d = 0: only equal sets


def signatures(s: np.ndarray, classes: Classes) -> np.ndarray:
    out = []
    mixed = mix(s + _C)
    for c, d in classes.of(len(s)):
        parts = np.uint64(d + 2)
        p = (mixed >> np.uint64(20)) % parts
        order = np.argsort(p, kind="stable")
        p, v = p[order], s[order] * _A ^ mixed[order]
        first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        sums = np.add.reduceat(v, first)
        key = np.full(1, c, np.uint64) * _B
        out.append(mix(mix(sums) + p[first] * _C + key))
        if int(parts) - len(first) > 1:
            empty = np.setdiff1d(np.arange(int(parts), dtype=np.uint64), p[first])
            out.append(mix(empty * _A + key + _C))
    return np.concatenate(out) if out else s[:0]


def bands(s: np.ndarray) -> np.ndarray:
    """BANDS signatures of ROWS min-hashes each."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        part = s[at : at + 4096]
        low = np.minimum(low, ((part ^ (part >> np.uint64(29))) * _FACTORS[:, None]).min(1))
    low = mix(low).reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64) * _B
    for k in range(ROWS):
        out = mix(out * _A + low[:, k])
    return out


def _sets(width: int):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(batch.column("text"), width)
                keys = [digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())], ["doc_id", "h", "n_shingles", "d1", "d2"])

    return run


def _stars(sig: np.ndarray, node: np.ndarray):
    """One row (sig, least node) for each signature, and (node, least node) for the other nodes that have it."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    first = np.concatenate([[True], sig[1:] != sig[:-1]])
    least = node[np.flatnonzero(first)][np.cumsum(first) - 1]
    edge = np.unique(np.stack([node[~first], least[~first]], 1), axis=0)
    edge = edge[edge[:, 0] != edge[:, 1]]
    return sig[first], node[first], edge


def _candidates(width: int, num: int, den: int, exact: bool):
    def emit(sig, node):
        s, n, e = _stars(np.concatenate(sig), np.concatenate(node))
        for at in range(0, len(s), 200_000):
            k = slice(at, at + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(s[k]), pa.array(n[k]), pa.nulls(len(s[k]), pa.int64())], ["sig", "node", "other"])
        if len(e):
            # An edge that is known needs no signature; its own is spread evenly and met by nothing.
            yield pa.RecordBatch.from_arrays([pa.array(mix((e[:, 0] ^ e[:, 1] * 3).view(np.uint64)).view(np.int64)), pa.array(e[:, 0]), pa.array(e[:, 1])], ["sig", "node", "other"])

    def run(batches):
        classes, sig, node, held = Classes(num, den), [], [], 0
        for whole in batches:
            for batch in slices(whole, "text"):
                for s in shingle_sets(batch.column("text"), width):
                    if len(got := (signatures(s, classes) if exact else bands(s)) if len(s) else s):
                        sig.append(got.view(np.int64))
                        node.append(np.full(len(got), digest(s)[0], np.int64))
                        held += len(got)
                if held >= FLUSH:
                    yield from emit(sig, node)
                    sig, node, held = [], [], 0
        if held:
            yield from emit(sig, node)

    return run


def _walk(tree: list[np.ndarray], size: np.ndarray, common: np.ndarray, shared: int, probe: list[np.ndarray], size_p: np.ndarray, num: int, den: int):
    """(place in tree, index in probe) of the links of some probes, which walk the tree together; size: of whole sets."""
    member = np.zeros((shared + 1, len(probe)), np.int32)
    for j, r in enumerate(probe):
        member[r, j] = 1
    length = np.array([len(t) for t in tree], np.int64)
    matching = np.array([len(r) for r in probe], np.int64)
    passed = np.cumsum(member, 0, dtype=np.int32)  # of each probe, elements up to a rank
    found_t, found_p = [], []
    work = [(0, len(tree), 0, np.arange(len(probe)), np.zeros(len(probe), np.int64))]
    while work:
        lo, hi, depth, alive, overlap = work.pop()
        deep = int(common[lo + 1 : hi].min()) if hi - lo > 1 else int(length[lo])
        path = tree[lo][depth:deep]
        if len(path):
            overlap = overlap + (member[path][:, alive].sum(0) if len(alive) < len(probe) else member[path].sum(0))
        left_p = matching[alive] - (passed[int(tree[lo][deep - 1]), alive] if deep else 0)
        left_t = int(length[lo:hi].max()) - deep
        least = int(size[lo:hi].min())
        # overlap / (a + b - overlap) >= num / den
        fit = (num + den) * (overlap + np.minimum(left_p, left_t)) >= num * (least + size_p[alive])
        if not fit.all():
            alive, overlap = alive[fit], overlap[fit]
        if not len(alive):
            continue
        if hi - lo == 1:
            found_t.append(np.full(len(alive), lo))
            found_p.append(alive)
            continue
        begin = lo
        for k in [*(lo + 1 + np.flatnonzero(common[lo + 1 : hi] == deep)).tolist(), hi]:
            work.append((begin, k, deep, alive, overlap))
            begin = k
    if not found_t:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_t), np.concatenate(found_p)


def bucket(token: np.ndarray) -> np.ndarray:
    return (token >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def placed(token: np.ndarray, ranks: np.ndarray | None) -> np.ndarray:
    """Indices that bring distinct shingles into the global order; ranks: of the buckets, all equal if None."""
    return np.lexsort((token, ranks[bucket(token)])) if ranks is not None else np.argsort(token, kind="stable")


def tree_join(sets: list[np.ndarray], probes: list[np.ndarray], num: int, den: int, ranks: np.ndarray | None = None):
    """(index in sets, index in probes) of all pairs whose exact Jaccard similarity is at least num/den.

    Overlaps are counted along the paths of a prefix tree over sets; see the module's text.
    """
    everything = np.concatenate([*sets, *probes])
    if not len(sets) or not len(probes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    token, inverse, df = np.unique(everything, return_inverse=True, return_counts=True)
    order = placed(token, ranks)
    order = order[df[order] > 1]  # what one set alone has never matches
    shared = len(order)
    rank = np.full(len(token), shared, np.int64)
    rank[order] = np.arange(shared)
    every, cuts = rank[inverse], np.cumsum([len(s) for s in sets] + [len(p) for p in probes])
    split = [np.sort(r[r < shared]) for r in np.split(every, cuts[:-1])]
    tree, probe = split[: len(sets)], split[len(sets) :]
    keys = [r.astype(">u4").tobytes() for r in tree]
    order = np.array(sorted(range(len(tree)), key=keys.__getitem__), np.int64)
    tree = [tree[i] for i in order]
    size, size_p = np.array([len(sets[i]) for i in order], np.int64), np.array([len(p) for p in probes], np.int64)
    common = [0] * len(tree)
    for k in range(1, len(tree)):
        n = min(len(tree[k - 1]), len(tree[k]))
        differ = np.flatnonzero(tree[k - 1][:n] != tree[k][:n])
        common[k] = int(differ[0]) if len(differ) else n
    common = np.array(common)
    found_t, found_p = [], []
    step = max(1, CELLS // (shared + 1))
    for begin in range(0, len(probe), step):
        t, p = _walk(tree, size, common, shared, probe[begin : begin + step], size_p[begin : begin + step], num, den)
        found_t.append(order[t])
        found_p.append(p + begin)
    return np.concatenate(found_t), np.concatenate(found_p)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n reaches by links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _join_units(num: int, den: int, ranks: np.ndarray):
    """Rows sorted by unit -> (d1, d2, root, links) of each class with links in the unit; root: d1 of a class it reaches."""

    def solve(rows):
        rows.sort(key=lambda r: (r["d1"], r["d2"]))
        bi, bj = rows[0]["bi"], rows[0]["bj"]
        sets = [np.frombuffer(r["body"], np.uint64) for r in rows]
        left = np.array([i for i, r in enumerate(rows) if r["block"] == bi], np.int64)
        right = left if bi == bj else np.array([i for i, r in enumerate(rows) if r["block"] == bj], np.int64)
        t, p = tree_join([sets[i] for i in left], [sets[i] for i in right], num, den, ranks)
        a, b = left[t], right[p]
        a, b = a[a != b], b[a != b]
        if bi != bj:
            a, b = np.concatenate([a, b]), np.concatenate([b, a])
        copies = np.array([r["copies"] for r in rows], np.int64)
        links = np.bincount(a, weights=copies[b], minlength=len(rows)).astype(np.int64)
        root = _roots(len(rows), a, b)
        return [(rows[i]["d1"], rows[i]["d2"], rows[root[i]]["d1"], int(links[i])) for i in np.flatnonzero(links)]

    def out(found):
        cols = list(zip(*found, strict=True)) if found else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["d1", "d2", "root", "links"])

    def run(batches):
        unit, rows, found, seen = None, [], [], set()
        for batch in batches:
            for r in batch.to_pylist():
                key = (r["comp"], r["bi"], r["bj"])
                if key != unit:
                    if rows:
                        found += solve(rows)
                    unit, rows, seen = key, [], set()
                if (r["d1"], r["d2"]) not in seen:  # repeated rows come more than once
                    seen.add((r["d1"], r["d2"]))
                    rows.append(r)
            if len(found) > 10_000:
                yield out(found)
                found = []
        if rows:
            found += solve(rows)
        yield out(found)

    return run


def _bodies(width: int):
    keep = ["comp", "low", "high", "block", "copies", "d1", "d2"]

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                sets = shingle_sets(batch.column("text"), width)
                same = np.array([digest(s) for s in sets], np.int64).reshape(-1, 2)
                d1, d2 = batch.column("d1").to_numpy(), batch.column("d2").to_numpy()
                mask = pa.array((same[:, 0] == d1) & (same[:, 1] == d2))  # else another text of the same doc_id
                rows = pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array([s.tobytes() for s in sets], pa.binary())], [*keep, "body"])
                yield rows.filter(mask)

    return run


def _occurrences(batches):
    """(bucket, n) of a task's sets."""
    n = np.zeros(1 << BUCKET_BITS, np.int64)
    for batch in batches:
        for body in batch.column("body"):
            n += np.bincount(bucket(np.frombuffer(body.as_py(), np.uint64)), minlength=len(n))
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])


def bucket_ranks(bodies: DataFrame) -> np.ndarray:
    """The rank of each bucket of shingles, most frequent first, of equal ones the lower: the same for every unit."""
    n = np.zeros(1 << BUCKET_BITS, np.int64)
    for r in bodies.select("body").mapInArrow(_occurrences, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket
        n[r.bucket] = r.n
    ranks = np.empty(len(n), np.int32)
    ranks[np.argsort(-n, kind="stable")] = np.arange(len(n), dtype=np.int32)
    return ranks


def _members(classes: DataFrame, comps: DataFrame, num: int, den: int, block: int, shingles: int) -> DataFrame:
    """Classes with their component, block, and the first and last block that they have to meet."""
    step = F.floor(F.log(F.col("n_shingles").cast("double")) / float(np.log(den / num) * (1 + 1e-6))) if num < den else F.col("n_shingles")
    members = cut(classes.join(comps, "d1").withColumn("step", step.cast("long")), "members")
    sizes = members.groupBy("comp", "step").agg(F.count("*").alias("of"), F.sum("n_shingles").alias("held"))
    blocks = F.least(F.greatest(F.ceil(F.col("of") / F.lit(block)), F.ceil(F.col("held") / F.lit(shingles))), F.col("of")).cast("int")
    of, order = Window.partitionBy("comp"), Window.partitionBy("comp").orderBy("step")  # a row for each step of size
    sizes = sizes.withColumn("blocks", blocks).withColumn("all", F.sum("of").over(of)).withColumn("begin", F.sum("blocks").over(order) - F.col("blocks"))
    beside = lambda f: F.when(f("step").over(order) - F.col("step") == (1 if f is F.lead else -1), f("blocks").over(order)).otherwise(F.lit(0))
    sizes = sizes.withColumn("low", F.col("begin") - F.coalesce(beside(F.lag), F.lit(0))).withColumn("high", F.col("begin") + F.col("blocks") - 1 + F.coalesce(beside(F.lead), F.lit(0)))
    sizes = sizes.where(F.col("all") > 1).drop("of", "held", "all")
    members = members.join(sizes, ["comp", "step"])
    return members.select("comp", "low", "high", (F.col("begin") + F.pmod(F.xxhash64("d2"), "blocks")).cast("long").alias("block"), "rep", "rep_h", "copies", "d1", "d2")


def _grouped(docs: DataFrame, width: int, num: int, den: int, block: int, shingles: int, candidates: str) -> DataFrame:
    """doc_id, h (a hash of the text), d1, d2, n_shingles, component_id and n_links of every document."""
    text = F.col("text").cast("string") if "text" in docs.columns else F.lit(None).cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    table = cut(slim.mapInArrow(_sets(width), "doc_id long, h long, n_shingles long, d1 long, d2 long"), "sets")
    classes = table.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2", "n_shingles").agg(F.min(F.struct("doc_id", "h")).alias("least"), F.count("*").alias("copies"))
    classes = classes.select("d1", "d2", "n_shingles", F.col("least.doc_id").alias("rep"), F.col("least.h").alias("rep_h"), "copies")

    exact = candidates == "parts" or (candidates == "auto" and num >= EXACT * den)
    found = slim.where("doc_id is not null").select("text").mapInArrow(_candidates(width, num, den, exact), "sig long, node long, other long")
    meet = F.min("node").over(Window.partitionBy("sig"))  # at most one row for each partition and signature
    edges = found.select("node", F.coalesce("other", meet).alias("to")).where(F.col("node") != F.col("to")).select(F.col("node").alias("a"), F.col("to").alias("b"))
    comps = connected_components(edges).select(F.col("node").alias("d1"), F.col("label").alias("comp"))

    members = _members(classes, comps, num, den, block, shingles)
    # Members grow with the documents: a plan that broadcasts them while they are few would change with size.
    bodies = members.hint("merge").join(slim.withColumnsRenamed({"doc_id": "rep", "h": "rep_h"}), ["rep", "rep_h"])
    bodies = bodies.select("comp", "low", "high", "block", "copies", "d1", "d2", "text").mapInArrow(_bodies(width), "comp long, low long, high long, block long, copies long, d1 long, d2 long, body binary")
    bodies = cut(bodies, "bodies")
    ranks = bucket_ranks(bodies)
    units = bodies.withColumn("x", F.explode(F.sequence("low", "high"))).select("comp", F.least("block", "x").alias("bi"), F.greatest("block", "x").alias("bj"), "block", "copies", "d1", "d2", "body")
    units = units.repartition("comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj")
    links = cut(units.mapInArrow(_join_units(num, den, ranks), "d1 long, d2 long, root long, links long"), "links")

    labels = connected_components(links.select(F.col("d1").alias("a"), F.col("root").alias("b")).where("a <> b")).select(F.col("node").alias("d1"), "label")
    linked = classes.join(links.groupBy("d1", "d2").agg(F.sum("links").alias("links")), ["d1", "d2"], "left").join(labels, "d1", "left")
    least = linked.where("label is not null").groupBy(F.col("label").alias("of_label")).agg(F.min("rep").alias("least"))
    named = linked.join(least, F.col("label") == F.col("of_label"), "left").select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), F.coalesce("least", "rep").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")).where("links > 0")
    named = cut(named, "groups")
    if named.count() <= BROADCAST:
        named = F.broadcast(named)  # then no class, however many copies it has, is gathered; beyond, joins split skewed partitions
    same = (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")) & F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    return table.join(named, same, "left").select("doc_id", "h", "d1", "d2", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def similarity_groups(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, block: int = BLOCK, shingles: int = SHINGLES, candidates: str = "auto") -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every document; links are Jaccard >= num/den."""
    return _grouped(docs, width, num, den, block, shingles, candidates).select("doc_id", "n_shingles", "component_id", "n_links")


def keep_first(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, candidates: str = "auto") -> DataFrame:
    """The documents without near duplicates: of each group, those of its least doc_id, each text once.

    Rows with a null doc_id stay, and of rows without words one for each doc_id. A row is known by its doc_id
    and text, so another text under the same doc_id is judged by itself. Of rows that agree in both, or in doc_id and
    shingles, one stays.
    """
    groups = _grouped(docs, width, num, den, BLOCK, SHINGLES, candidates)
    stay = groups.where("component_id = doc_id").groupBy("doc_id", "d1", "d2").agg(F.min("h").alias("s_h")).select(F.col("doc_id").alias("s_id"), "s_h").distinct()
    text = F.col("text").cast("string") if "text" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("r_id"), F.xxhash64(text).alias("r_h"), F.struct(*[F.col(c) for c in docs.columns]).alias("doc"))
    nth = F.row_number().over(Window.partitionBy("r_id", "r_h").orderBy(F.xxhash64("doc")))
    once = rows.where("r_id is not null").withColumn("nth", nth).where("nth = 1")  # before and after the shuffle
    kept = once.join(stay.hint("merge"), (F.col("r_id") == F.col("s_id")) & (F.col("r_h") == F.col("s_h")), "left_semi")
    return kept.select("doc.*").unionByName(rows.where("r_id is null").select("doc.*"))
