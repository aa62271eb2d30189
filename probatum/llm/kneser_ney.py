"""Interpolated modified Kneser-Ney model of any order from two, counted in Spark and memory-mapped by its workers.

1. Words are counted per partition and merged per shard of the hash space. The sorted word hashes are the
   vocabulary file; a word's place in it is its id.
2. Bigrams are pairs of ids in one 64-bit key, counted per partition and merged per shard of a hash of the
   key, so a frequent word, as either half, is spread over all shards. A merged shard writes its sorted keys
   and counts and returns, for the ids it met, how many bigrams of count 1, 2, 3 and more they begin, and how
   many they end; these are merged per id range.
3. Discounts follow Chen and Goodman from counts of counts, per order. Unigrams are continuation counts,
   interpolated with the uniform distribution over the vocabulary and one unknown word.
4. Scorers map the files and look up a batch of sorted keys at a time.

Files live in the shared folder (spark.checkpoint.dir). Where that is a mounted path, workers map it in
place; for another file system the finished files are sent to the workers with SparkContext.addFile. Counted
blocks travel as sorted, byte-transposed, compressed differences. A count takes one byte, and a row of a small
table from 255 up. A finished step's shuffle files are let go before the next one starts.

Defined cases: null texts are empty and hold one token, the end; repeated rows count each time; without
training rows every token has probability 1/(V+1) = 1; further columns aren't read.
"""

from __future__ import annotations

import gc
import os
import zlib
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_at, delete, scratch
from .hashing import mix, slices, word_hashes

END = np.uint64(1)  # no word hash: checked where words are hashed
HELD_OUT = (7, 2)
FLUSH = 1_500_000
SHARD_WORDS = 2_000_000
#: Files that a worker keeps mapped.
MAPS = 4_096


# --- blocks of sorted keys with counts ---------------------------------------------------------------


def _squeeze(a: np.ndarray) -> bytes:
    """Little-endian bytes by plane, so that equal high bytes stand together."""
    return zlib.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), 1)


def _expand(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zlib.decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def pack_block(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    return _squeeze(np.diff(keys, prepend=np.uint64(0))), _squeeze(counts.astype(np.uint64))


def unpack_block(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_expand(keys, np.uint64), dtype=np.uint64), _expand(counts, np.uint64)


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    if counts is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.diff(np.append(first, len(keys))).astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def key_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix(keys) >> np.uint64(17)) % np.uint64(shards)


def top_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards of the hash space in its order."""
    return np.minimum((keys >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24), np.uint64(shards - 1))


def documents_tokens(texts: pa.Array):
    """Token hashes with an end after each document, and the offsets of documents among them."""
    h, at = word_hashes(texts)
    h = np.where(h == END, np.uint64(2), h)
    n = len(at) - 1
    out = np.empty(len(h) + n, np.uint64)
    ends = at[1:] + np.arange(n)
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word] = h
    out[ends] = END
    return out, np.concatenate([[0], ends + 1])


BLOCKS = "shard int, keys binary, counts binary"


def _emit(held: list, shards: int, shard_of):
    keys, counts = tally(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])) if len(held) > 1 else held[0]
    for s, at in _by_shard(shard_of(keys, shards).astype(np.int64)):
        k, c = pack_block(keys[at], counts[at])
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([k], pa.binary()), pa.array([c], pa.binary())], ["shard", "keys", "counts"])


def _counting(shards: int, shard_of, keys_of):
    """Counts of keys_of(texts) in a partition, sent in blocks of one shard each."""

    def run(batches):
        held, n = [], 0
        look = keys_of()
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                keys = look(batch.column("text"))
                if len(keys):
                    held.append(tally(keys))
                    n += len(held[-1][0])
                if n >= FLUSH:
                    yield from _emit(held, shards, shard_of)
                    held, n = [], 0
        if held:
            yield from _emit(held, shards, shard_of)

    return run


def _merged(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    parts = [unpack_block(k, c) for k, c in zip(pdf["keys"], pdf["counts"], strict=True)]
    while len(parts) > 1:  # pairwise, so that memory stays near twice the shard
        parts = [tally(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])) for a, b in zip(parts[::2], parts[1::2], strict=False)] + (parts[-1:] if len(parts) % 2 else [])
    return parts[0]


# --- files -------------------------------------------------------------------------------------------


def _local(path: str) -> str | None:
    """The path for open(), if the shared folder is mounted."""
    return path.removeprefix("file://").removeprefix("file:") if path.startswith("file:") else None


def _named(spark: SparkSession, path: str) -> str:
    """A path without a scheme lies in the default file system, which is mounted only if that is the machines' own."""
    default = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(spark.sparkContext._jsc.hadoopConfiguration())
    return f"file:{path}" if path.startswith("/") and default.getScheme() == "file" else path


@dataclass
class Files:
    """A folder of numpy files; workers see it in place, or as the copy that addFile has sent them."""

    path: str
    sent: str = ""

    def at(self, name: str) -> str:
        return f"{_local(self.path) or SparkFiles.get(self.sent)}/{name}"

    def map(self, name: str, dtype) -> np.ndarray:
        full = self.at(name)
        return np.memmap(full, dtype, "r") if os.path.getsize(full) else np.zeros(0, dtype)

    def counts(self, name: str, at: np.ndarray | slice = slice(None), held: Maps | None = None) -> np.ndarray:
        """Counts at some places of a file of put_counts()."""
        look = held.get if held is not None else self.map
        if _local(self.path) is None:
            return look(name, np.uint32)[at].astype(np.int64)
        c = look(name, np.uint8)[at].astype(np.int64)
        full = np.flatnonzero(c == FULL)
        if len(full):
            more = look(f"{name}-more", np.int64).reshape(-1, 2)
            place = np.arange(len(c)) if isinstance(at, slice) else at
            c[full] = np.append(more[:, 1], FULL)[np.searchsorted(more[:, 0], place[full])]  # a task that runs again may meet a half-written pair
        return c

    def publish(self, spark: SparkSession) -> None:
        """Only for shared folders that aren't mounted."""
        if _local(self.path) is None:
            self.sent = self.path.rsplit("/", 1)[1]
            spark.sparkContext.addFile(self.path, recursive=True)


class Maps:
    """Files mapped when first needed; the least recently used are let go beyond MAPS."""

    def __init__(self, files: Files):
        self.files, self.open = files, OrderedDict()

    def get(self, name: str, dtype) -> np.ndarray:
        if name in self.open:
            self.open.move_to_end(name)
        else:
            self.open[name] = self.files.map(name, dtype)
            if len(self.open) > MAPS:
                self.open.popitem(last=False)
        return self.open[name]


def _by_shard(of: np.ndarray):
    """(shard, places) for each shard that occurs, after one sort."""
    if len(of) and int(of.max()) < 1 << 16:
        of = of.astype(np.uint16)  # sorted by radix
    order = np.argsort(of, kind="stable")
    sorted_of = of[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_of[1:] != sorted_of[:-1]])) if len(of) else np.zeros(0, np.int64)
    for s, a, b in zip(sorted_of[first].tolist(), first.tolist(), np.append(first, len(order))[1:].tolist(), strict=True):
        yield s, order[a:b]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the place of each key among them: only what a hash table has told apart is sorted."""
    codes, u = pd.factorize(keys)
    order = np.argsort(u)
    rank = np.empty(len(u), np.int64)
    rank[order] = np.arange(len(u))
    return u[order], rank[codes]


def _let_go(spark: SparkSession) -> None:
    """Shuffle files of frames that nothing refers to are deleted once both sides have collected them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: A count of one byte that stands in the table of larger ones.
FULL = 255


def put_counts(folder: str, name: str, counts: np.ndarray) -> None:
    large = np.flatnonzero(counts >= FULL)
    _put(folder, f"{name}-more", np.stack([large, counts[large].astype(np.int64)], 1))
    _put(folder, name, np.minimum(counts, FULL).astype(np.uint8))


def _put(folder: str, name: str, array: np.ndarray) -> None:
    """Under its name only when complete: a task that runs again, or beside another, writes the same file."""
    part = f"{folder}/.{name}-{os.urandom(6).hex()}"
    array.tofile(part)
    os.replace(part, f"{folder}/{name}")


def _save(spark: SparkSession, blobs: DataFrame, files: Files, sizes: dict[str, int], offsets: dict[tuple[str, int], int]) -> None:
    """Rows (name, part, body) become parts of files of known sizes; what no part covers is zero.

    Where the folder is mounted, tasks write their own part in place, and a task that runs again writes the
    same bytes; else the driver passes the parts on one by one, in order.
    """
    folder = _local(files.path)
    if folder is not None:
        os.makedirs(folder, exist_ok=True)
        for name, size in sizes.items():
            with open(f"{folder}/{name}", "wb") as f:
                f.truncate(size)

        def put(rows):
            for r in rows:
                with open(f"{folder}/{r.name}", "r+b") as f:
                    f.seek(offsets[r.name, r.part])
                    f.write(r.body)

        blobs.foreachPartition(put)
        return
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(files.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name, size in sizes.items():
        out, at = fs.create(jvm.org.apache.hadoop.fs.Path(f"{files.path}/{name}")), 0
        for r in blobs.where(F.col("name") == name).orderBy("part").toLocalIterator():
            for body in (bytearray(offsets[name, r.part] - at), r.body):
                out.write(bytearray(body))
            at = offsets[name, r.part] + len(r.body)
        out.write(bytearray(size - at))
        out.close()


# --- the model ---------------------------------------------------------------------------------------


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from counts of counts n1..n4; halves of the full range where a count is missing."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)]


@dataclass
class Model:
    files: Files
    shards: int
    v: int  # distinct tokens
    n: int  # tokens
    starts: int  # documents
    bounds: list  # where shards begin among the bigrams, and their number
    d2: list
    d1: list
    unigram_rest: float
    #: (bounds, discounts) of orders two and up; empty for a model of order two.
    levels: tuple = ()

    @property
    def bigrams(self) -> int:
        return self.bounds[-1]

    def open(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """The mapped arrays of a model and its probabilities."""

    def __init__(self, m: Model):
        self.m, f = m, m.files
        self.words = f.map("words", np.uint64)
        self.counts = f.map("counts", np.uint64)
        stats = f.map("stats", np.int64).reshape(-1, 4)  # begun with count 1, 2, 3+; ended
        self.begun, self.ended = stats[:, :3], stats[:, 3]
        self.maps = Maps(f)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of known tokens; V + 1 for unknown ones."""
        v = self.m.v
        if not v:
            return np.full(len(hashes), 1, np.int64)
        codes, u = pd.factorize(hashes)  # by a hash table: words repeat so often that sorting them all costs more than looking them up
        order = np.argsort(u)
        at = np.empty(len(u), np.int64)
        at[order] = np.minimum(np.searchsorted(self.words, u[order]), v - 1)
        return np.where(self.words[at] == u, at, v + 1)[codes]

    def unigram(self, ids: np.ndarray) -> np.ndarray:
        m = self.m
        if not m.bigrams:
            return np.full(len(ids), 1 / (m.v + 1))
        e = np.where(ids < m.v, self.ended[np.minimum(ids, m.v - 1)], 0)
        d = np.array([0.0, *m.d1])[np.minimum(e, 3)]
        return np.maximum(e - d, 0) / m.bigrams + m.unigram_rest / (m.v + 1)

    def bigram(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """P(right | left); V is the start of a document, V + 1 an unknown word."""
        m, low = self.m, self.unigram(right)
        known = (left <= m.v) & (m.bigrams > 0)
        total = np.where(left < m.v, self.counts[np.minimum(left, max(m.v - 1, 0))], m.starts).astype(np.float64) if m.v else np.ones(len(left))
        b = self.begun[np.minimum(left, m.v)].astype(np.float64) if m.v else np.zeros((len(left), 3))
        known &= b.sum(1) > 0
        gamma = b @ np.array(m.d2)
        c = np.zeros(len(left))
        pair = known & (right < m.v)
        u, back = np.unique(left[pair].astype(np.uint64) << np.uint64(32) | right[pair].astype(np.uint64), return_inverse=True)
        got = np.zeros(len(u))
        for s, at in _by_shard(key_shard(u, m.shards)):
            if m.bounds[s + 1] > m.bounds[s]:
                keys = self.maps.get(f"keys-{s}", np.uint64)
                k = np.minimum(np.searchsorted(keys, u[at]), len(keys) - 1)
                hit = keys[k] == u[at]
                got[at[hit]] = m.files.counts(f"times-{s}", k[hit], self.maps)
        c[pair] = got[back]
        d = np.array([0.0, *m.d2])[np.minimum(c, 3).astype(np.int64)]
        total = np.maximum(total, 1)
        return np.where(known, np.maximum(c - d, 0) / total + gamma / total * low, low)


# --- orders above two --------------------------------------------------------------------------------


class Level:
    """The n-grams of one order: keys (place of the n-gram without its last word, last word's id) by shard."""

    def __init__(self, files: Files, order: int, bounds: list):
        self.bounds, self.name, self.maps = np.array(bounds), "keys" if order == 2 else f"keys{order}", Maps(files)

    def keys(self, s: int) -> np.ndarray:
        return self.maps.get(f"{self.name}-{s}", np.uint64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of n-grams; -1 for unknown ones."""
        u, back = distinct(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64))
        got = np.full(len(u), -1, np.int64)
        for s, at, k in self.found(u):
            got[at] = k + self.bounds[s]
        return got[back]

    def found(self, u: np.ndarray):
        """(shard, places in u, places in the shard) of those of some sorted keys that are n-grams."""
        for s, at in _by_shard(key_shard(u, len(self.bounds) - 1)):
            if self.bounds[s + 1] > self.bounds[s]:
                keys, here = self.keys(s), u[at]
                k = np.minimum(np.searchsorted(keys, here), len(keys) - 1)
                hit = keys[k] == here
                yield s, at[hit], k[hit]

    def key(self, places: np.ndarray) -> np.ndarray:
        out, of = np.zeros(len(places), np.uint64), np.searchsorted(self.bounds, places, "right") - 1
        for s, at in _by_shard(of):
            out[at] = self.keys(s)[places[at] - self.bounds[s]]
        return out


def suffixes(levels: dict[int, Level], order: int, keys: np.ndarray) -> np.ndarray:
    """Places of n-grams without their first word, one order below; of bigrams, the last word."""
    word = keys & np.uint64(0xFFFFFFFF)
    if order == 2:
        return word.astype(np.int64)
    u, back = np.unique((keys >> np.uint64(32)).astype(np.int64), return_inverse=True)
    return levels[order - 1].find(suffixes(levels, order - 1, levels[order - 1].key(u))[back], word)


def places(levels: dict[int, Level], ids: np.ndarray, at: np.ndarray, v: int):
    """(order, context, place) of the n-gram that ends at each token, from order two up; -1 where there is none.

    The start of a document counts as one word; nothing stands before it.
    """
    context = np.concatenate([[v], ids[:-1]]) if len(ids) else ids.copy()
    context[at[:-1]] = v
    for order, level in levels.items():
        place = np.full(len(ids), -1, np.int64)
        known = (context >= 0) & (context != v + 1) & (ids < v) if order == 2 else (context >= 0) & (ids < v)
        place[known] = level.find(context[known], ids[known])
        yield order, context, place
        context = np.concatenate([[-1], place[:-1]]) if len(ids) else ids.copy()
        context[at[:-1]] = -1


def _ranges(n: int, shards: int) -> list[int]:
    return [-(-t * n // shards) for t in range(shards + 1)]


def _by_range(k: np.ndarray, c: np.ndarray, n: int, shards: int, shift: int = 0):
    of = (k >> np.uint64(shift)) * np.uint64(shards) // np.uint64(n)
    return [("range", int(t), 0, *pack_block(k[of == t], c[of == t]), None) for t in np.unique(of)]


#: In a context's byte: its row is in the table of those with more than 7 n-grams of count 1, 3 of count 2 or any of 3.
MORE = 255
ROWS = ["name", "part", "n", "keys", "counts", "coc"]
ROWS_TYPE = "name string, part int, n long, keys binary, counts binary, coc array<long>"


def extend(text: DataFrame, m: Model, order: int) -> Model:
    """A model of a higher order over the same texts.

    Each order's n-grams are counted by the place of their context in the order below. Orders below the highest
    take how many words stand before an n-gram in place of its count; nothing stands before one that begins a
    document, so it keeps its count.
    """
    spark, files, shards, folder = text.sparkSession, m.files, m.shards, _local(m.files.path)
    if folder is None:
        raise ValueError("orders above two need a mounted shared folder")
    bounds = {2: m.bounds}
    if not m.bounds[-1]:
        return m
    for k in range(3, order + 1):
        if bounds[k - 1][-1] >= 1 << 32:
            raise ValueError(f"more than 2**32 {k - 1}-grams: a half of a key holds 32 bits")
        known = dict(bounds)

        def grams():
            levels = {j: Level(files, j, b) for j, b in known.items()}
            words = Scorer.__new__(Scorer)
            words.words, words.m = files.map("words", np.uint64), m

            def look(texts):
                h, at = documents_tokens(texts)
                ids = words.ids(h)
                for _, _, last in places(levels, ids, at, m.v):
                    pass
                context = np.concatenate([[-1], last[:-1]]) if len(ids) else ids.copy()
                context[at[:-1]] = -1
                here = context >= 0
                return context[here].astype(np.uint64) << np.uint64(32) | ids[here].astype(np.uint64)

            return look

        def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
            keys, counts = _merged(pdf)
            _put(folder, f"keys{k}-{key[0]}", keys)
            put_counts(folder, f"times{k}-{key[0]}", counts)
            coc = np.bincount(np.minimum(counts, np.uint64(5)).astype(np.int64), minlength=6).tolist()
            found, c = tally(suffixes({j: Level(files, j, b) for j, b in known.items()}, k, keys).astype(np.uint64))
            return pd.DataFrame([("keys", key[0], len(keys), b"", b"", coc), *_by_range(found, c, known[k - 1][-1], shards)], columns=ROWS)

        merged, path = cut_at(text.mapInArrow(_counting(shards, key_shard, grams), BLOCKS).groupBy("shard").applyInPandas(merge, ROWS_TYPE), f"grams{k}")
        n = {r.part: r.n for r in merged.where("name = 'keys'").select("part", "n").collect()}  # a row for each shard
        bounds[k] = [0]
        for s in range(shards):
            bounds[k].append(bounds[k][-1] + n.get(s, 0))
        low = _ranges(bounds[k - 1][-1], shards)

        def before(key, pdf: pd.DataFrame) -> pd.DataFrame:
            keys, counts = _merged(pdf)
            out = np.zeros(low[key[0] + 1] - low[key[0]], np.uint32)
            out[keys.astype(np.int64) - low[key[0]]] = counts
            return pd.DataFrame([("before", key[0], out.tobytes())], columns=["name", "part", "body"])

        bodies = merged.where("name = 'range'").groupBy("part").applyInPandas(before, "name string, part int, body binary")
        _save(spark, bodies.withColumn("name", F.lit(f"before{k - 1}")), files, {f"before{k - 1}": 4 * bounds[k - 1][-1]}, {(f"before{k - 1}", t): 4 * low[t] for t in range(shards)})
        del merged, bodies
        delete(spark, path)
        _let_go(spark)

    levels = []
    for k in range(2, order + 1):
        contexts = m.v + 1 if k == 2 else bounds[k - 1][-1]
        low = _ranges(contexts, shards)

        def sums(batches):
            for pdf in batches:
                for s in pdf["id"].tolist():
                    if bounds[k][s + 1] == bounds[k][s]:
                        continue
                    tail = "" if k == 2 else k
                    keys, c = files.map(f"keys{tail}-{s}", np.uint64), files.counts(f"times{tail}-{s}")
                    if k < order:
                        b = files.map(f"before{k}", np.uint32)[bounds[k][s] : bounds[k][s + 1]]
                        c = np.where(b > 0, b, c)
                        put_counts(folder, f"times{tail}-{s}", c)  # a task that runs again finds and writes the same
                    c = c.astype(np.uint64)
                    left = (keys >> np.uint64(32)) << np.uint64(2)
                    codes = tally(np.concatenate([left | np.minimum(c, np.uint64(3)) - np.uint64(1), left | np.uint64(3)]), np.concatenate([np.ones(len(c), np.uint64), c]))
                    coc = np.bincount(np.minimum(c, np.uint64(5)).astype(np.int64), minlength=6).tolist()
                    yield pd.DataFrame([("coc", s, len(keys), b"", b"", coc), *_by_range(*codes, contexts, shards, 2)], columns=ROWS)

        def merge_sums(key, pdf: pd.DataFrame) -> pd.DataFrame:
            keys, counts = _merged(pdf)
            out = np.zeros((low[key[0] + 1] - low[key[0]], 4), np.uint64)
            out[(keys >> np.uint64(2)).astype(np.int64) - low[key[0]], (keys & np.uint64(3)).astype(np.int64)] = counts
            more = (out[:, 0] > 7) | (out[:, 1] > 3) | (out[:, 2] > 0)
            _put(folder, f"more{k}-{key[0]}", np.flatnonzero(more) + low[key[0]])
            rows = out[more]
            _put(folder, f"rows{k}-{key[0]}", rows.astype(np.uint32) if rows.max(initial=0) < 1 << 32 else rows)
            codes = np.where(more, np.uint64(MORE), out[:, 0] | out[:, 1] << np.uint64(3)).astype(np.uint8)
            return pd.DataFrame([("sums", key[0], codes.tobytes())], columns=["name", "part", "body"])

        counted, path = cut_at(spark.range(0, shards, 1, shards).mapInPandas(sums, ROWS_TYPE), f"sums{k}")
        coc = [sum(x) for x in zip(*[r.coc for r in counted.where("name = 'coc'").select("coc").collect()], strict=True)] or [0] * 6
        bodies = counted.where("name = 'range'").groupBy("part").applyInPandas(merge_sums, "name string, part int, body binary")
        _save(spark, bodies.withColumn("name", F.lit(f"sums{k}")), files, {f"sums{k}": contexts}, {(f"sums{k}", t): low[t] for t in range(shards)})
        del counted, bodies
        delete(spark, path)
        _let_go(spark)
        if k < order:
            os.remove(f"{folder}/before{k}")
        levels.append((bounds[k], discounts(coc[1:5])))
    return Model(files, shards, m.v, m.n, m.starts, m.bounds, m.d2, m.d1, m.unigram_rest, tuple(levels))


class Chain:
    """Probabilities of a model of a higher order: the recursion over all of its orders."""

    def __init__(self, low: Scorer):
        self.low, m = low, low.m
        self.levels = {k: Level(m.files, k, b) for k, (b, _) in enumerate(m.levels, 2)}
        self.sums = {k: m.files.map(f"sums{k}", np.uint8) for k in self.levels}
        self.maps = Maps(m.files)
        self.wide: dict[str, type] = {}

    def begun(self, k: int, contexts: np.ndarray) -> np.ndarray:
        """How many n-grams of count 1, 2, 3 and more contexts begin, and the sum of their counts."""
        code = self.sums[k][contexts].astype(np.int64)
        out = np.stack([code & 7, code >> 3, np.zeros_like(code), (code & 7) + 2 * (code >> 3)], 1).astype(np.float64)
        more = np.flatnonzero(code == MORE)
        of = contexts[more] * self.low.m.shards // max(len(self.sums[k]), 1)
        for t, held in _by_shard(of):
            at = more[held]
            listed = self.maps.get(f"more{k}-{t}", np.int64)
            name = f"rows{k}-{t}"
            if name not in self.wide:  # four sums for each listed context, of 32 bits unless one needs 64
                self.wide[name] = np.uint64 if os.path.getsize(self.low.m.files.at(name)) == 32 * len(listed) else np.uint32
            out[at] = self.maps.get(name, self.wide[name]).reshape(-1, 4)[np.searchsorted(listed, contexts[at])]
        return out

    def probabilities(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Orders from two up, each worked out once for each distinct n-gram of the texts, in the order of its key."""
        m = self.low.m
        p = self.low.unigram(ids)
        context = np.concatenate([[m.v], ids[:-1]]) if len(ids) else ids.copy()
        context[at[:-1]] = m.v
        for k, level in self.levels.items():
            # A context that begins nothing leaves the lower order as it is; a word that isn't known has a key, but none that is found.
            known = np.flatnonzero((context >= 0) & (context < len(self.sums[k])))
            u, back = distinct(context[known].astype(np.uint64) << np.uint64(32) | np.minimum(ids[known], 0xFFFFFFFF).astype(np.uint64))
            left = (u >> np.uint64(32)).astype(np.int64)
            first = np.concatenate([[True], left[1:] != left[:-1]]) if len(u) else np.zeros(0, bool)
            b = self.begun(k, left[first])
            c, place = np.zeros(len(u)), np.full(len(u), -1, np.int64)
            for s, here, there in level.found(u):
                c[here] = m.files.counts(f"times{'' if k == 2 else k}-{s}", there, self.maps)
                place[here] = there + level.bounds[s]
            d = np.array([0.0, *m.levels[k - 2][1]])
            total, of = np.maximum(b[:, 3], 1), np.cumsum(first) - 1
            rest = np.where(b[:, 3] > 0, (b[:, 0] * d[1] + b[:, 1] * d[2] + b[:, 2] * d[3]) / total, 1.0)
            own = np.where(b[of, 3] > 0, np.maximum(c - d[np.minimum(c, 3).astype(np.int64)], 0) / total[of], 0.0)
            p[known] = own[back] + rest[of][back] * p[known]
            if k - 1 < len(m.levels):
                last = np.full(len(ids), -1, np.int64)
                last[known] = place[back]
                context = np.concatenate([[-1], last[:-1]]) if len(ids) else ids.copy()
                context[at[:-1]] = -1
        return p


def training(docs: DataFrame, held=HELD_OUT) -> DataFrame:
    return docs.where(~_held_out(held))


def _held_out(held):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(held[0])) == held[1], F.lit(False))


def train(docs: DataFrame, words_per_shard: int = SHARD_WORDS, order: int = 2) -> Model:
    """Count texts (column text) and write the model's files."""
    if order < 2:
        raise ValueError("an order is at least two")
    spark = docs.sparkSession
    text = docs.select((F.col("text") if "text" in docs.columns else F.lit(None)).cast("string").alias("text"))
    files = Files(_named(spark, scratch(spark, "kn")))
    # The size of a shard follows the input: characters are summed first, which reads but one column.
    chars, n_docs = text.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    shards = max(4, int((chars or 0) // (6 * words_per_shard)) + 1)

    def vocabulary():
        return lambda texts: documents_tokens(texts)[0]

    blocks = text.mapInArrow(_counting(shards, top_shard, vocabulary), BLOCKS)

    def merge_words(key, pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _merged(pdf)
        return pd.DataFrame([(key[0], len(keys), int(counts.sum()), keys.tobytes(), counts.tobytes())], columns=["shard", "n", "total", "keys", "counts"])

    vocab, vocab_path = cut_at(blocks.groupBy("shard").applyInPandas(merge_words, "shard int, n long, total long, keys binary, counts binary"), "vocabulary")
    sizes = {r.shard: (r.n, r.total) for r in vocab.select("shard", "n", "total").collect()}  # a row for each shard
    v, n = sum(x for x, _ in sizes.values()), sum(x for _, x in sizes.values())
    if v >= 1 << 32:
        raise ValueError("more than 2**32 distinct words: two halves of a key hold 32 bits each")
    first, at = {}, 0
    for s in range(shards):
        first["words", s] = first["counts", s] = at * 8
        at += sizes.get(s, (0, 0))[0]
    parts = vocab.select(F.lit("words").alias("name"), F.col("shard").alias("part"), F.col("keys").alias("body")).unionByName(vocab.select(F.lit("counts").alias("name"), F.col("shard").alias("part"), F.col("counts").alias("body")))
    _save(spark, parts, files, {"words": 8 * v, "counts": 8 * v}, first)
    files.publish(spark)
    del blocks, vocab, parts
    delete(spark, vocab_path)
    _let_go(spark)

    def pairs():
        scorer = Scorer.__new__(Scorer)
        scorer.words, scorer.m = files.map("words", np.uint64), Model(files, shards, v, n, 0, [0], [], [], 1.0)

        def look(texts):
            h, at = documents_tokens(texts)
            ids = scorer.ids(h).astype(np.uint64)
            left = np.concatenate([[np.uint64(v)], ids[:-1]]) if len(ids) else ids
            left[at[:-1]] = v
            return left << np.uint64(32) | ids

        return look

    folder = _local(files.path)

    def merge_pairs(key, pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _merged(pdf)
        if folder is None and len(counts) and counts.max() >= 1 << 32:
            raise ValueError("a bigram occurs 2**32 times or more: its count needs a mounted shared folder")
        times = counts.astype(np.uint32) if folder is None else None
        coc = np.bincount(np.minimum(counts, np.uint64(5)).astype(np.int64), minlength=6).tolist()
        if folder is not None:  # a shard's arrays don't pass through the JVM
            _put(folder, f"keys-{key[0]}", keys)
            put_counts(folder, f"times-{key[0]}", counts)
            rows = [("keys", key[0], len(keys), b"", b"", coc)]
        else:
            rows = [("keys", key[0], len(keys), keys.tobytes(), times.tobytes(), coc)]
        # Per id: code 0, 1, 2 for bigrams of count 1, 2, 3+ that it begins, 3 for those that it ends.
        code = (keys >> np.uint64(32)) << np.uint64(2) | np.minimum(counts, np.uint64(3)) - np.uint64(1)
        ended = (keys & np.uint64(0xFFFFFFFF)) << np.uint64(2) | np.uint64(3)
        k, c = tally(np.concatenate([code, ended]))
        of = (k >> np.uint64(2)) * np.uint64(shards) // np.uint64(v + 1)
        for t in np.unique(of):
            here = of == t
            a, b = pack_block(k[here], c[here])
            rows.append(("stats", int(t), len(k), a, b, None))
        return pd.DataFrame(rows, columns=["name", "part", "n", "keys", "counts", "coc"])

    counted = text.mapInArrow(_counting(shards, key_shard, pairs), BLOCKS)
    merged, merged_path = cut_at(counted.groupBy("shard").applyInPandas(merge_pairs, "name string, part int, n long, keys binary, counts binary, coc array<long>"), "bigrams")
    held = {r.part: r for r in merged.where("name = 'keys'").select("part", "n", "coc").collect()}  # a row for each shard
    bounds = [0]
    for s in range(shards):
        bounds.append(bounds[-1] + (held[s].n if s in held else 0))
    coc2 = [sum(r.coc[k] for r in held.values()) for k in range(6)]
    if folder is None:
        for name, body in (("keys", "keys"), ("times", "counts")):
            blobs = merged.where("name = 'keys'").select(F.concat(F.lit(f"{name}-"), "part").alias("name"), F.lit(0).alias("part"), F.col(body).alias("body"))
            width = 8 if name == "keys" else 4
            _save(spark, blobs, files, {f"{name}-{s}": width * r.n for s, r in held.items()}, {(f"{name}-{s}", 0): 0 for s in held})

    low = [-(-t * (v + 1) // shards) for t in range(shards + 1)]  # id ranges

    def merge_stats(key, pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _merged(pdf)
        t = key[0]
        out = np.zeros((low[t + 1] - low[t], 4), np.int64)
        out[(keys >> np.uint64(2)).astype(np.int64) - low[t], (keys & np.uint64(3)).astype(np.int64)] = counts
        return pd.DataFrame([(t, out.tobytes(), np.bincount(np.minimum(out[:, 3], 5), minlength=6).tolist())], columns=["part", "body", "coc"])

    stats, stats_path = cut_at(merged.where("name = 'stats'").groupBy("part").applyInPandas(merge_stats, "part int, body binary, coc array<long>"), "stats")
    _save(spark, stats.select(F.lit("stats").alias("name"), "part", "body"), files, {"stats": 32 * (v + 1)}, {("stats", t): 32 * low[t] for t in range(shards)})
    coc1 = [sum(x) for x in zip(*[r.coc for r in stats.select("coc").collect()], strict=True)] or [0] * 6
    files.publish(spark)
    del counted, merged, stats
    delete(spark, merged_path)
    delete(spark, stats_path)
    _let_go(spark)
    d1 = discounts(coc1[1:5])
    rest = sum(d * x for d, x in zip(d1, (coc1[1], coc1[2], sum(coc1[3:])), strict=True)) / bounds[-1] if bounds[-1] else 1.0
    model = Model(files, shards, v, n, n_docs, bounds, discounts(coc2[1:5]), d1, rest)
    return extend(text, model, order) if order > 2 else model


def score(docs: DataFrame, model: Model, held=HELD_OUT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every document."""
    kind = dict(docs.dtypes)["doc_id"]
    slim = docs.select("doc_id", _held_out(held).alias("held_out"), (F.col("text") if "text" in docs.columns else F.lit(None)).cast("string").alias("text"))

    def run(batches):
        s = model.open()
        chain = Chain(s) if model.levels else None
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                h, at = documents_tokens(batch.column("text"))
                ids = s.ids(h)
                left = np.concatenate([[model.v], ids[:-1]]) if len(ids) else ids
                left[at[:-1]] = model.v
                c = np.where(ids < model.v, s.counts[np.minimum(ids, model.v - 1)], 0).astype(np.float64) if model.v else np.zeros(len(ids))
                first = at[:-1]
                base = np.add.reduceat(np.log10((c + 1) / (model.n + model.v + 1)), first)
                full = np.add.reduceat(np.log10(chain.probabilities(ids, at) if chain else s.bigram(left, ids)), first)
                known = np.add.reduceat((c > 0).astype(np.int64), first)
                n = np.diff(at)
                cols = [batch.column("doc_id"), batch.column("held_out"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), model.n, np.int64)), pa.array(base), pa.array(full), pa.array(10 ** (-full / n))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return slim.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def train_and_score(docs: DataFrame, order: int = 2) -> DataFrame:
    return score(docs, train(training(docs), order=order))
