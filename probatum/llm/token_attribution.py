"""Token counts of sections by offset mapping: whole documents are encoded once, tokens joined to spans.

1. A document is encoded once, as a whole, by a byte-level vocabulary. The byte lengths of its tokens add up
   to their offsets, which tile the text's UTF-8 bytes exactly.
2. Sections are the text's lines, each with the line break that ends it (sections()), or the spans of a column
   (sections_of()): structs (name, start, end) in code points, which may leave gaps. Of given spans that overlap, what the
   earlier one holds is not the later one's; parts beyond the text are cut off.
3. Both lists are sorted, so the interval join is one binary search per boundary.
4. A token that crosses boundaries goes whole to one section: the one that holds most of its bytes, the
   earlier on a tie ("majority"), or the one that holds its first byte ("start"). A token that lies mostly
   outside every section counts as unassigned.

The vocabulary's path is a parameter and must be readable by the workers.

Defined cases: a null or empty text has no section and gives no row from sections(), given spans of 0 tokens from
sections_of(), and a row with 0 tokens from totals(); spans that are null or lack a bound are none; repeated rows give their sections each; an empty table gives an empty result; special tokens'
strings are ordinary text.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The splitting pattern that belongs to this vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: White space in the pattern's sense (fixed values), so much of it that the pattern's matcher may give up.
_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY):
    """(encoding, byte length of each token)"""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def token_offsets(text: str, path: str = VOCABULARY) -> np.ndarray:
    """Byte offsets of token boundaries, from 0 to the text's length.

    Very long runs of white space are encoded as the single pieces that the pattern makes of them: all but the last
    character before a word, all of it at the end.
    """
    enc, lengths = encoder(path)
    parts, at = [], 0
    for m in _BLANK.finditer(text):
        end = m.end() - (m.end() < len(text))
        parts += [enc.encode_to_numpy(text[at : m.start()], disallowed_special=()), enc._encode_single_piece(text[m.start() : end])]
        at = end
    parts.append(enc.encode_to_numpy(text[at:], disallowed_special=()))
    return np.concatenate([[0], *[lengths[np.asarray(x, np.int64)] for x in parts]]).cumsum()


def allocate(tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray, int]:
    """(tokens of each section, boundary-crossing tokens among them, unassigned tokens).

    tokens: boundaries of tokens; starts, ends: sorted disjoint spans in the same unit.
    """
    a, b, n = tokens[:-1], tokens[1:], len(starts)
    if not n or not len(a):
        return np.zeros(n, np.int64), np.zeros(n, np.int64), len(a)
    first = np.searchsorted(ends, a, "right")  # the first section that ends after the token's start
    held = first < n
    inside = held & (starts[np.minimum(first, n - 1)] <= a) & (b <= ends[np.minimum(first, n - 1)])
    counts = np.bincount(first[inside], minlength=n)
    crossing, loose = np.zeros(n, np.int64), 0
    for t in np.flatnonzero(~inside):
        lo, hi, best, most, covered = int(a[t]), int(b[t]), -1, 0, 0
        k = int(first[t])
        if rule == "start":
            best = k if k < n and starts[k] <= lo else -1
        else:
            while k < n and starts[k] < hi:
                part = min(hi, int(ends[k])) - max(lo, int(starts[k]))
                covered += part
                if part > most:
                    best, most = k, part
                k += 1
            if hi - lo - covered > most:
                best = -1
        if best < 0:
            loose += 1
        else:
            crossing[best] += 1
    return counts + crossing, crossing, loose


def line_sections(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of lines, each with its line break."""
    ends = np.flatnonzero(raw == 10) + 1
    if len(raw) and (not len(ends) or ends[-1] != len(raw)):
        ends = np.append(ends, len(raw))
    return np.concatenate([[0], ends[:-1]]) if len(ends) else ends, ends


def sections(docs: DataFrame, path: str = VOCABULARY, rule: str = "majority") -> DataFrame:
    """doc_id, section, start and end (code points), n_tokens, n_crossing and the document's doc_tokens for each line."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                rows, cols = [], [[] for _ in range(6)]
                for i, text in enumerate(batch.column("text").to_pylist()):
                    if not text:
                        continue
                    raw = np.frombuffer(text.encode(), np.uint8)
                    tokens = token_offsets(text, path)
                    starts, ends = line_sections(raw)
                    n, crossing, _ = allocate(tokens, starts, ends, rule)
                    # From bytes to code points.
                    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)]) if len(raw) != len(text) else None
                    at = (lambda x, p=points: x) if points is None else (lambda x, p=points: p[x])
                    rows.append(np.full(len(n), i))
                    for c, v in zip(cols, (np.arange(len(n)), at(starts), at(ends), n, crossing, np.full(len(n), len(tokens) - 1)), strict=True):
                        c.append(v)
                if rows:
                    ids = batch.column("doc_id").take(pa.array(np.concatenate(rows)))
                    yield pa.RecordBatch.from_arrays([ids, *[pa.array(np.concatenate(c), pa.int64()) for c in cols]], ["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])

    slim = docs.select("doc_id", (F.col("text") if "text" in docs.columns else F.lit(None)).cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, section long, start long, end long, n_tokens long, n_crossing long, doc_tokens long")


def sections_of(docs: DataFrame, spans: str, path: str = VOCABULARY, rule: str = "majority") -> DataFrame:
    """doc_id, name, start, end, n_tokens, n_crossing and doc_tokens of given spans; unassigned tokens under a null name, if any."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                out = []
                for i, (text, given) in enumerate(zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)):
                    text = text or ""
                    tokens = token_offsets(text, path) if text else np.zeros(1, np.int64)
                    sizes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                    bytes_at = np.concatenate([[0], np.cumsum(1 + (sizes > 0x7F) + (sizes > 0x7FF) + (sizes > 0xFFFF))])
                    named, end = [], 0
                    for s in sorted((s for s in given or [] if s and None not in (s["start"], s["end"])), key=lambda s: (s["start"], s["end"])):
                        a, b = (min(max(x, 0), len(text)) for x in (s["start"], s["end"]))
                        named.append((s["name"], a, b, bytes_at[max(a, end)], bytes_at[max(b, a, end)]))
                        end = max(b, end)
                    starts, ends = (np.array([x[k] for x in named], np.int64) for k in (3, 4))
                    live = np.flatnonzero(ends > starts)
                    n, crossing = np.zeros(len(named), np.int64), np.zeros(len(named), np.int64)
                    n[live], crossing[live], loose = allocate(tokens, starts[live], ends[live], rule)
                    out += [(i, name, a, b, int(n[k]), int(crossing[k]), len(tokens) - 1) for k, (name, a, b, _, _) in enumerate(named)]
                    if loose:
                        out.append((i, None, None, None, loose, 0, len(tokens) - 1))
                if out:
                    rows, names, *numbers = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array(names, pa.string()), *[pa.array(c, pa.int64()) for c in numbers]], ["doc_id", "name", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])

    text = (F.col("text") if "text" in docs.columns else F.lit(None)).cast("string").alias("text")
    slim = docs.select("doc_id", text, F.col(spans).cast("array<struct<name: string, start: long, end: long>>").alias("spans"))
    return slim.mapInArrow(run, f"doc_id {kind}, name string, start long, end long, n_tokens long, n_crossing long, doc_tokens long")


def totals(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens of every document."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                n = [len(token_offsets(t, path)) - 1 if t else 0 for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    slim = docs.select("doc_id", (F.col("text") if "text" in docs.columns else F.lit(None)).cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, n_tokens long")
