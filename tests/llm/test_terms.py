"""Winnowing, spelling variants and ranked search against brute force, in blocks, and on awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from probatum.llm import dense_search, spelling, winnowing

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
#: Names that the operators use for columns of their own.
CLASH = "h w mark start length width held win pos item_id n_words met f_id f_h spans items word n run a b n_a n_b key form root moved terms tf item term share rank r score n_near best less at further".split()


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))


def with_clashes(spark, rows, key="doc_id"):
    names = [c for c in CLASH if c != key]
    return spark.createDataFrame([(*r, *names) for r in rows], f"{key} long, text string, " + ", ".join(f"{c} string" for c in names))


DOCS = [(1, None), (2, ""), (2, ""), (3, "w1 w2"), (3, "other text of the same id"), (None, "no id a b c"), (None, "no id a b c"), (4, "x " * 40_000), (5, "é" * 300_000), (6, " ".join(f"w{i}" for i in range(60))), (7, "pre " + " ".join(f"W{i}," for i in range(5, 25)) + " post"), (8, "\t\n"), (9, "ab cd ef x " * 3 + "w30 w31 w32 w33 w34 w35 w36 w37 w38")]
ITEMS = [(1, " ".join(f"w{i}" for i in range(30))), (2, "w50 w51 w52"), (3, None), (3, "..."), (4, "cd EF"), (4, "w10 w11 w12 w13 w14 w15 w16 w17 w18 w19"), (None, "w58 w59"), (11, "x x x x x x x x x x x x"), (12, "no id"), (12, "no id"), (13, "w30 w31 w32 w33 w34 w35 w36 w37 w38 zz")]


def plain_hits(docs, items, span=10):
    windows = collections.defaultdict(set)
    for i, t in items:
        ws = terms(t)
        for k in range(max(len(ws) - span, 0) + 1) if ws else ():
            windows[tuple(ws[k : k + span])].add(i)
    widths, out = {len(w) for w in windows}, []
    for i, t in docs:
        ws, hit, found = terms(t), set(), set()
        for width in widths:
            for k in range(len(ws) - width + 1):
                if (w := tuple(ws[k : k + width])) in windows:
                    hit |= set(range(k, k + width))
                    found |= windows[w]
        out.append((i, len(ws), len(hit), tuple(sorted(found - {None})), bool(hit)))
    return collections.Counter(out)


def got_hits(frame):
    rows = frame.collect()
    assert all(sum(s.end - s.start for s in r.spans) == r.n_hit and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:])) for r in rows)
    return collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in rows)


@pytest.mark.parametrize("at_once", [winnowing.MARKS, 3])
def test_winnowing_of_awkward_rows(spark, at_once):
    docs, items = with_clashes(spark, DOCS), with_clashes(spark, ITEMS, "item_id")
    assert got_hits(winnowing.decontaminate(docs, items, marks_at_once=at_once)) == plain_hits(DOCS, ITEMS)
    assert winnowing.decontaminate(docs.limit(0), items).collect() == []
    assert not any(r.contaminated for r in winnowing.decontaminate(docs, items.limit(0)).collect())
    assert {r.n_words for r in winnowing.decontaminate(docs.drop("text"), items).collect()} == {0}


@pytest.mark.parametrize(("k", "span"), [(6, 10), (2, 4), (3, 3), (1, 6)])
def test_winnowing_misses_no_shared_span(spark, k, span):
    """Few different words, so that hashes repeat within windows and hits meet at any distance."""
    rnd = random.Random(k)
    text = lambda n: " ".join(rnd.choice("abcd") for _ in range(n))
    docs = [(i, text(rnd.randint(0, 120))) for i in range(60)]
    items = [(i, text(rnd.randint(0, 2 * span))) for i in range(40)]
    items += [(100 + i, " ".join(docs[i][1].split()[3 : 3 + rnd.randint(1, 2 * span)])) for i in range(30)]
    got = winnowing.decontaminate(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"), k, span, 50)
    assert got_hits(got) == plain_hits(docs, items, span)


def test_digest_sorts_ids_as_text(spark):
    row = spark.createDataFrame([([9, 10, 100],), ([],)], "items array<long>").select(winnowing.digest_of("items").alias("x")).collect()
    assert [r.x for r in row] == [hashlib.sha256(b"10,100,9").hexdigest(), hashlib.sha256(b"").hexdigest()]


def plain_variants(docs, length=6, count=5, ratio=5):
    n = collections.Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = low(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= length
    n = {w: c for w, c in n.items() if c >= count}
    cuts = collections.defaultdict(set)
    for w in n:
        for k in range(len(w)):
            cuts[w[:k] + w[k + 1 :]].add((w, k))
    near = collections.defaultdict(set)
    for w in n:
        for k in range(len(w)):
            short = w[:k] + w[k + 1 :]
            near[w] |= {x for x, j in cuts[short] if j == k and x != w} | ({short} & n.keys())
        near[w] |= {x for x, _ in cuts.get(w, ())}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best
    out = set()
    for w, c in n.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, c, len(near[w]), n[form[w]] if w in form else None))
    return out


def got_variants(frame):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def test_variants_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain_variants([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert got_variants(spelling.variants(docs)) == want and any(r[1] for r in want)


def test_variants_of_all_edits(spark):
    """Every insertion, deletion and replacement of words of all lengths, chains of forms, ties, letters beyond ASCII."""
    rnd = random.Random(3)
    rows = []
    for base, times in (("abcdef", 25), ("abcdefg", 125), ("überñandé", 40), ("aaaaaa", 30), ("aaaaaaa", 30), ("aaaaaaaa", 200), ("extraordinarily", 26)):
        rows += [base] * times
        for _ in range(30):
            k, c = rnd.randrange(len(base) + 1), rnd.choice("abzéÀ")
            edits = (base[:k] + c + base[k:], base[: max(k - 1, 0)] + base[k:], base[: max(k - 1, 0)] + c + base[k:])
            rows += [rnd.choice(edits)] * rnd.randint(3, 7)
    rows += ["chaina"] * 9000 + ["chainb"] * 1500 + ["chainbc"] * 250 + ["chainbcd"] * 40 + ["ohainbcd"] * 7 + ["tiebreak"] * 8 + ["tiebreaka"] * 60 + ["tiebreakb"] * 60
    rnd.shuffle(rows)
    docs = [(i, ", ".join(rows[i::50])) for i in range(50)] + [(None, None), (None, "nobodys " * 9), (1, ""), (2, "UPPER upper Upper×÷÷ " * 9), (3, "z" * 200_000)]
    want = plain_variants(docs)
    assert {r[0]: r[2] for r in want}["ohainbcd"] == "chaina" and {r[0]: r[1] for r in want}["tiebreak"] in ("tiebreaka", "tiebreakb")
    frame = with_clashes(spark, docs)
    assert got_variants(spelling.variants(frame)) == want
    assert spelling.variants(frame.limit(0)).collect() == [] and spelling.variants(frame.drop("text")).collect() == []


def test_a_pair_is_found_once(spark):
    words = spark.createDataFrame([("abcdef", 5), ("abcdeg", 5), ("abcdefg", 5), ("bcdefa", 5)], "word string, n long")
    got = [(r.a, r.b) for r in spelling.near_pairs(words).collect()]
    assert sorted(got) == [("abcdef", "abcdefg"), ("abcdef", "abcdeg"), ("abcdeg", "abcdefg")]


def plain_ranks(docs, items, top=10):
    alnum = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")
    bags = [(i, collections.Counter(map(low, alnum(t)))) for i, t in docs]
    lengths = [sum(b.values()) for _, b in bags]
    n_docs, n_terms = sum(x > 0 for x in lengths), sum(lengths)
    df = collections.Counter(t for _, b in bags for t in b)
    wanted = collections.defaultdict(set)
    for i, t in items:
        wanted[i] |= set(map(low, alnum(t)))
    out = []
    for item, ts in wanted.items():
        scored = []
        for (i, b), n in zip(bags, lengths, strict=True):
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * (10 + 90 * n * n_docs // n_terms))) for t in ts if b[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def ranks(frame):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect()), key=str)


@pytest.mark.parametrize(("block", "tiles"), [(dense_search.ITEMS, (64, 4096, 1024)), (7, (3, 5, 11))])
def test_ranks_equal_brute_force(spark, block, tiles):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = plain_ranks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert ranks(dense_search.rank(docs, items, block=block, tiles=tiles)) == want


def test_ranks_of_awkward_rows(spark):
    """Many equal scores, also of repeated rows and of documents without id, over several tiles and tasks."""
    docs = DOCS + [(100 - i, "w1 w2 same") for i in range(60)] + [(None, "w1 w2 same")] * 2 + [(50, "w1 w2 same")] * 3
    frame, items = with_clashes(spark, docs).repartition(5), with_clashes(spark, ITEMS, "item_id")
    assert ranks(dense_search.rank(frame, items, tiles=(2, 3, 4))) == plain_ranks(docs, ITEMS)
    assert dense_search.rank(frame.limit(0), items).collect() == dense_search.rank(frame, items.limit(0)).collect() == dense_search.rank(frame.drop("text"), items).collect() == []


def test_sums_stay_exact(monkeypatch):
    """Parts end before a sum could be rounded, and whole numbers of 64 bits that don't suffice are Python's."""
    monkeypatch.setattr(dense_search, "EXACT", 3 * 27_000 * dense_search.IMPACT)
    tile = dense_search.Tile(0, np.zeros(10, np.int64), np.arange(10), np.full(10, 27_000), 4096)
    assert max(len(p) for p, _ in tile.parts) == 2
    got = tile.scores(np.arange(10), np.zeros(10, np.int64), np.full(10, 999_999), 1)
    assert got.tolist() == [[10 * 27_000 * 999_999]]
    n = np.array([1, 10**9])
    assert dense_search.impacts(np.array([1, 3]), n, 10**11, 10**13).tolist() == [10**9 * t // (1000 * t + 8 * (10 + 90 * int(x) * 10**11 // 10**13)) for t, x in ((1, 1), (3, 10**9))]


def test_spelling_broadcasts_nothing(spark, tmp_path):
    """However small the files that words come from seem, what they give isn't sent to the driver."""
    spark.createDataFrame([("common", 9), ("comman", 5), ("comxman", 5)], "word string, n long").write.parquet(f"{tmp_path}/w")
    pairs = spelling.near_pairs(spark.read.parquet(f"{tmp_path}/w"))
    assert sorted((r.a, r.b) for r in pairs.collect()) == [("comman", "common"), ("comman", "comxman")]
    whole = spelling.variants(spark.createDataFrame([(1, "common " * 30 + "comman " * 5)], "doc_id long, text string"))
    for x in (pairs, whole):
        assert "Broadcast" not in x._jdf.queryExecution().executedPlan().toString()
