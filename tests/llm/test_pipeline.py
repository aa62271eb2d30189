"""The pipeline's stages one after another, each against plain Python on its own input."""

import collections
import re

import corpus_pipeline as cp
from probatum.llm import pii_semicrf
from probatum.llm.common import cut, read

SF = "/root/testdata/sf0.001"


def shingles(text, width=5):
    ws = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)} if len(ws) >= width else {tuple(ws)} if ws else set()


def test_stages_equal_plain_python(spark):
    docs, at = read(spark, SF, "documents"), {}
    columns = docs.columns
    for name, stage in cp.STAGES:
        at[name] = docs = cut(stage(spark, docs, SF), name)
        assert name == cp.STAGES[-1][0] or docs.columns == columns
    rows = {name: df.collect() for name, df in at.items()}

    whole = {r.doc_id: r.text for r in read(spark, SF, "documents").collect()}
    assert all(whole[r.doc_id] == r.text for r in rows["quality"]) and 0 < len(rows["quality"]) < len(whole)

    sets = {r.doc_id: shingles(r.text) for r in rows["quality"]}
    least = {k: k for k in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert sorted(r.doc_id for r in rows["near_duplicates"]) == sorted(k for k in sets if least[k] == k)

    w = pii_semicrf.weights()
    masked = {r.doc_id: pii_semicrf.masked(r.text or "", pii_semicrf.all_spans(r.text or "", w)[1]) for r in rows["near_duplicates"]}
    assert {r.doc_id: r.text or "" for r in rows["personal_data"]} == masked
    assert not any(k == "email" for t in masked.values() for *_, k in pii_semicrf.base_spans(t))

    taken = collections.Counter(r.doc_id for r in rows["mixing"])
    assert set(taken) <= set(masked) and max(taken.values()) <= 3
    assert all((r.text or "") == masked[r.doc_id] for r in rows["mixing"])
    assert collections.Counter(r.doc_id for r in rows["packing"]) == taken
    assert collections.Counter(r.doc_id for r in cp.run(spark, SF).collect()) == taken
