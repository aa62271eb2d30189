import os

import pytest
from pyspark.sql import functions as F

from probatum.functions import merkle
from probatum.operators import graph, rules
from probatum.sources import files
from probatum.streaming.pushes import step


def test_scan_reads_text_and_reports_what_it_cannot(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.py").write_text('"""doc"""\nimport os.path\nos.path.join("a")  # note\r\n')
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    (tmp_path / "Dockerfile").write_text("FROM x")
    (tmp_path / "image.png").write_bytes(b"\x89PNG")
    os.symlink("/etc/hostname", tmp_path / "out.txt")
    rows = {r.path: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a/x.py", "bad.md", "Dockerfile", "image.png", "out.txt"}
    assert rows["bad.md"].error and rows["out.txt"].error and rows["Dockerfile"].text == "FROM x" and rows["image.png"].text is None
    calls, imports = files.call_sites(files.scan(spark, str(tmp_path)))
    assert [r.dotted for r in calls.collect()] == ["os.path.join"]
    assert {r.module for r in imports.collect()} == {"os", "os.path"}
    code = files.scan(spark, str(tmp_path)).where("path = 'a/x.py'").select(files.strip_prose(F.col("text")).alias("c")).first().c
    assert "note" not in code and "doc" not in code
    with pytest.raises(NotADirectoryError):
        files.scan(spark, str(tmp_path / "none"))


def test_call_rule_matches_suffixes(spark):
    calls = spark.createDataFrame([("p", "client.chat.create"), ("q", "create"), ("r", "chat.created")], "path string, dotted string")
    hits = rules.call_matches(calls, spark.createDataFrame([("chat.create",)], "signature string"))
    assert [(r.path, r.n) for r in hits.collect()] == [("p", 1)]


def test_merkle_root_promotes_odd_nodes(spark):
    import hashlib

    h = lambda b: hashlib.sha256(b).digest()
    leaves = [h(b"\0" + x) for x in (b"a", b"b", b"c")]
    want = h(b"\1" + h(b"\1" + leaves[0] + leaves[1]) + leaves[2]).hex()
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "i long, d string")
    assert merkle.root(rows, "i", "d") == want
    assert merkle.root(rows.limit(0), "i", "d") == merkle.EMPTY
    assert merkle.proof(rows, "i", "d", 2) == [(h(b"\1" + leaves[0] + leaves[1]).hex(), True)]
    assert merkle.proof(rows, "i", "d", 0) == [(leaves[1].hex(), False), (leaves[2].hex(), False)]


@pytest.mark.parametrize("n", [1, 2, 1023, 1025, 2600])
def test_merkle_proofs_of_many_leaves(spark, n):
    import hashlib

    h = lambda b: hashlib.sha256(b).digest()
    level = [h(b"\0" + str(k).encode()) for k in range(n)]
    while len(level) > 1:
        level = [h(b"\1" + level[k] + level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    rows = spark.range(n).select(F.col("id").alias("i"), F.col("id").cast("string").alias("d"))
    top = merkle.root(rows, "i", "d")
    assert top == level[0].hex()
    for at in {0, n // 2, n - 1}:
        path = merkle.proof(rows, "i", "d", at)
        assert merkle.verify(str(at).encode(), path, top) and not merkle.verify(b"x", path, top)


def test_reachability_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a long, b long")
    assert {(r.a, r.b): r.pasos for r in graph.reachable(edges, 4).collect()}[(1, 1)] == 3


def test_pushes_chain_and_redelivery():
    decision, seen, chain = step(None, [], "s0", None, False)
    assert decision == "reobservar" and seen == "s0"
    decision, seen, chain = step(seen, chain, "s1", "s0", True)
    assert decision == "ignorar" and chain == ["s1"]
    assert step(seen, chain, "s1", "s0", True)[0] == "revalidar"
    assert step(seen, chain, "s2", "s0", True)[0] == "reobservar"
    assert step(seen, ["x"] * 10, "s2", "x", True)[0] == "reobservar"


def test_push_stream(spark, tmp_path):
    from probatum.streaming.pushes import decisions

    schema = "location string, ref string, n long, sha string, before string, inert boolean"
    spark.createDataFrame([("l", "m", 1, "a", None, False), ("l", "m", 2, "b", "a", True), ("l", "m", 3, "b", "a", True)], schema).write.parquet(str(tmp_path / "in"))
    q = decisions(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("pushes_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.decision for r in spark.sql("SELECT decision FROM pushes_out ORDER BY n").collect()] == ["reobservar", "ignorar", "revalidar"]


def test_patterns_mean_what_python_means(spark):
    rows = [("é.py", "ein und aus"), ("b.py", "hundö undöte"), ("c.py", "x\rund y\n"), ("d.py", "VERSIÓN")]
    f = spark.createDataFrame(rows, "path string, text string")
    hits = lambda p: {r.localizacion for r in rules.forbidden_findings(f, rules.RuleSpec("R", "contenido_prohibido", patterns=(p,))).collect()}
    assert hits(r"\bund\b") == {"é.py", "c.py"} and hits("^und") == set() and hits("(?i)versi[oó]n") == {"d.py"}
