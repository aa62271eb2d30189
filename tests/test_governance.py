"""Logs, answers, catalogue checks and access on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from probatum.operators import access, catalogue, graph
from probatum.sources import answers, logs


def chain(n, genesis=logs.GENESIS, **more):
    out, seal = [], genesis
    for i in range(1, n + 1):
        line = {"n": i, "previo": seal, "cuando": f"2027-01-0{i}", "registro": {"ñ": i}} | more
        seal = line["sello"] = logs.seal_of(line)
        out.append(line)
    return out


def frame(spark, **named):
    return spark.createDataFrame([(k, json.dumps(x)) for k, v in named.items() for x in v], "log string, line string")


def test_breaks_of_logs(spark):
    edited, swapped, bare = chain(4), chain(3), [{"n": 1, "cuando": "x"}, {"n": 2, "cuando": "y"}]
    edited[2]["cuando"] = "later"
    swapped[0]["n"], swapped[1]["n"] = 2, 1
    cut = chain(4)[:2] + chain(4)[3:]
    got = {r.log: r.rotura for r in logs.first_breaks(frame(spark, whole=chain(3), edited=edited, swapped=swapped, bare=bare, cut=cut)).collect()}
    assert got == {"whole": None, "edited": 3, "swapped": 1, "bare": None, "cut": 3}
    heads = {r.log: (r.cabeza, r.lineas) for r in logs.heads(frame(spark, whole=chain(3))).collect()}
    assert heads == {"whole": (chain(3)[-1]["sello"], 3)}


def test_moved_logs_are_whole_and_say_what_they_cannot_prove(spark):
    edited = chain(3)
    edited[1]["cuando"] = "later"
    lines = frame(spark, whole=chain(2), edited=edited, bare=[{"n": 1, "cuando": "x"}])
    with pytest.raises(Exception, match="the chain breaks in edited at 2"):
        logs.migrate(lines).collect()
    moved = logs.migrate(lines, accept_broken=True)
    got = {(r.log, r.n): r.origen for r in moved.collect()}
    assert got == {("whole", 1): None, ("whole", 2): None, ("edited", 1): None, ("edited", 2): logs.UNPROVEN[1], ("edited", 3): logs.UNPROVEN[1], ("bare", 1): logs.UNPROVEN[0]}
    assert all(r.rotura is None for r in logs.first_breaks(moved.select("log", "line")).collect())
    assert logs.migrate(lines.limit(0)).count() == 0


def test_log_file_with_blank_and_unreadable_lines(spark, tmp_path):
    at = tmp_path / "a.jsonl"
    at.write_text("\n".join([json.dumps(chain(2)[0]), "  ", json.dumps(chain(2)[1]), ""]))
    assert logs.read_log(spark, str(at)).count() == 2
    at.write_text("{broken")
    with pytest.raises(Exception, match="unreadable line"):
        logs.parsed(logs.read_log(spark, str(at))).collect()


def declaration(**changes):
    records = [{"control_id": f"Q{i}", "observado_en": "2027-01-01T10:00:00+00:00", "contenido": {"valor": ["a", i], "quien": "x", "cargo": "y"}} for i in range(3)]
    seal = {"esquema": "e", "emitido_en": "2027", "registros": records, "raiz": answers.root_of(records), "firma": None, "clave_publica": None}
    return {"sello": seal | changes}


def test_answers_of_both_kinds(spark):
    hand = {"respuestas": [{"pregunta": "P", "valor": True, "quien": "x", "cargo": "y", "cuando": "2027-01-01"}]}
    undated = {"respuestas": [{"pregunta": "P", "valor": True, "quien": "x", "cargo": "y"}]}
    edited = declaration()
    edited["sello"]["registros"][0]["contenido"]["valor"] = "z"
    docs = {"hand": hand, "undated": undated, "sealed": declaration(), "edited": edited, "two": declaration() | {"registros": []}, "extra": declaration(estado="conforme"), "signed": declaration(firma="00", clave_publica="k"), "other": {"x": 1}, "list": [1]}
    rows = [(k, json.dumps(v)) for k, v in docs.items()] + [("null", None), ("broken", "{")]
    table = answers.answers(spark.createDataFrame(rows, "path string, body string")).collect()
    good = [(r.path, r.pregunta, r.valor, r.confianza) for r in table if r.problema is None]
    assert good == [("hand", "P", "true", "sin_firma"), ("sealed", "Q0", '["a",0]', "sin_firma"), ("sealed", "Q1", '["a",1]', "sin_firma"), ("sealed", "Q2", '["a",2]', "sin_firma")]
    assert {r.path for r in table if r.problema} == {"undated", "edited", "two", "extra", "signed", "other", "list", "null", "broken"}
    signed = json.dumps(docs["signed"])
    assert {r[7] for r in answers.answers_of("s", signed, None, lambda s: True)} == {"firmada"}
    assert {r[7] for r in answers.answers_of("s", signed, "k", lambda s: True)} == {"identidad_verificada"}
    assert answers.answers_of("s", signed, "other", lambda s: True)[0][8]


def test_roots_of_records_equal_the_distributed_tree(spark):
    from probatum.functions import merkle

    for n in (0, 1, 2, 3, 5):
        rows = spark.createDataFrame([(i, json.dumps({"i": i}, separators=(",", ":"))) for i in range(n)], "i long, d string")
        assert answers.root_of([{"i": i} for i in range(n)]) == "sha256:" + merkle.root(rows, "i", "d")


def test_catalogue_of_one_ring_has_no_problems(spark):
    ring = [(f"C{i}", [f"C{(i + 1) % 3}"], [f"C{(i + 2) % 3}"], True, ["x"]) for i in range(3)]
    clauses = spark.createDataFrame(ring, "id string, alimenta array<string>, depende_de array<string>, exige boolean, produce array<string>")
    assert catalogue.management_problems(clauses, (("C0", "C2"),), 3).count() == 0
    assert [r.problema for r in catalogue.management_problems(clauses, (("C0", "C9"),), 3).collect()] == ["ciclo_abierto"]
    pairs = spark.createDataFrame([("C0", "C1"), ("C0", "N"), ("N", "C1")], "a string, b string")
    assert sorted(r.problema for r in catalogue.crosswalk_problems(pairs, clauses, clauses).collect()) == ["par_sin_destino", "par_sin_origen"]
    assert catalogue.duplicate_ids(clauses.unionAll(clauses.limit(1))).count() == 1


def test_access(spark):
    cases = [(["observacion"], "plan", True), (["lectura"], "plan", False), (["lectura", "remediacion"], "remediar", True), (["admin"], "almacen migrar", False), (["observacion"], "anexo v", True), (["admin"], None, False), (None, "soa", False), ([], "soa", False), ([None], "soa", False)]
    got = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, roles array<string>, verb string, want boolean").withColumn("got", access.may(F.col("roles"), F.col("verb")))
    assert all(r.got == r.want for r in got.collect())
    names = spark.createDataFrame([("abc",), ("a-c",), ("ab",), ("-bc",), ("abc\n",), ("Abc",), (None,)], "t string")
    assert [r[0] for r in names.select(access.is_tenant(F.col("t"))).collect()] == [True, True, False, False, False, False, False]


def test_closure_has_every_path_and_no_empty_one(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (8, 9), (9, 8)], "a int, b int")
    line = {(a, b) for a in range(1, 7) for b in range(a + 1, 7)}
    assert {tuple(r) for r in graph.closure(edges, 6).collect()} == line | {(8, 9), (9, 8), (8, 8), (9, 9)}
    assert graph.closure(edges.limit(0), 6).count() == 0
