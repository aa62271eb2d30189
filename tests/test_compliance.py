"""Repositories scanned from disk, rule packs over them, the log, and the decision table on all profiles."""

import datetime
import itertools
import os

import pytest
from pyspark.sql import functions as F

from probatum.operators import applicability, controls, evidence, packs
from probatum.operators.rules import RuleSpec, call_matches, call_scan
from probatum.sources import agents, catalogues, files


def put(root, **texts):
    for name, text in texts.items():
        path = root / name.replace("__", "/").replace("_dot_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_scan_stays_within_its_root(spark, tmp_path):
    outside, root = tmp_path / "outside", tmp_path / "r (1)+"
    put(outside, secret_dot_md="secret")
    put(root, a__x_dot_py="import os", _dot_git__c_dot_md="never", node_modules__p__y_dot_py="never", b_dot_md="text")
    os.symlink(outside, root / "link")
    os.symlink(outside / "secret.md", root / "one.md")
    os.symlink(root / "a", root / "again")
    os.symlink(root / "b.md", root / "c.md")
    (root / "odd.md").write_bytes(b"\xff\xfe")
    rows = {r.path: r for r in files.scan(spark, str(root)).collect()}
    assert sorted(rows) == ["a/x.py", "b.md", "c.md", "link", "odd.md", "one.md"]
    assert rows["link"].error == rows["one.md"].error == "enlace fuera de la raiz" and not rows["link"].readable
    assert rows["odd.md"].error == "no es UTF-8" and rows["c.md"].text == "text" and rows["a/x.py"].text == "import os"
    assert all("secret" not in (r.text or "") and "never" not in (r.text or "") for r in rows.values())


def test_projections_and_calls(spark, tmp_path):
    put(tmp_path, m_dot_py='"""doc"""\nimport openai  # note\nopenai.chat.create(1)\nlog.info("x")\n', bad_dot_py="def (", d_dot_md="prose", Dockerfile="FROM x", c_dot_yml="a: 1")
    scanned = files.projections(files.scan(spark, str(tmp_path)))
    code = {r.path: r.code for r in scanned.collect()}
    assert code["d.md"] is None and code["Dockerfile"] is None and code["c.yml"] == "a: 1" and "doc" not in code["m.py"] and "note" not in code["m.py"]
    calls, imports = files.call_sites(scanned)
    assert [(r.line, r.signature) for r in call_scan(calls, spark.createDataFrame([("chat.create",)], "signature string")).collect()] == [(3, "chat.create")]
    assert [r.path for r in files.unparsed(scanned).collect()] == ["bad.py"]
    sign = spark.createDataFrame([("chat.create",)], "signature string")
    need = lambda m: call_matches(calls, sign, imports, spark.createDataFrame([(m,)], "module string")).count()
    assert (need("openai"), need("json"), call_matches(calls, sign).count()) == (1, 0, 1)


RULES = (
    RuleSpec("SIN-REGISTRO", "llamada_sin_pareja", pack="art12", obligation="AIA-012", signatures=("chat.create",), pair=("log.info",), requires_import=("openai",)),
    RuleSpec("FICHA", "fichero", pack="art10", obligation="AIA-010", patterns=("ficha",)),
    RuleSpec("EVALS", "fichero", pack="art15", obligation="AIA-015", patterns=("^evals/",)),
    RuleSpec("APRUEBA", "contenido", pack="art14", obligation="AIA-014", patterns=("approve",)),
    RuleSpec("ANULA", "contenido", pack="art14", obligation="AIA-014", patterns=("override",)),
    RuleSpec("PARADA", "contenido", pack="art14", obligation="AIA-014", patterns=("stop_now",)),
    RuleSpec("PARTICIONES", "contenido", pack="art10", obligation="AIA-010", patterns=("splits",), documentation=True),
)


def test_fixture_repositories(spark):
    """A classifier that logs its model's calls, with approval words only, and a repository with nothing to look at."""
    rows = [("c", "app/scoring.py", "import openai\nopenai.chat.create(1)\nlog.info(2)\n"), ("c", "app/revision.py", "approve = 1"), ("c", "datos/README.md", "the splits are 80/20"), ("c", "evals/test_x.py", "pass"), ("u", "util.py", "x = 1"), ("v", "a.py", "import openai\nopenai.chat.create(1)\n")]
    t = files.projections(spark.createDataFrame([(*r, None) for r in rows], "repo string, path string, text string, error string"))
    calls, imports = files.call_sites(t)
    got = {(r.repo, r.regla_id): r for r in packs.evaluate(t, calls, imports, RULES).collect()}
    bad = {k for k, r in got.items() if r.hallazgos}
    assert {k for k in bad if k[0] == "c"} == {("c", "ANULA"), ("c", "PARADA"), ("c", "FICHA")}
    assert got["c", "SIN-REGISTRO"].senal == "los 1 sitios tienen su pareja en el mismo fichero" and not got["u", "SIN-REGISTRO"].aplicable
    assert [tuple(r) for r in packs.findings(t, calls, imports, RULES).collect()] == [("v", "SIN-REGISTRO", "a.py")]
    none = spark.createDataFrame([], "repo string, ilegibles long")
    out = {(r.repo, r.paquete): r.resultado for r in packs.outcomes(packs.evaluate(t, calls, imports, RULES), none).collect()}
    assert (out["c", "art12"], out["u", "art12"], out["v", "art12"], out["c", "art14"], out["c", "art15"]) == ("sin_hallazgos", "no_aplica", "con_hallazgos", "con_hallazgos", "sin_hallazgos")

    def digests(frame):
        return {(r.repo, r.paquete): r.sujeto_digest for r in packs.subject_digests(frame, imports, RULES).collect()}

    before = digests(t)
    readme = t.withColumn("text", F.when(F.col("path") == "datos/README.md", "other").otherwise(F.col("text")))
    moved = {k for k, d in digests(readme).items() if d != before[k]}
    assert moved == {("c", "art10")}  # only the pack that reads documentation


def test_rules_that_lack_a_field_are_named():
    got = packs.rule_problems([RuleSpec("a", "llamada"), RuleSpec("b", "magia"), RuleSpec("c", "fichero", patterns=("x",)), RuleSpec("c", "aportado", question="q")])
    assert got == [("b", "tipo"), ("a", "signatures"), ("c", "repetida")]


def test_decision_table_agrees_on_every_profile(spark):
    """5 role sets x 3^4 values x 4 exclusions x 3 routes, on three dates."""
    tri = (None, True, False)
    roles = ([], ["proveedor"], ["importador"], ["proveedor", "distribuidor"], ["autoridad"])
    out = ((False, False, False), (True, False, False), (False, True, False), (False, False, True))
    rows = [(i, r, *x, *e, via) for i, (r, x, e, via) in enumerate(itertools.product(roles, itertools.product(tri, repeat=4), out, (None, "anexo_i", "anexo_iii")))]
    profiles = spark.createDataFrame(rows, "perfil_id int, roles array<string>, es_alto_riesgo boolean, es_sector_publico boolean, provee_modelo_uso_general boolean, modelo_con_riesgo_sistemico boolean, fines_militares boolean, solo_investigacion boolean, es_codigo_abierto boolean, via_anexo string")
    assert len(rows) * 3 == 14_580
    day = datetime.date
    split = {"anexo_iii": day(2027, 12, 2), "anexo_i": day(2028, 8, 2)}
    obligations = spark.createDataFrame([(f"AIA-{k:03}", a, ["proveedor"] if k % 2 else ["importador", "distribuidor"], day(2026, 8, 2), s) for k, (a, s) in enumerate(itertools.product([a for a, _ in applicability.SCOPE_TABLE], (None, split)), 1)] + [("AIA-050", "todo_sistema", ["proveedor"], day(2026, 8, 2), None)], "obligacion_id string, alcance string, roles_obligados array<string>, aplica_desde date, aplica_desde_por_via map<string, date>")
    for date in ("2026-09-20", "2027-12-02", "2028-08-02"):
        a, b = applicability.resolve(profiles, obligations, date), applicability.resolve_by_table(profiles, obligations, date)
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0 and a.count() == len(rows) * 11
    assert applicability.decision_table(spark).count() == len(applicability.DECISIONS)


def test_records_verify_and_unknown_revocations_fail(spark):
    none = spark.createDataFrame([], "n long, tipo string, registro_id string, control_id string, sujeto_digest string, contenido string, cuando string")
    new = spark.createDataFrame([("C", "s", "x", "2024", 1), ("C", "s", "x", "2025", 2), ("C", None, None, "2024", 3)], "control_id string, sujeto_digest string, contenido string, cuando string, orden long")
    rows = evidence.append(none, new, 0)
    assert sorted((r.n, r.tipo) for r in rows.collect()) == [(1, "observacion"), (2, "revalidacion"), (3, "observacion")]
    seen = rows.where("tipo = 'observacion'")
    assert all(r.integro for r in evidence.verified(seen).collect())
    assert not any(r.integro for r in evidence.verified(seen.withColumn("contenido", F.lit("y"))).collect())
    asked = spark.createDataFrame([("nobody", "m", "q", "2026", 1)], "registro_id string, motivo string, quien string, cuando string, orden long")
    with pytest.raises(Exception, match="no such record"):
        evidence.revoke(rows, asked, 3).collect()


def test_unknown_trust_is_not_valid(spark):
    row = spark.createDataFrame([("valida", None, None, "d", "d", None, None, None)], "estado_declarado string, revocada boolean, confiable boolean, sujeto_digest string, digest_actual string, observado_en timestamp_ntz, revalidado_en timestamp_ntz, frescura_dias int")
    assert row.select(evidence.state(F.lit("2024-01-01").cast("timestamp_ntz"))).first()[0] == "no_fiable"


def test_agents_control_of_a_fixture(spark):
    code = "@tool(readOnlyHint=True)\ndef a(): pass\n@tool\ndef b(): pass\nAgent(tools=[a, {'name': 'c', 'effect': 1}], max_steps=3)\n"
    mcp = '{"mcpServers": {"one": {"tools": [{"name": "x", "annotations": {"destructiveHint": true}}, {"name": "y"}]}, "two": {}}}'
    t = spark.createDataFrame([("r", "asistente.py", code), ("r", "mcp.json", mcp), ("f", "requirements.txt", "langchain"), ("n", "u.py", "x = 1"), ("bad", "mcp.json", "{")], "repo string, path string, text string")
    rows = agents.structure(t)
    tools = agents.tools(rows)
    found = controls.agent_findings(rows, tools)
    assert {(r.regla_id, r.localizacion) for r in found.collect()} == {(controls.UNDECLARED, "b (asistente.py:4)"), (controls.UNDECLARED, "one.y (mcp.json)"), (controls.BLIND, "two")}
    out = {r.repo: (r.ejecucion, r.suficiencia, r.resultado) for r in controls.agent_outcomes(t, rows, found).collect()}
    assert out == {"r": ("completada", None, "con_hallazgos"), "f": ("completada", "indeterminada", "indeterminado"), "n": ("no_aplicable", None, "no_aplica"), "bad": ("no_aplicable", None, "no_aplica")}
    moved = t.withColumn("path", F.when(F.col("path") == "asistente.py", "src/asistente.py").otherwise(F.col("path")))
    digest = lambda frame: {r.repo: r.sujeto_digest for r in agents.arsenal_digest(agents.structure(frame)).collect()}
    assert digest(t) == digest(moved) and set(digest(t)) == {"r", "f"}


def test_catalogue_is_loaded_and_its_faults_are_named(spark, tmp_path):
    put(tmp_path, reglas__a_dot_json='{"paquete": "art10", "version": "2", "obligacion": "AIA-010", "reglas": [{"id": "R1", "tipo": "fichero", "severidad": "alta", "patrones": ["x"], "que_busca": {"es": "a", "en": "b"}}, {"id": "R2", "tipo": "aportado", "severidad": "media", "pregunta": {"es": "que"}, "que_busca": {"es": "a", "en": ""}}]}')
    put(tmp_path, obligaciones_dot_json='{"obligaciones": [{"id": "AIA-010", "articulo": "10", "titulo": {"es": "a", "en": "b"}, "nivel": "maquina"}, {"id": "AIA-010", "articulo": "11", "titulo": {"es": "a"}, "nivel": "otro"}, {"id": null, "articulo": "12", "titulo": null, "nivel": "maquina"}]}')
    put(tmp_path, formularios__f1_dot_json='{"paquete": "f1", "preguntas": [{"id": "Q1", "formato": "texto"}]}', formularios__f2_dot_json='{"paquete": "otro", "preguntas": []}')
    rules = {r.id: r for r in catalogues.load_rules(spark, str(tmp_path / "reglas"))}
    assert (rules["R1"].patterns, rules["R1"].pack, rules["R1"].version, rules["R2"].question) == (("x",), "art10", "2", "que")
    assert {(r.id, r.problema) for r in catalogues.rule_faults(spark, str(tmp_path / "reglas")).collect()} == {("R2", "que_busca")}
    o = catalogues.load(spark, str(tmp_path / "obligaciones.json"), "obligaciones", catalogues.OBLIGATION)
    faults = {(r.id, r.problema) for r in catalogues.faults(o, ("articulo", "nivel"), ("titulo",), {"nivel": catalogues.LEVELS}).collect()}
    assert faults == {("AIA-010", "repetido"), ("AIA-010", "titulo"), ("AIA-010", "nivel"), (None, "id"), (None, "titulo")}
    forms = catalogues.load_forms(spark, str(tmp_path / "formularios"))
    assert [r.paquete for r in catalogues.misnamed(forms).collect()] == ["otro"]
    (tmp_path / "reglas" / "b.json").write_text("{")
    with pytest.raises(Exception):
        catalogues.load_rules(spark, str(tmp_path / "reglas"))


def test_roles_bind_each_pair_once_without_a_table_of_pairs(spark):
    p = spark.createDataFrame([(1, ["a", "b", "a", None]), (2, [None]), (3, []), (4, None), (5, ["b"]), (5, ["b"])], "perfil_id long, roles array<string>")
    o = spark.createDataFrame([("x", ["b", "a", None]), ("y", ["c", None]), ("z", ["b", "b"])], "obligacion_id string, roles_obligados array<string>")
    got = applicability.bound_by_role(p, o)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "x"), (1, "z"), (5, "x"), (5, "x"), (5, "z"), (5, "z")]
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_profiles_of_one_file_are_dealt_over_tasks(spark):
    from probatum.catalog import QUERIES

    for name in ("applicability_by_table", "applicability_case"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").select(F.spark_partition_id()).distinct().count() > 1
