"""Plans of several analysers, from files on: agents, generation and marking, packs of one obligation merged, engines from the catalogue."""

import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from probatum.operators import analysers, controls, packs
from probatum.operators.rules import RuleSpec
from probatum.plans.analysis import RULES
from probatum.sources import catalogues, files

ROWS = [
    ("a", "asistente.py", "import agents\n@tool(effect='lee')\ndef leer(): pass\n@tool\ndef borrar(): pass\nrun_agent(x, max_steps=3)\n"),
    ("a", "mcp.json", json.dumps({"mcpServers": {"docs": {"tools": [{"name": "buscar", "annotations": {"readOnlyHint": True}}]}, "caja": {}}})),
    ("f", "requirements.txt", "langchain==1\n"),
    ("n", "util.py", "x = 1\n"),
    ("i", "gen.py", "import openai\nopenai.images.generate()\n'images.generate'\n"),
    ("m", "gen.py", "import openai\nopenai.images.generate()\n"),
    ("t", "bot.py", "import openai, fastapi\nopenai.chat.completions.create()\napp.post()\n"),
    ("t", "web.py", "import fastapi\napp.post()\n"),
    ("w", "correo.py", "correo.chat.completions.create()\n"),
]
ART = [("m", "1.png", "png", "sintetico", None), ("m", "2.png", "png", "sintetico", None), ("t", "3.png", "png", "sin_marca", "present_unverified"), ("n", "4.png", "png", "sin_marca", None)]


@pytest.fixture(scope="module")
def trees(spark):
    t = files.projections(spark.createDataFrame([(*r, None) for r in ROWS], "repo string, path string, text string, error string"))
    calls, imports = files.call_sites(t)
    return analysers.Trees(t.cache(), calls.cache(), imports.cache(), spark.createDataFrame(ART, "repo string, path string, container string, marca string, c2pa string"))


def judged(trees, **change):
    evaluated, own = analysers.run(dataclasses.replace(trees, **change), RULES)
    none = evaluated.sparkSession.createDataFrame([], "repo string, ilegibles long")
    rows = {(r.repo, r.regla_id): r for r in evaluated.collect()}
    return rows, {(r.repo, r.paquete): r for r in packs.outcomes(evaluated, none, own).collect()}


def test_agents_and_generation(spark, trees):
    rows, out = judged(trees)
    found = {k[1]: r.hallazgos for k, r in rows.items() if k[0] == "a" and r.hallazgos}
    assert found == {controls.UNDECLARED: 1, controls.BLIND: 1, "G-PROSA": 1}
    assert rows["a", controls.UNDECLARED].senal == "2 de 3 herramientas declaran su efecto" and rows["a", controls.UNLIMITED].senal == "pasos" and rows["a", controls.UNCAPPED].senal == "1 delegaciones con tope de pasos"
    agents = {k[0]: (r.ejecucion, r.suficiencia, r.resultado) for k, r in out.items() if k[1] == "agentes"}
    assert agents["a"] == ("completada", None, "con_hallazgos") and agents["f"] == ("completada", "indeterminada", "indeterminado") and agents["n"] == ("no_aplicable", None, "no_aplica")
    art = {k[0]: (r.ejecucion, r.suficiencia, r.resultado) for k, r in out.items() if k[1] == "art50"}
    assert art["i"] == ("completada", "indeterminada", "indeterminado")  # generates images, supplied none
    assert art["m"] == ("completada", "suficiente", "sin_hallazgos") and art["t"] == ("completada", "indeterminada", "indeterminado")
    assert art["n"] == art["w"] == ("no_aplicable", None, "no_aplica")  # an unmarked image matters only where something is generated
    assert rows["t", analysers.BOT].senal == "1 puntos de entrada de asistente" and rows["m", analysers.UNMARKED].senal == "2 artefactos con marcado leido"


@pytest.mark.parametrize(("steps", "rule", "verdict"), [(["a_png", "quitar_metadatos"], "ACT-50-PIPE-BORRA", None), (["rotar_90"], "ACT-50-PIPE-FRAGIL", None), (["rotar_90", "magia"], None, "indeterminada"), ([], None, "suficiente")])
def test_marks_that_the_steps_lose(spark, trees, steps, rule, verdict):
    rows, out = judged(trees, pipelines=spark.createDataFrame([("m", steps), ("i", steps)], "repo string, pasos array<string>"))
    assert {k[1]: r.hallazgos for k, r in rows.items() if k[0] == "m" and r.paquete == "art50" and r.hallazgos} == ({rule: 2} if rule else {})
    assert out["m", "art50"].suficiencia == verdict and out["i", "art50"].hallazgos == 0


def test_packs_of_one_obligation_make_one_line(spark, trees):
    repos = trees.files.select("repo").distinct()
    verdicts = repos.select("repo", F.explode(F.array(F.lit("AIA-014"), F.lit("AIA-050"), F.lit("AIA-099"))).alias("obligacion")).withColumn("nivel", F.lit("maquina")).withColumn("situacion", F.lit("ata"))
    none = spark.createDataFrame([], "repo string, ilegibles long")
    got = {(r.repo, r.obligacion): r for r in analysers.plan(trees, RULES, verdicts, none).collect()}
    assert (got["a", "AIA-014"].estado, got["a", "AIA-014"].hallazgos) == ("con_hallazgos", 3)  # of the agents pack and the generic one
    assert got["m", "AIA-050"].estado == "comprobada" and (got["t", "AIA-050"].estado, got["t", "AIA-050"].preguntas) == ("a_preguntar", 1)
    assert got["n", "AIA-099"].estado == "a_preguntar" and list(got["a", "AIA-014"].controles_cubiertos) == ["ACT-AG-DELEGACION-SIN-TOPE", "ACT-AG-EFECTO-SIN-DECLARAR", "ACT-AG-SIN-LIMITES", "G-PROHIBIDO"]


def test_engines_are_dispatched_and_unknown_ones_refused(spark, trees, tmp_path):
    rule = RuleSpec("X", "propia", pack="x", obligation="AIA-001", engine="propio")
    with pytest.raises(ValueError, match="propio"):
        analysers.run(trees, [rule])

    def own(trees, rules):
        rows = analysers._rows(trees.files.select("repo").distinct(), spark.createDataFrame([("a", "X", 7, None)], "repo string, regla_id string, hallazgos long, senal string"), rules, F.lit(True))
        return rows, rows.select("repo", "paquete", F.lit("completada").alias("ejecucion"), F.lit(None).cast("string").alias("suficiencia")).distinct()

    evaluated, _ = analysers.run(trees, [rule, *RULES[:2]], {**analysers.ENGINES, "propio": own})
    assert {(r.repo, r.hallazgos) for r in evaluated.where("regla_id = 'X'").collect()} == {(r, 7 if r == "a" else 0) for r in "afnimtw"}

    packs_ = {"ag": {"paquete": "ag", "version": "1", "obligacion": "AIA-014", "motor": "agentes", "reglas": [{"id": "ACT-AG-SIN-LIMITES", "severidad": "alta"}]}, "g": {"paquete": "g", "version": "1", "obligacion": "AIA-014", "reglas": [{"id": "G", "tipo": "fichero", "severidad": "alta", "patrones": ["x"]}]}}
    for name, body in packs_.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    assert [r.id for r in catalogues.load_rules(spark, str(tmp_path))] == ["G"]
    assert {(r.id, r.engine) for r in catalogues.load_rules(spark, str(tmp_path), None)} == {("G", "generico"), ("ACT-AG-SIN-LIMITES", "agentes")}
    (tmp_path / "z.json").write_text(json.dumps({**packs_["ag"], "motor": "nadie", "paquete": "z"}))
    with pytest.raises(ValueError, match="motor"):
        catalogues.load_rules(spark, str(tmp_path))
