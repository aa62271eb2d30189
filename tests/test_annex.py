"""Annex IV from trees on disk: what each extractor reads, what it says when there is nothing, and the documents."""

import json
import time

import pytest
from pyspark.sql import functions as F

from probatum.operators import annex
from probatum.sources import files

TREE = {
    "pyproject.toml": '[project]\nname = "clasificador"\nversion = "2.1.0"\ndependencies = [\n  "openai==1.2",\n  "numpy>=1",\n]\n',
    "sub/requirements.txt": "# note\n  pandas~=2.0  \n\nnumpy>=1\ntorch @ x@sha256:ab\n",
    "setup.cfg": "[metadata]\nname = 'otro'\n",
    "deploy/Dockerfile": "FROM x\n# needs GPU and 8 cpus\nENV MEMORY=1\n",
    ".github/workflows/deploy.yml": "runs-on: gpu\n",
    "docker-compose.yml": "memory: 2g\n",
    "app/main.py": "import x\nx.AutoModel.from_pretrained('a')\ntoken = vault.get()\n",
    "app/util.py": "# jailbreak in a comment\nimport hashlib\nd = 'sha256:0'\nx.from_pretrained_no()\n",
    "solo.py": "def (",
    "datos/Ficha_datos.md": "splits",
    "docs/Manual-uso.md": "how",
    "docs/CHANGELOG.md": "# v9.9.9\n",
    "Historial.txt": "## [1.2.0] today\ntext 3.3.3\n### v1.1.0\n",
    "raw.bin": "x",
}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    scanned = files.projections(files.scan(spark, str(root))).withColumn("repo", F.lit("r"))
    bad = files.unparsed(scanned).select("path", F.col("error").alias("why"))
    scanned = scanned.join(bad, "path", "left").withColumn("error", F.coalesce("error", "why")).drop("why")
    empty = spark.createDataFrame([("nada", "LICENSE", None, None, None)], "repo string, path string, text string, code string, error string")
    return scanned.select("repo", "path", "text", "code", "error").unionByName(empty).cache(), files.call_sites(scanned)[0].cache()


def test_extractors_of_a_tree(tree):
    got = {(r.repo, r.extractor): r for r in annex.extracted(*tree).collect()}
    content = {k[1]: json.loads(r.contenido) for k, r in got.items() if k[0] == "r" and r.contenido}
    sources = {k[1]: list(r.fuentes) for k, r in got.items() if k[0] == "r"}
    assert content["version_y_proveedor"] == {"version": "2.1.0", "nombre": "otro"} and sources["version_y_proveedor"] == ["pyproject.toml", "setup.cfg"]
    assert content["dependencias"] == {"total": 5, "fijadas": 3, "lista": ["numpy>=1", "openai==1.2", "pandas~=2.0", "torch @ x@sha256:ab"]}
    assert sources["dependencias"] == ["pyproject.toml", "sub/requirements.txt"]
    assert content["computo"] == {"pistas": ["GPU", "MEMORY", "memory"]} and sources["computo"] == ["deploy/Dockerfile", "docker-compose.yml"]
    assert content["terceros"] == {"sitios": ["app/main.py (x.AutoModel.from_pretrained)"]} and sources["terceros"] == ["app/main.py"]
    assert content["arquitectura"] == {"modulos": 2, "paquetes": {"app": 2}, "puntos_de_entrada": ["app/main.py"]}
    assert content["datos"] == {"fichas": ["datos/Ficha_datos.md"]} and content["instrucciones"] == {"documentos": ["docs/Manual-uso.md"]}
    assert content["ciberseguridad"] == {"patrones": [{"patron_observado": "gestion de secretos", "fichero": "app/main.py"}, {"patron_observado": "fijacion de artefactos por digest", "fichero": "app/util.py"}], "total_observados": 2}
    assert content["cambios"] == {"fichero": "Historial.txt", "versiones": ["1.2.0", "1.1.0"]} and sources["cambios"] == ["Historial.txt", "docs/CHANGELOG.md"]
    none = [r for k, r in got.items() if k[0] == "nada"]
    assert len(none) == len(annex.EXTRACTORS) and all(r.contenido is None and r.motivo and list(r.fuentes) == [] for r in none)
    assert all((r.contenido is None) == (r.motivo is not None) for r in got.values())


def test_sections_and_documents(spark, tree):
    found = annex.extracted(*tree)
    lines = spark.createDataFrame([("r", "AIA-014", "con_hallazgos", 2, 1)], "repo string, obligacion string, estado string, hallazgos long, preguntas long")
    supplied = spark.createDataFrame([("r", "AIV-1-a", "para qué sirve", "Ana", "2026-01-01"), ("nada", "AIV-1-b", "interacción", "Luis", "2026-01-02")], "repo string, seccion string, texto string, firmado_por string, fecha string")
    rows = annex.sections(found, lines, supplied).cache()
    got = {(r.repo, r.seccion): r for r in rows.collect()}
    assert len(got) == 2 * len(annex.SECTIONS)
    assert got["r", "AIV-1-a"].procedencia == "derivada+aportada" and got["nada", "AIV-1-a"].procedencia == "ausente" and got["nada", "AIV-1-b"].procedencia == "aportada"
    assert json.loads(got["r", "AIV-2-e"].contenido) == {"estado": "con_hallazgos", "hallazgos": 2, "preguntas_abiertas": 1} and list(got["r", "AIV-2-e"].fuentes) == ["control de AIA-014"]
    assert got["r", "AIV-9"].motivo == "no hay línea del plan de AIA-072" and got["r", "AIV-4"].motivo == annex.PERSON
    document = {r.repo: json.loads(r.documento) for r in annex.document(rows).collect()}
    assert document["r"]["recuento"] == {"derivada": 9, "aportada": 0, "derivada+aportada": 1, "ausente": 13} and document["r"]["total_secciones"] == 23
    assert [s["seccion"] for s in document["r"]["secciones"]] == [s[0] for s in annex.SECTIONS] and document["nada"]["secciones"][1]["firmado_por"] == "Luis"
    text = {r.repo: r.documento for r in annex.markdown(rows).collect()}
    assert ("\n" + text["r"]).count("\n## ") == 23 and "> Firmado por Ana el 2026-01-01." in text["r"] and "**Falta**" in text["nada"]


def test_long_contents_are_cut_in_the_text_only(spark):
    paths = [f"data/dataset_{i:03}.csv" for i in range(200)]
    rows = spark.createDataFrame([("r", p, None, None, None) for p in paths], "repo string, path string, text string, code string, error string")
    calls = spark.createDataFrame([], "repo string, path string, dotted string")
    lines = spark.createDataFrame([], "repo string, obligacion string, estado string, hallazgos long, preguntas long")
    supplied = spark.createDataFrame([], "repo string, seccion string, texto string, firmado_por string, fecha string")
    got = annex.sections(annex.extracted(rows, calls), lines, supplied)
    whole = json.loads(next(s for s in json.loads(annex.document(got).first().documento)["secciones"] if s["seccion"] == "AIV-2-d")["contenido"])
    text = annex.markdown(got).first().documento
    assert whole["fichas"] == paths and f"faltan {len(json.dumps(whole, separators=(',', ':'))) - annex.SHOWN} caracteres" in text and paths[-1] not in text


def test_a_large_repository_costs_no_square(spark):
    """16 000 releases of 4 000 logs, of which one counts, and 9 000 dependencies, of which 60 are listed."""
    logs = spark.range(4000).select(F.concat(F.lit("log/changelog"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("path"), F.concat(F.lit("# 4.0."), "id", F.lit("\n## 3.0.0\n# 2.0.0\n# v1.0."), "id").alias("text"))
    deps = spark.range(30).select(F.concat(F.lit("r"), "id", F.lit("/requirements.txt")).alias("path"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(299)), lambda k: F.concat(F.lit("d"), F.col("id") * 1000 + k, F.when(k % 3 == 0, "==1").otherwise(""))), "\n").alias("text"))
    rows = logs.unionByName(deps).select(F.lit("r").alias("repo"), "path", "text", F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("error"))
    began = time.time()
    got = {r.extractor: json.loads(r.contenido) for r in annex.extracted(rows, spark.createDataFrame([], "repo string, path string, dotted string")).collect() if r.contenido}
    assert time.time() - began < 45
    assert got["cambios"] == {"fichero": "log/changelog00000", "versiones": ["4.0.0", "3.0.0", "2.0.0", "1.0.0"]}
    names = sorted(f"d{i * 1000 + k}" + "==1" * (k % 3 == 0) for i in range(30) for k in range(300))
    assert got["dependencias"] == {"total": 9000, "fijadas": 3000, "lista": names[:60]}
    few = annex._first_ones(spark.createDataFrame([("r", "dependencias", "dependencia", f"v{i:03}", None, None, 2) for i in range(100)], "repo string, extractor string, clave string, valor string, path string, orden int, n long"), annex.EXTRACTORS).collect()
    assert len(few) == 62 and {r.clave: r.n for r in few} == {"dependencia": 2, "#dependencia": 100, "*dependencia": 200}
