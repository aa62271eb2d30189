"""Documents, declarations of conformity, a whole catalogue from disk, and marks in both containers."""

import json
import struct

from probatum.operators import papers
from probatum.sources import catalogues, images


def test_papers_count_every_state_and_cut_only_cells(spark):
    rows = spark.createDataFrame([("a", 2, "x|y\n" + "z" * 2000, "mal", None), ("a", 1, None, "bien", [1]), ("b", 1, "q", "otro", [])], "caso string, o int, t string, estado string, xs array<int>")
    got = {r.caso: json.loads(r.documento) for r in papers.paper(rows, "s/v1", "caso", "o", "filas", "estado", ("bien", "mal", "nunca")).collect()}
    assert got["a"]["recuento"] == {"bien": 1, "mal": 1, "nunca": 0} and got["a"]["total"] == 2 and got["b"]["recuento"] == {"bien": 0, "mal": 0, "nunca": 0}
    assert [f["o"] for f in got["a"]["filas"]] == [1, 2] and got["a"]["filas"][1] == {"o": 2, "t": "x|y\n" + "z" * 2000, "estado": "mal", "xs": None}
    text = {r.caso: r.documento for r in papers.paper_markdown(rows, "T", "caso", "o", ("t", "estado"), "estado", ("bien", "mal", "nunca")).collect()}
    assert text["a"].startswith("# T: a\n\n1 bien, 1 mal\n\n| t | estado |\n| --- | --- |\n|  | bien |\n| x\\|y zzz") and text["a"].endswith(" ... | mal |")
    assert papers.paper(rows.limit(0), "s", "caso", "o", "filas", "estado", ("bien",)).collect() == []


def test_declarations(spark):
    systems = spark.createDataFrame([("s", '{"nombre":"x"}'), ("t", None)], "caso string, contenido string")
    said = [("s", "F-PRV-2", "ACME", True), ("s", "F-CNF-1", "True", True), ("s", "F-CNF-2", "ISO", False), ("s", "F-PRV-3", "un organismo NOTIFICADO", True), ("s", "F-CNF-3", "0123", True), ("s", "F-CNF-4", "Madrid", True), ("t", "F-CNF-1", "false", True), ("t", "F-CNF-4", "Roma", False)]
    answers = spark.createDataFrame([(c, p, v, "Ana", "dir", "2026-01-01", ok) for c, p, v, ok in said], "caso string, pregunta string, valor string, quien string, cargo string, cuando string, vale boolean")
    rows = papers.declarations(systems, answers).cache()
    got = {(r.caso, r.punto): r for r in rows.collect()}
    assert [got["s", str(k)].procedencia for k in range(1, 9)] == ["derivada", "aportada", "formula", "formula", "formula", "ausente", "aportada", "aportada"]
    assert [got["t", str(k)].procedencia for k in range(1, 9)] == ["ausente", "ausente", "formula", "formula", "no_procede", "ausente", "no_procede", "ausente"]
    assert got["s", "8"].es_la_firma and got["s", "8"].respondida_por == "Ana" and got["t", "5"].motivo == "depende de F-CNF-1" and got["s", "6"].motivo.endswith("F-CNF-2")
    documents = {r.caso: json.loads(r.documento) for r in papers.declaration(rows).collect()}
    assert documents["s"]["firmado"] and documents["s"]["aviso"] is None and not documents["t"]["firmado"] and documents["t"]["aviso"].startswith("BORRADOR")
    assert documents["s"]["recuento"] == {"derivada": 1, "aportada": 3, "formula": 3, "no_procede": 0, "ausente": 1} and [p["id"] for p in documents["t"]["puntos"]] == [p[0] for p in papers.POINTS]
    text = {r.caso: r.documento for r in papers.declaration_markdown(rows).collect()}
    assert text["s"].startswith("# Declaración UE de conformidad\n") and "BORRADOR" in text["t"].splitlines()[0] and "*APORTADA por Ana (dir)*\n\nMadrid" in text["s"]


def test_a_whole_catalogue(spark, tmp_path):
    both = {"es": "a", "en": "b"}
    obligation = {"id": "AIA-1", "articulo": "1", "titulo": both, "nivel": "maquina", "roles": ["proveedor"], "alcance": "todo_sistema", "aplica_desde": "2026-08-02"}
    whole = {
        "ai-act/obligaciones.json": {"obligaciones": [obligation]},
        "ai-act/requisitos.json": {"requisitos": [{"id": "R1", "articulo": "1", "apartados": ["1"], "actores": ["proveedor"], "nivel": "maquina", "exige": both, "cubierto_por": ["X"]}, {"id": "R2", "articulo": "1", "apartados": [], "actores": [], "nivel": "juzgada", "exige": both, "cubierto_por": [], "por_que_no_esta_cubierto": "porque"}]},
        "iso42001/anexo-a.json": {"controles": [{"id": "A.2.2", "titulo": both, "nivel": "organizativa"}]},
        "iso42001/clausulas.json": {"clausulas": [{"id": "ISO-4.1", "clausula": "4.1", "titulo": both, "nivel": "organizativa", "exige_informacion_documentada": False, "alimenta": ["ISO-4.2"]}, {"id": "ISO-4.2", "clausula": "4.2", "titulo": both, "nivel": "organizativa", "exige_informacion_documentada": True, "vigencia_dias": 30}]},
        "crosswalk.json": {"pares": [{"aiact": "AIA-1", "iso42001": "A.2.2"}]},
    }

    def put(body):
        for name, value in body.items():
            (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name).write_text(json.dumps(value))
        return catalogues.load_catalogue(spark, str(tmp_path))

    tables = put(whole)
    assert catalogues.catalogue_faults(tables).collect() == []
    assert [(r.id, r.vigencia_dias, r.periodicidad) for r in tables["clausulas"].orderBy("id").collect()] == [("ISO-4.1", 365, "continua"), ("ISO-4.2", 30, "continua")] and tables["controles"].first().grupo == "A.2"
    bad = json.loads(json.dumps(whole))
    bad["ai-act/requisitos.json"]["requisitos"][1]["por_que_no_esta_cubierto"] = " "
    bad["iso42001/anexo-a.json"]["controles"] += [{"id": "A.2.2", "titulo": {"es": "a"}, "nivel": "otro"}]
    bad["iso42001/clausulas.json"]["clausulas"][0] |= {"alimenta": ["ISO-9"], "exige_informacion_documentada": None}
    bad["crosswalk.json"]["pares"] += [{"aiact": "AIA-9", "iso42001": "A.2.2"}, {"aiact": None, "iso42001": "A.9"}]
    got = {(r.tabla, r.id, r.problema) for r in catalogues.catalogue_faults(put(bad)).collect()}
    assert got == {("requisitos", "R2", "sin_cubrir_y_sin_motivo"), ("controles", "A.2.2", "repetido"), ("controles", "A.2.2", "titulo"), ("controles", "A.2.2", "nivel"), ("clausulas", "ISO-4.1", "alimenta"), ("clausulas", "ISO-4.1", "exige_informacion_documentada"), ("pares", "AIA-9-A.2.2", "aiact"), ("pares", "?-A.9", "aiact"), ("pares", "?-A.9", "iso42001")}


def test_marks_in_both_containers(spark):
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"JF" + b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, 5, 9, 0) + b"\xff\xd9"
    assert images.image_facts(jpeg)["digital_source_type"] is None
    facts = images.image_facts(images.jpeg_with_mark(jpeg))
    assert (facts["container"], facts["width"], facts["height"], facts["xmp_packets"], facts["digital_source_type"]) == ("jpeg", 9, 5, 1, images.VOCABULARY + images.SYNTHETIC[0])
    rows = spark.createDataFrame([(bytearray(jpeg),), (bytearray(b"GIF89a"),), (None,)], "content binary").select(images.marked("content").alias("m"))
    assert [images.image_facts(r.m)["digital_source_type"] if r.m is not None else None for r in rows.collect()] == [images.VOCABULARY + images.SYNTHETIC[0], None, None]
