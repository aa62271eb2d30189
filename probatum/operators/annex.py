"""Annex IV from repositories: extractors over their files, sections with their provenance, the document as JSON and Markdown.

files: repo, path, text (null where it isn't read), code (null but for code), error. calls: repo, path, dotted. All extractors run in
one pass over files: each file says what it holds as facts (repo, extractor, clave, orden, valor, path); facts are
counted by value before anything is listed, so that a row holds a repository's distinct values and not its files. Of what a
document shows only the first ones of, no more than these reach a repository's row; their numbers are counted before.
A repository of which an extractor finds nothing gets the reason, never an empty content.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probatum.functions.lineage import settled

from .dossier import PINNED

# What the extractors look for.
MANIFESTS = ("pyproject.toml", "setup.cfg", "package.json")
QUOTED = r"""["']([^"']+)["']"""
DECLARED = r"(?m)^\s*{}\s*[=:]\s*" + QUOTED
DEPENDENCY_BLOCK = r"(?s)dependencies\s*=\s*\[(.*?)\]"
PIPELINES = r"(?i)(^|/)\.github/|(^|/)\.gitlab-ci|(^|/)\.circleci/"
DEPLOYMENT = r"(?i)(^|/)(dockerfile|docker-compose)[^/]*$|(deploy|k8s|kubernetes|helm|infra)|\.(tf|tfvars)$"
RESOURCES = r"(?i)\b(gpu|cuda|nvidia|memory|cpus?|instance_type|machine_type|node_type)\b[^\n]{0,60}"
LOADERS = ("from_pretrained", "hf_hub_download", "snapshot_download", "load_model")
ENTRY_POINTS = ("main.py", "app.py", "cli.py", "__main__.py")
DATASHEETS = r"(?i)(datasheet|data.?card|ficha.?datos|dataset)"
MANUALS = r"(?i)(instruc|manual|user.?guide|uso)\w*\.(md|rst|txt|pdf)$"
MEASURES = (("pruebas de manipulacion de entrada", r"(?i)injection|jailbreak|redteam"), ("limitacion de peticiones", r"(?i)rate.?limit"), ("fijacion de artefactos por digest", r"(?i)sha256:|digest"), ("gestion de secretos", r"(?i)secrets?\.|keyring|vault"))
CHANGELOGS = r"(?i)(^|/)(changelog|historial|cambios)[^/]*$"
RELEASES = r"(?m)^#{1,3}\s*\[?v?(\d+\.\d+\.\d+)"
NO_ENTRY, ROOT = "(ninguno reconocido por nombre)", "(raiz)"
PERSON = "nadie la ha aportado"

_FACT = "array<struct<extractor: string, clave: string, orden: int, valor: string>>"


def _facts(extractor: str, key: str, values: Column, when: Column) -> Column:
    """An array of facts from an array of values, in their order."""
    made = F.transform(values, lambda v, i: F.struct(F.lit(extractor).alias("extractor"), F.lit(key).alias("clave"), i.cast("int").alias("orden"), v.cast("string").alias("valor")))
    return F.when(when, made).otherwise(F.array()).cast(_FACT)


def _first(text: Column, pattern: str) -> Column:
    """The first group of the first match as an array of one, or none."""
    return F.filter(F.array(F.regexp_extract(text, pattern, 1)), lambda x: x != "")


@dataclass(frozen=True)
class Extractor:
    """What a file says, what is made of it, how many sources are named, and what is said where there is nothing.

    first: of which keys only so many values are kept, the first by path and order (where these are kept), then as BY says or by value.
    The keys NUMBER + key and TIMES + key then tell how many different ones there were, and how often.
    """

    name: str
    reads: Callable[[Column, Column, Column, Column], list[tuple[str, Column, Column]]]
    content: Callable[[Callable[[str], Column]], Column]
    reason: str
    sources: int | None = None
    first: Mapping[str, int] = field(default_factory=dict)


NUMBER, TIMES = "#", "*"


def _one(at, key):
    """The value of the last in order, of equal ones the greatest."""
    return F.element_at(F.transform(F.array_sort(F.transform(at(key), lambda x: F.struct(x["orden"], x["path"], x["valor"]))), lambda x: x["valor"]), -1)


def _values(at, key, most: int | None = None):
    listed = F.sort_array(F.array_distinct(F.transform(at(key), lambda x: x["valor"])))
    return F.slice(listed, 1, most) if most else listed


def _times(at, key):
    return F.aggregate(at(key), F.lit(0).cast("long"), lambda a, x: a + x["n"])


def _by_path(at, key, most: int):
    """Values of the least path, in their order, the first ones."""
    least = F.transform(F.array(F.array_min(F.transform(at("fichero"), lambda y: y["path"]))), lambda m: F.filter(at(key), lambda x: x["path"] == m))  # found once, not for each value
    items = F.get(least, F.lit(0))
    return F.slice(F.transform(F.array_sort(F.transform(items, lambda x: F.struct(x["orden"], x["valor"]))), lambda x: x["valor"]), 1, most)


def _named(path: Column, text: Column, code: Column, ok: Column):
    place = F.array_position(F.array(*[F.lit(x) for x in MANIFESTS]), path)
    held = (place > 0) & text.isNotNull()
    ranked = lambda name: F.concat(F.array_repeat(F.lit(None).cast("string"), place.cast("int")), _first(text, DECLARED.format(name)))  # noqa: E731  its place is its order
    return [("", F.array(path), held), ("version", ranked("version"), held), ("nombre", ranked("name"), held)]


def _depends(path, text, code, ok):
    base = F.element_at(F.split(path, "/"), -1)
    lines = F.filter(F.transform(F.filter(F.split(text, "\n"), lambda x: ~x.startswith("#")), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    listed, block = (base == "requirements.txt") & text.isNotNull(), (base == "pyproject.toml") & text.isNotNull()
    named = F.regexp_extract_all(F.regexp_extract(text, DEPENDENCY_BLOCK, 1), F.lit(QUOTED), F.lit(1))
    pinned = lambda xs: F.transform(F.filter(xs, lambda x: x.rlike(PINNED)), lambda x: F.lit("si"))
    return [("", F.array(path), listed | block), ("dependencia", lines, listed), ("dependencia", named, block), ("fijada", pinned(lines), listed), ("fijada", pinned(named), block)]


def _computes(path, text, code, ok):
    deployed = path.rlike(DEPLOYMENT) & ~path.rlike(PIPELINES) & text.isNotNull()
    return [("pistas", F.slice(F.regexp_extract_all(text, F.lit(RESOURCES), F.lit(1)), 1, 6), deployed)]


def _is_built(path, text, code, ok):
    python = path.endswith(".py") & text.isNotNull() & ok
    base = F.element_at(F.split(path, "/"), -1)
    return [("paquetes", F.array(F.when(F.contains(path, F.lit("/")), F.split_part(path, F.lit("/"), F.lit(1))).otherwise(ROOT)), python), ("puntos_de_entrada", F.array(path), python & base.isin(*ENTRY_POINTS))]


def _protects(path, text, code, ok):
    seen = F.array_compact(F.array(*[F.when(code.rlike(p), F.lit(label)) for label, p in MEASURES]))
    return [("patrones", F.transform(seen, lambda x: F.concat(path, F.lit("\t"), x)), code.isNotNull())]


def _changes(path, text, code, ok):
    log = path.rlike(CHANGELOGS)
    return [("fichero", F.array(path), log), ("versiones", F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RELEASES), F.lit(1)), log)]


def _folders(at):
    rows = F.array_sort(F.transform(at("paquetes"), lambda x: F.struct(x["valor"].alias("k"), x["n"].alias("n"))))
    return F.map_from_entries(rows)


def _pattern(value: Column) -> Column:
    order = F.array(*[F.lit(label) for label, _ in MEASURES])
    file, label = (F.split_part(value, F.lit("\t"), F.lit(i)) for i in (1, 2))
    return F.struct(file.alias("fichero"), F.array_position(order, label).alias("o"), label.alias("patron_observado"))


#: How values of a key are ordered, if not as texts.
BY = {"patrones": _pattern}


def _patterns(at):
    rows = F.transform(at("patrones"), lambda x: _pattern(x["valor"]))
    return F.transform(F.slice(F.array_sort(rows), 1, 20), lambda x: F.struct(x["patron_observado"].alias("patron_observado"), x["fichero"].alias("fichero")))


def _listed(key: str, what: str, matches: str):
    return (lambda path, text, code, ok: [(key, F.array(path), path.rlike(matches))]), (lambda at: F.struct(_values(at, key).alias(key))), what


#: The registry: one entry for each extractor that reads files.
EXTRACTORS = (
    Extractor("version_y_proveedor", _named, lambda at: F.struct(_one(at, "version").alias("version"), _one(at, "nombre").alias("nombre")), "ningún manifiesto declara nombre o versión"),
    Extractor("dependencias", _depends, lambda at: F.struct(_times(at, TIMES + "dependencia").alias("total"), _times(at, "fijada").alias("fijadas"), _values(at, "dependencia", 60).alias("lista")), "ninguna dependencia declarada", first={"dependencia": 60}),
    Extractor("computo", _computes, lambda at: F.struct(_values(at, "pistas", 20).alias("pistas")), "ningún manifiesto de despliegue declara recursos; los de integración continua no cuentan", first={"pistas": 20}),
    Extractor("terceros", lambda path, text, code, ok: [], lambda at: F.struct(_values(at, "sitios").alias("sitios")), "ninguna carga de modelos de terceros en el código leído"),
    Extractor("arquitectura", _is_built, lambda at: F.struct(_times(at, "paquetes").alias("modulos"), _folders(at).alias("paquetes"), F.when(F.size(at("puntos_de_entrada")) > 0, _values(at, "puntos_de_entrada")).otherwise(F.array(F.lit(NO_ENTRY))).alias("puntos_de_entrada")), "ningún módulo Python leído", 40),
    Extractor("datos", *_listed("fichas", "ninguna ficha de un conjunto de datos", DATASHEETS)),
    Extractor("instrucciones", *_listed("documentos", "ningún documento de instrucciones de uso", MANUALS)),
    Extractor("ciberseguridad", _protects, lambda at: F.struct(_patterns(at).alias("patrones"), _times(at, NUMBER + "patrones").alias("total_observados")), "ningún patrón de ciberseguridad en el código; hay que aportarlo", 20, {"patrones": 20}),
    Extractor("cambios", _changes, lambda at: F.struct(F.array_min(F.transform(at("fichero"), lambda x: x["path"])).alias("fichero"), _by_path(at, "versiones", 20).alias("versiones")), "ningún historial de cambios", first={"fichero": 1, "versiones": 20}),
)


def facts(files: DataFrame, calls: DataFrame, extractors: Sequence[Extractor] = EXTRACTORS) -> DataFrame:
    """(repo, path, extractor, clave, orden, valor): what each file says to all extractors at once; clave "" names a source only."""
    path, text, code = F.col("path"), F.col("text"), F.col("code")
    ok = F.col("error").isNull()
    said = F.concat(*[_facts(e.name, key, values, when) for e in extractors for key, values, when in e.reads(path, text, code, ok)], F.array().cast(_FACT))
    held = files.select("repo", "path", F.inline(said)).where(F.col("valor").isNotNull())
    loads = calls.where(F.col("dotted").rlike("(" + "|".join(LOADERS) + ")$"))
    return held.unionByName(loads.select("repo", "path", F.lit("terceros").alias("extractor"), F.lit("sitios").alias("clave"), F.lit(0).alias("orden"), F.concat("path", F.lit(" ("), "dotted", F.lit(")")).alias("valor")))


def _sources(found: DataFrame, extractors: Sequence[Extractor]) -> DataFrame:
    """(repo, extractor, fuentes): the sorted files that an extractor draws on, the first ones where it bounds them."""
    each = found.select("repo", "extractor", "path").distinct()
    most = {e.name: e.sources for e in extractors if e.sources}
    widest = max(most.values(), default=1)
    nth = F.row_number().over(Window.partitionBy("repo", "extractor").orderBy("path"))
    few = each.where(F.col("extractor").isin(*most)).withColumn("nth", nth).where(F.col("nth") <= widest).drop("nth")
    limit = F.coalesce(F.create_map(*[F.lit(x) for kv in most.items() for x in kv])[F.col("extractor")], F.lit(2**31 - 1)) if most else F.lit(2**31 - 1)
    listed = each.where(~F.col("extractor").isin(*most)).unionByName(few).groupBy("repo", "extractor").agg(F.sort_array(F.collect_list("path")).alias("fuentes"))
    return listed.withColumn("fuentes", F.slice("fuentes", F.lit(1), limit))


#: Keys whose facts differ by path and order.
PLACED = ("version", "nombre", "versiones")


def _first_ones(counted: DataFrame, extractors: Sequence[Extractor]) -> DataFrame:
    """The facts that a repository's row needs: of bounded keys the first ones, and rows NUMBER + key and TIMES + key with their numbers."""
    most = {(e.name, key): k for e in extractors for key, k in e.first.items()}
    if not most:
        return counted
    own = lambda name, key: (F.col("extractor") == name) & (F.col("clave") == key)
    limit = F.coalesce(*[F.when(own(*at), F.lit(k)) for at, k in most.items()])
    rest = counted.where(limit.isNull())
    bounded = counted.where(limit.isNotNull())
    by = [F.when(own(*at), BY[at[1]](F.col("valor"))) for at in most if at[1] in BY]
    nth = F.row_number().over(Window.partitionBy("repo", "extractor", "clave").orderBy("path", "orden", *by, "valor"))
    few = bounded.withColumn("nth", nth).where(F.col("nth") <= max(most.values())).where(F.col("nth") <= limit).drop("nth")
    totals = bounded.groupBy("repo", "extractor", "clave").agg(F.count("*").alias("rows"), F.sum("n").alias("times"))
    told = F.array(*[F.struct(F.concat(F.lit(mark), "clave").alias("clave"), F.col(c).alias("n")) for mark, c in ((NUMBER, "rows"), (TIMES, "times"))])
    nothing = lambda c: F.lit(None).cast(counted.schema[c].dataType).alias(c)
    totals = totals.select("repo", "extractor", F.inline(told)).select("repo", "extractor", "clave", nothing("valor"), nothing("path"), nothing("orden"), "n")
    return rest.unionByName(few).unionByName(totals)


def extracted(files: DataFrame, calls: DataFrame, extractors: Sequence[Extractor] = EXTRACTORS) -> DataFrame:
    """(repo, extractor, contenido, fuentes, motivo) of every repository and extractor: JSON and its sources, or the reason why there is none."""
    # Texts are read once; version and release facts differ by place.
    placed = F.when(F.col("clave").isin(*PLACED), F.col("orden"))
    found = settled(facts(files, calls, extractors).groupBy("repo", "extractor", "clave", "valor", "path", placed.alias("orden")).agg(F.count("*").alias("n")))
    # What repeats is counted, not listed.
    counted = found.where("clave <> ''").groupBy("repo", "extractor", "clave", "valor", F.when(F.col("clave").isin(*PLACED, "fichero"), F.col("path")).alias("path"), "orden").agg(F.sum("n").alias("n"))
    held = _first_ones(counted, extractors).groupBy("repo", "extractor").agg(F.collect_list(F.struct("clave", "valor", "path", "orden", "n")).alias("hechos"))
    at = lambda key: F.filter("hechos", lambda x: x["clave"] == key)
    content = F.coalesce(*[F.when(F.col("extractor") == e.name, F.to_json(e.content(at))) for e in extractors])
    rows = held.select("repo", "extractor", content.alias("contenido")).join(_sources(found, extractors).hint("merge"), ["repo", "extractor"])  # rows are as long as what they list
    every = files.select("repo").distinct().select("repo", F.inline(F.array(*[F.struct(F.lit(e.name).alias("extractor"), F.lit(e.reason).alias("falta")) for e in extractors])))
    out = every.join(rows.hint("merge"), ["repo", "extractor"], "left")
    return out.select("repo", "extractor", "contenido", F.coalesce("fuentes", F.array().cast("array<string>")).alias("fuentes"), F.when(F.col("contenido").isNull(), F.col("falta")).alias("motivo"))


#: The annex's sections (id, point, origin, extractor, obligation), a fixed value.
SECTIONS = (
    ("AIV-1-a", "1.a", "derivada", "version_y_proveedor", None), ("AIV-1-b", "1.b", "humana", None, None), ("AIV-1-c", "1.c", "derivada", "dependencias", None), ("AIV-1-d", "1.d", "humana", None, None),
    ("AIV-1-e", "1.e", "derivada", "computo", None), ("AIV-1-f", "1.f", "humana", None, None), ("AIV-1-g", "1.g", "humana", None, None), ("AIV-1-h", "1.h", "derivada", "instrucciones", None),
    ("AIV-2-a", "2.a", "derivada", "terceros", None), ("AIV-2-b", "2.b", "humana", None, None), ("AIV-2-c", "2.c", "derivada", "arquitectura", None), ("AIV-2-d", "2.d", "derivada", "datos", None),
    ("AIV-2-e", "2.e", "derivada", "control", "AIA-014"), ("AIV-2-f", "2.f", "humana", None, None), ("AIV-2-g", "2.g", "derivada", "control", "AIA-015"), ("AIV-2-h", "2.h", "derivada", "ciberseguridad", None),
    ("AIV-3", "3", "derivada", "control", "AIA-013"), ("AIV-4", "4", "humana", None, None), ("AIV-5", "5", "derivada", "control", "AIA-009"), ("AIV-6", "6", "derivada", "cambios", None),
    ("AIV-7", "7", "humana", None, None), ("AIV-8", "8", "humana", None, None), ("AIV-9", "9", "derivada", "control", "AIA-072"),
)


def sections(found: DataFrame, lines: DataFrame, supplied: DataFrame, spec: Sequence[tuple] = SECTIONS) -> DataFrame:
    """(repo, orden, seccion, punto, procedencia, contenido, fuentes, motivo, texto, firmado_por, fecha): every section of every repository.

    found: what extracted() gives. lines: repo, obligacion, estado, hallazgos, preguntas of a plan: the section of a control is its line's.
    supplied: repo, seccion, texto, firmado_por, fecha, one for each section; what a person wrote completes what was derived and never replaces it.
    """
    kind = "array<struct<orden: int, seccion: string, punto: string, extractor: string, obligacion: string>>"
    rows = F.array(*[F.struct(F.lit(i), F.lit(s), F.lit(p), F.lit(e if o == "derivada" else None), F.lit(ob)) for i, (s, p, o, e, ob) in enumerate(spec)]).cast(kind)
    every = found.select("repo").distinct().select("repo", F.inline(rows))
    checks = lines.select("repo", F.lit("control").alias("extractor"), "obligacion", F.to_json(F.struct("estado", "hallazgos", F.col("preguntas").alias("preguntas_abiertas"))).alias("c"), F.array(F.concat(F.lit("control de "), "obligacion")).alias("f"))
    derived = every.join(found.hint("merge"), ["repo", "extractor"], "left").join(checks, ["repo", "extractor", "obligacion"], "left").join(supplied, ["repo", "seccion"], "left")
    content, given = F.coalesce("contenido", "c"), F.col("texto").isNotNull()
    origin = F.when(content.isNotNull(), F.when(given, "derivada+aportada").otherwise("derivada")).when(given, "aportada").otherwise("ausente")
    reason = F.coalesce("motivo", F.when(F.col("extractor") == "control", F.concat(F.lit("no hay línea del plan de "), "obligacion")), F.lit(PERSON))
    return derived.select("repo", "orden", "seccion", "punto", origin.alias("procedencia"), content.alias("contenido"), F.coalesce("fuentes", "f", F.array().cast("array<string>")).alias("fuentes"), F.when(origin == "ausente", reason).alias("motivo"), "texto", "firmado_por", "fecha")


def document(rows: DataFrame, schema: str = "anexo-iv/v1") -> DataFrame:
    """(repo, documento): one JSON document for each repository, its sections in order, counted by provenance; nothing is cut."""
    each = F.struct("orden", "seccion", "punto", "procedencia", "contenido", F.col("fuentes").alias("de_donde"), "motivo", "texto", "firmado_por", "fecha")
    g = rows.groupBy("repo").agg(F.array_sort(F.collect_list(each)).alias("s"))  # a row for each section
    count = lambda p: F.size(F.filter("s", lambda x: x["procedencia"] == p)).alias(p)
    counts = F.struct(*[count(p) for p in ("derivada", "aportada", "derivada+aportada", "ausente")])
    body = F.transform("s", lambda x: F.struct(*[x[c].alias(c) for c in ("seccion", "punto", "procedencia", "de_donde", "motivo", "texto", "firmado_por", "fecha")], x["contenido"].alias("contenido")))
    return g.select("repo", F.to_json(F.struct(F.lit(schema).alias("esquema"), F.col("repo"), counts.alias("recuento"), F.size("s").alias("total_secciones"), body.alias("secciones")), {"ignoreNullFields": "false"}).alias("documento"))


#: How a provenance reads, and how much of a section a text shows (fixed values).
LABELS = {"derivada": "DERIVADA del codigo", "aportada": "APORTADA por una persona", "derivada+aportada": "DERIVADA del codigo y COMPLETADA por una persona", "ausente": "AUSENTE"}
SHOWN, SOURCES_SHOWN = 1200, 8


def markdown(rows: DataFrame) -> DataFrame:
    """(repo, documento): the sections as Markdown in order; content beyond SHOWN characters is cut, and the text says by how much."""
    label = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[F.col("procedencia")]
    over = F.length("contenido") - SHOWN
    parts = [
        F.concat(F.lit("## "), "punto", F.lit(". "), "seccion"), F.concat(F.lit("*"), label, F.lit("*")),
        F.when(F.size("fuentes") > 0, F.concat(F.lit("Fuentes: "), F.array_join(F.transform(F.slice("fuentes", 1, SOURCES_SHOWN), lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", "))),
        F.when(F.col("contenido").isNotNull(), F.concat(F.lit("```json\n"), F.substring("contenido", 1, SHOWN), F.lit("\n```"))),
        F.when(over > 0, F.concat(F.lit("> Cortado: faltan "), over.cast("string"), F.lit(" caracteres; el JSON los tiene."))),
        F.when(F.col("texto").isNotNull(), F.concat(F.lit("> "), "texto", F.lit("\n> Firmado por "), F.coalesce("firmado_por", F.lit("?")), F.lit(" el "), F.coalesce("fecha", F.lit("?")), F.lit("."))),
        F.when(F.col("motivo").isNotNull(), F.concat(F.lit("**Falta**: "), "motivo")),
    ]
    g = rows.select("repo", F.struct("orden", F.concat_ws("\n", *parts).alias("x")).alias("s")).groupBy("repo").agg(F.array_sort(F.collect_list("s")).alias("s"))  # a row for each section
    return g.select("repo", F.array_join(F.transform("s", lambda s: s["x"]), "\n\n").alias("documento"))
