"""The catalogue as tables: obligations, forms and rule packs from JSON files, and what is wrong with them as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatum.operators.packs import rule_problems
from probatum.operators.rules import RuleSpec

LANGUAGES = ("es", "en")
#: Levels of an obligation (fixed values).
LEVELS = ("maquina", "generable", "juzgada", "organizativa")
BOTH = "struct<es: string, en: string>"
OBLIGATION = f"id string, articulo string, titulo {BOTH}, nivel string, roles array<string>, alcance string, aplica_desde string, aplica_desde_por_via map<string, string>, comprueba array<string>"
CONTROL = f"id string, titulo {BOTH}, nivel string"
CLAUSE = f"id string, clausula string, titulo {BOTH}, nivel string, exige_informacion_documentada boolean, produce string, depende_de array<string>, formulario string, alimenta array<string>, periodicidad string, vigencia_dias int"
PAIR = "aiact string, iso42001 string"
REQUIREMENT = f"id string, articulo string, apartados array<string>, actores array<string>, nivel string, exige {BOTH}, cubierto_por array<string>, por_que_no_esta_cubierto string"
#: Tables of a catalogue: (file, its list, its columns, what a row must have, texts in both languages), a fixed value.
TABLES = {
    "obligaciones": ("ai-act/obligaciones.json", "obligaciones", OBLIGATION, ("articulo", "nivel", "roles", "alcance", "aplica_desde"), ("titulo",)),
    "requisitos": ("ai-act/requisitos.json", "requisitos", REQUIREMENT, ("articulo", "apartados", "actores", "nivel"), ("exige",)),
    "controles": ("iso42001/anexo-a.json", "controles", CONTROL, ("nivel",), ("titulo",)),
    "clausulas": ("iso42001/clausulas.json", "clausulas", CLAUSE, ("clausula", "nivel", "exige_informacion_documentada"), ("titulo",)),
}
CROSSWALK = "crosswalk.json"
RULE = f"id string, tipo string, version string, severidad string, patrones array<string>, solo_en string, firmas array<string>, pareja array<string>, requiere_import array<string>, ambito string, solo_si_hay_fichero boolean, pregunta {BOTH}, que_busca {BOTH}, remediacion {BOTH}"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files of one JSON document each; one that isn't JSON is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def load(spark: SparkSession, path: str, name: str, row: str) -> DataFrame:
    """The rows of a document's list."""
    element = F.col(name)
    return _read(spark, path, f"{name} array<struct<{_typed(row)}>>").select(F.inline(element))


def _typed(row: str) -> str:
    """A DDL list of columns as the fields of a struct."""
    fields, depth, start = [], 0, 0
    for i, c in enumerate(row + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, _, kind = row[start:i].strip().partition(" ")
            fields.append(f"{name}: {kind}")
            start = i + 1
    return ", ".join(fields)


def load_forms(spark: SparkSession, folder: str) -> DataFrame:
    """(archivo, paquete, preguntas) of each form."""
    rows = _read(spark, folder, "paquete string, preguntas array<struct<id: string, formato: string, destinatario: string>>")
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return rows.select(stem.alias("archivo"), "paquete", "preguntas")


def misnamed(forms: DataFrame) -> DataFrame:
    """Forms whose package isn't the name of their file."""
    return forms.where(~F.col("paquete").eqNullSafe(F.col("archivo")))


def _bilingual(column: str):
    return F.forall(F.array(*[F.col(f"{column}.{x}") for x in LANGUAGES]), lambda t: t.isNotNull() & (F.trim(t) != ""))


def faults(rows: DataFrame, required: tuple[str, ...], texts: tuple[str, ...], closed: dict[str, tuple[str, ...]]) -> DataFrame:
    """(id, problema): missing fields, texts that lack a language, values outside a closed list, ids that repeat."""
    bad = [rows.where(F.col(c).isNull()).select("id", F.lit(c).alias("problema")) for c in ("id", *required)]
    bad += [rows.where(~F.coalesce(_bilingual(c), F.lit(False))).select("id", F.lit(c).alias("problema")) for c in texts]
    bad += [rows.where(F.col(c).isNotNull() & ~F.col(c).isin(*values)).select("id", F.lit(c).alias("problema")) for c, values in closed.items()]
    twice = rows.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repetido").alias("problema"))
    return reduce(DataFrame.unionByName, [*bad, twice])


def load_packs(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, f"paquete string, version string, obligacion string, motor string, reglas array<struct<{_typed(RULE)}>>")


def rule_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Rules whose text of what they look for isn't there in both languages."""
    rows = load_packs(spark, folder).select(F.explode("reglas").alias("r")).select("r.*")
    return faults(rows, ("tipo", "severidad"), ("que_busca",), {})


#: Engines that run packs (fixed values).
ENGINES = ("generico", "agentes", "art50")


def load_rules(spark: SparkSession, folder: str, engine: str | None = "generico") -> list[RuleSpec]:
    """The rules of all packs below a folder, of one engine or, if None, of all; a catalogue of fixed size.

    Rules that lack what their kind needs are an error, and so are packs that name an engine that there isn't.
    """
    out = []
    packs = load_packs(spark, folder).withColumn("motor", F.coalesce("motor", F.lit("generico")))
    for r in packs.select("paquete", F.col("version").alias("v"), "obligacion", "motor", F.explode("reglas").alias("r")).collect():
        x = r.r
        out.append(RuleSpec(x.id, x.tipo or r.motor, x.severidad or "alta", tuple(x.patrones or ()), x.solo_en, tuple(x.firmas or ()), tuple(x.pareja or ()), tuple(x.requiere_import or ()), r.paquete, r.v or "1", r.obligacion, x.ambito == "documentacion", bool(x.solo_si_hay_fichero), x.pregunta.es if x.pregunta else None, r.motor))
    problems = rule_problems(out) + [(p, "motor") for p in sorted({r.pack for r in out if r.engine not in ENGINES})]
    if problems:
        raise ValueError(f"rules that can't be run: {problems}")
    return [r for r in out if engine in (None, r.engine)]


def coverage_gaps(requirements: DataFrame) -> DataFrame:
    """Requirements (id, cubierto_por) that nothing covers."""
    return requirements.where(F.coalesce(F.size("cubierto_por"), F.lit(0)) <= 0)


def load_catalogue(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The catalogue's tables by name, and its crosswalk as pares; clauses without a period hold for a year, controls get their group."""
    out = {name: load(spark, f"{root.rstrip('/')}/{path}", listed, columns) for name, (path, listed, columns, _, _) in TABLES.items()}
    out["controles"] = out["controles"].withColumn("grupo", F.substring_index("id", ".", 2))
    out["clausulas"] = out["clausulas"].withColumn("vigencia_dias", F.coalesce("vigencia_dias", F.lit(365))).withColumn("periodicidad", F.coalesce("periodicidad", F.lit("continua")))
    out["pares"] = load(spark, f"{root.rstrip('/')}/{CROSSWALK}", "pares", PAIR)
    return out


def catalogue_faults(tables: dict[str, DataFrame]) -> DataFrame:
    """(tabla, id, problema) of all tables: those of faults(), requirements that nothing covers and that don't say why, pairs whose sides aren't there."""
    found = [faults(tables[name], required, texts, {"nivel": LEVELS}).withColumn("tabla", F.lit(name)) for name, (_, _, _, required, texts) in TABLES.items()]
    silent = coverage_gaps(tables["requisitos"]).where(F.trim(F.coalesce("por_que_no_esta_cubierto", F.lit(""))) == "")
    found.append(silent.select("id", F.lit("sin_cubrir_y_sin_motivo").alias("problema"), F.lit("requisitos").alias("tabla")))
    for side, name in (("aiact", "obligaciones"), ("iso42001", "controles")):
        known = tables[name].select(F.col("id").alias(side)).distinct()
        lost = tables["pares"].where(F.col(side).isNull()).unionByName(tables["pares"].where(F.col(side).isNotNull()).join(known, side, "left_anti"), allowMissingColumns=True)
        found.append(lost.select(F.concat_ws("-", F.coalesce("aiact", F.lit("?")), F.coalesce("iso42001", F.lit("?"))).alias("id"), F.lit(side).alias("problema"), F.lit("pares").alias("tabla")))
    fed = tables["clausulas"].select("id", F.explode("alimenta").alias("a"))
    lost = fed.join(tables["clausulas"].select(F.col("id").alias("a")).distinct(), "a", "left_anti")
    found.append(lost.select("id", F.lit("alimenta").alias("problema"), F.lit("clausulas").alias("tabla")))
    return reduce(DataFrame.unionByName, found).select("tabla", "id", "problema")


def unlabelled(values: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Values (valor) without an entry (valor, es, en) in both languages."""
    known = vocabulary.where("es is not null and en is not null").select("valor")
    return values.select("valor").distinct().join(known, "valor", "left_anti")
