"""Registered queries on rule packs and the plan: every source of documents stands for a repository.

English documents are its Python files, French ones its documentation; every thirteenth can't be read. Calls
and imports are made from ids, as the tables hold no code.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from probatum.operators import packs
from probatum.operators.rules import WHOLE_REPOSITORY, RuleSpec
from probatum.plans.queries import query, table

RULES = (
    RuleSpec("A-LLAMA", "llamada", "alta", pack="uno", obligation="AIA-012", signatures=("m1.f1", "f5"), requires_import=("lib1", "lib2")),
    RuleSpec("A-PAREJA", "llamada_sin_pareja", "alta", pack="uno", obligation="AIA-012", signatures=("f3", "cli.m2.f2"), pair=("g3", "g2"), requires_import=("lib0",)),
    RuleSpec("A-NADIE", "llamada_sin_pareja", "alta", pack="dos", obligation="AIA-012", signatures=("nunca",), pair=("g1",)),
    RuleSpec("B-FICHERO", "fichero", "alta", pack="tres", obligation="AIA-010", patterns=(r"/[0-9]*7\.de$", r"^src3/")),
    RuleSpec("B-CONTENIDO", "contenido", "media", pack="tres", obligation="AIA-010", patterns=("copyright", "licencia"), only_in=r"\.es$"),
    RuleSpec("B-DOCUMENTO", "contenido", "media", pack="tres", obligation="AIA-010", patterns=("xq",), only_in=r"9\.fr$", documentation=True, guarded=True),
    RuleSpec("C-PROHIBIDO", "contenido_prohibido", "alta", pack="cuatro", obligation="AIA-015", patterns=("AKIA[0-9A-Z]{16}", "password=")),
    RuleSpec("C-APORTA", "aportado", "alta", pack="cuatro", obligation="AIA-015", question="que cifra"),
    RuleSpec("D-APORTA", "aportado", "alta", pack="cinco", obligation="AIA-019", question="quien lo guarda"),
    RuleSpec("E-LIMPIA", "contenido_prohibido", "alta", pack="seis", obligation="AIA-014", patterns=("zzqq0",)),
)

_F = """(SELECT source AS repo, source || '/' || doc_id || '.' || CASE lang WHEN 'en' THEN 'py' ELSE lang END AS path, doc_id, CASE WHEN doc_id % 13 <> 0 THEN coalesce(text, '') END AS text,
    CASE WHEN doc_id % 13 <> 0 AND lang <> 'fr' THEN coalesce(text, '') END AS code, CASE WHEN doc_id % 13 = 0 THEN 'no es UTF-8' END AS error, lang FROM documents)"""
_C = f"""(SELECT repo, path, unnest(['cli.m' || (doc_id % 4) || '.f' || (doc_id % 6), 'log.g' || (doc_id % 5)]) AS dotted, 'lib' || (doc_id % 3) AS lib FROM {_F} WHERE lang = 'en' AND error IS NULL)"""


def _tables(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    ok, text = F.col("doc_id") % 13 != 0, F.coalesce("text", F.lit(""))
    path = F.concat("source", F.lit("/"), "doc_id", F.lit("."), F.when(F.col("lang") == "en", "py").otherwise(F.col("lang")))
    files = d.select(F.col("source").alias("repo"), path.alias("path"), "doc_id", F.when(ok, text).alias("text"), F.when(ok & (F.col("lang") != "fr"), text).alias("code"), F.when(~ok, "no es UTF-8").alias("error"), "lang")
    code, i = files.where("lang = 'en' and error is null"), F.col("doc_id")
    dotted = F.array(F.concat(F.lit("cli.m"), i % 4, F.lit(".f"), i % 6), F.concat(F.lit("log.g"), i % 5))
    return files.drop("doc_id", "lang"), code.select("repo", "path", F.explode(dotted).alias("dotted")), code.select("repo", "path", F.concat(F.lit("lib"), i % 3).alias("module"))


def _unreadable(files):
    return files.groupBy("repo").agg(F.count("error").alias("ilegibles"))


def _called(signatures, imports=()):
    """SQL of the files that call one of the signatures."""
    test = " OR ".join(f"dotted = '{s}' OR dotted LIKE '%.{s}'" for s in signatures)
    return f"SELECT DISTINCT repo, path FROM {_C} WHERE ({test})" + (f" AND lib IN ({', '.join(repr(m) for m in imports)})" if imports else "")


def _rule_sql(r: RuleSpec) -> str:
    head = f"'{r.pack}' AS paquete, '{r.obligation}' AS obligacion, '{r.id}' AS regla_id, '{r.kind}' AS tipo, '{r.severity}' AS severidad"
    strength = {"llamada": "comportamiento", "llamada_sin_pareja": "comportamiento", "aportado": "aportado"}.get(r.kind, "presencia")
    asked = f"'{r.question}'" if r.question else "NULL::VARCHAR"
    row = lambda applies, count, where, signal, limit: f"SELECT repo, {head}, {applies} AS aplicable, ({count})::BIGINT AS hallazgos, {where} AS localizacion, {signal} AS senal, {limit} AS limite, {asked} AS pregunta, '{strength}' AS fuerza"
    none = "NULL::VARCHAR"
    if r.kind == "aportado":
        return row("false", "0", none, none, "'falta_aporte'") + f" FROM (SELECT DISTINCT repo FROM {_F})"
    if r.kind == "llamada":
        return row("true", "n", none, "CASE WHEN n = 0 THEN 'ninguna aparicion en ' || py || ' ficheros Python' END", none) + f" FROM (SELECT repo, count(*) FILTER (WHERE lang = 'en' AND error IS NULL) AS py, (SELECT count(*) FROM ({_called(r.signatures, r.requires_import)}) s WHERE s.repo = f.repo) AS n FROM {_F} f GROUP BY repo)"
    if r.kind == "llamada_sin_pareja":
        fires, pairs = _called(r.signatures, r.requires_import), _called(r.pair)
        return row("sites > 0", "lone", none, "CASE WHEN sites > 0 AND lone = 0 THEN 'los ' || sites || ' sitios tienen su pareja en el mismo fichero' END", none) + f" FROM (SELECT repo, (SELECT count(*) FROM ({fires}) s WHERE s.repo = f.repo) AS sites, (SELECT count(*) FROM ({fires}) s WHERE s.repo = f.repo AND s.path NOT IN (SELECT path FROM ({pairs}))) AS lone FROM (SELECT DISTINCT repo FROM {_F}) f)"
    source = "text" if r.documentation else "code"
    scope = f"{source} IS NOT NULL AND regexp_matches(path, '{r.only_in}')" if r.only_in else f"{source} IS NOT NULL"
    hit = f"({scope}) AND (" + " OR ".join(f"regexp_matches({source}, '{p}')" for p in r.patterns) + ")"
    if r.kind == "fichero":
        hit = " OR ".join(f"regexp_matches(path, '{p}')" for p in r.patterns)
    inner = f" FROM (SELECT repo, count(*) FILTER (WHERE {hit}) AS n, min(path) FILTER (WHERE {hit}) AS p, count(*) FILTER (WHERE {scope}) AS e, count({source}) AS leidos FROM {_F} GROUP BY repo)"
    if r.kind == "fichero":
        return row("true", "(n = 0)::INT", f"CASE WHEN n = 0 THEN '{WHOLE_REPOSITORY}' END", "CASE WHEN n > 0 THEN n || ' ficheros casan (' || p || ')' END", none) + inner
    if r.kind == "contenido_prohibido":
        return row("true", "n", none, "CASE WHEN n = 0 THEN 'ninguna aparicion en ' || leidos || ' ficheros' END", none) + inner
    applies = "e > 0" if r.guarded else "true"
    return row(applies, f"({applies} AND n = 0)::INT", f"CASE WHEN {applies} AND n = 0 THEN '{r.only_in or WHOLE_REPOSITORY}' END", f"CASE WHEN {applies} AND n > 0 THEN p END", f"CASE WHEN NOT ({applies}) THEN 'fuera_del_alcance_de_la_regla' END") + inner


_E = "(" + " UNION ALL ".join(_rule_sql(r) for r in RULES) + ")"


@query(f"SELECT * FROM {_E}")
def rule_pack_evaluation(spark, sf_dir):
    return packs.evaluate(*_tables(spark, sf_dir), RULES)


@query(f"""SELECT repo, 'A-LLAMA' AS regla_id, path AS localizacion FROM ({_called(RULES[0].signatures, RULES[0].requires_import)})
    UNION ALL SELECT repo, 'A-PAREJA', path FROM ({_called(RULES[1].signatures, RULES[1].requires_import)}) WHERE path NOT IN (SELECT path FROM ({_called(RULES[1].pair)}))
    UNION ALL SELECT repo, 'C-PROHIBIDO', path FROM {_F} WHERE regexp_matches(code, 'AKIA[0-9A-Z]{{16}}') OR regexp_matches(code, 'password=')""")
def rule_pack_findings(spark, sf_dir):
    return packs.findings(*_tables(spark, sf_dir), RULES)


_O = f"""(SELECT repo, paquete, obligacion, count(*) AS reglas, count(*) FILTER (WHERE aplicable) AS aplicables, sum(hallazgos)::BIGINT AS hallazgos, count(senal) AS senales, count(pregunta) AS preguntas,
    count(senal) FILTER (WHERE fuerza = 'comportamiento') AS comportamiento, count(senal) FILTER (WHERE fuerza = 'presencia') AS presencia, count(senal) FILTER (WHERE fuerza = 'aportado') AS aportado,
    coalesce(list(regla_id ORDER BY regla_id) FILTER (WHERE senal IS NOT NULL), []) AS controles_cubiertos, CASE WHEN count(*) FILTER (WHERE aplicable) = 0 THEN 'no_aplicable' ELSE 'completada' END AS ejecucion,
    count(limite) + 2 + max((SELECT count(*) FROM {_F} f WHERE f.repo = e.repo AND error IS NOT NULL) > 0)::INT AS limites,
    CASE WHEN count(*) FILTER (WHERE aplicable) = 0 THEN 'no_aplica' WHEN sum(hallazgos) > 0 THEN 'con_hallazgos' ELSE 'sin_hallazgos' END AS resultado FROM {_E} e GROUP BY repo, paquete, obligacion)"""


@query(f"SELECT * FROM {_O}")
def pack_outcomes(spark, sf_dir):
    files, calls, imports = _tables(spark, sf_dir)
    return packs.outcomes(packs.evaluate(files, calls, imports, RULES), _unreadable(files))


#: Obligations of the plan with their level, and the situation of a repository by its name's length.
OBLIGATIONS = (("AIA-004", "organizativa"), ("AIA-010", "maquina"), ("AIA-012", "maquina"), ("AIA-014", "maquina"), ("AIA-015", "juzgada"), ("AIA-019", "organizativa"), ("AIA-050", "maquina"))
_V = "(SELECT repo, o.obligacion, o.nivel, CASE WHEN length(repo) = 4 AND o.obligacion = 'AIA-010' THEN 'futura' WHEN repo = 'src1' THEN 'indeterminada' WHEN repo = 'src2' THEN 'no_ata' ELSE 'ata' END AS situacion FROM (SELECT DISTINCT source AS repo FROM documents), (SELECT * FROM (VALUES " + ", ".join(str(x) for x in OBLIGATIONS) + ") t(obligacion, nivel)) o)"
_L = f"""(SELECT repo, obligacion, situacion, CASE situacion WHEN 'no_ata' THEN 'no_ata' WHEN 'indeterminada' THEN 'sin_resolver' WHEN 'futura' THEN 'futura' ELSE
        CASE WHEN n IS NULL THEN CASE WHEN nivel = 'organizativa' THEN 'solo_formulario' ELSE 'a_preguntar' END WHEN h > 0 AND NOT nada THEN 'con_hallazgos' WHEN NOT nada AND q = 0 THEN 'comprobada' ELSE 'a_preguntar' END END AS estado,
    CASE WHEN situacion = 'ata' THEN coalesce(h, 0) ELSE 0 END::BIGINT AS hallazgos, CASE WHEN situacion = 'indeterminada' THEN 1 WHEN situacion <> 'ata' THEN 0 WHEN n IS NULL THEN (nivel <> 'organizativa')::INT ELSE q END::BIGINT AS preguntas,
    CASE WHEN situacion = 'ata' THEN CASE WHEN c > 0 THEN 'comportamiento' WHEN p > 0 THEN 'presencia' END END AS fuerza_maxima, CASE WHEN situacion = 'ata' AND n IS NOT NULL THEN cc ELSE [] END AS controles_cubiertos
    FROM {_V} v LEFT JOIN (SELECT repo, obligacion, count(DISTINCT paquete) AS n, sum(hallazgos) AS h, count(pregunta) AS q, NOT bool_or(aplicable) AS nada, count(senal) FILTER (WHERE fuerza = 'comportamiento') AS c, count(senal) FILTER (WHERE fuerza = 'presencia') AS p,
        coalesce(list(regla_id ORDER BY regla_id) FILTER (WHERE senal IS NOT NULL), []) AS cc FROM {_E} GROUP BY ALL) m USING (repo, obligacion))"""


def _verdicts(files):
    table_ = F.array(*[F.struct(F.lit(o).alias("obligacion"), F.lit(n).alias("nivel")) for o, n in OBLIGATIONS])
    rows = files.select("repo").distinct().select("repo", F.inline(table_))
    state = F.when((F.length("repo") == 4) & (F.col("obligacion") == "AIA-010"), "futura").when(F.col("repo") == "src1", "indeterminada").when(F.col("repo") == "src2", "no_ata").otherwise("ata")
    return rows.withColumn("situacion", state)


def _plan(spark, sf_dir):
    files, calls, imports = _tables(spark, sf_dir)
    evaluated = packs.evaluate(files, calls, imports, RULES)
    return evaluated, packs.plan(_verdicts(files), evaluated, _unreadable(files))


@query(f"SELECT * FROM {_L}")
def plan_lines(spark, sf_dir):
    return _plan(spark, sf_dir)[1]


@query(f"SELECT repo, CASE WHEN sum(hallazgos) > 0 THEN 1 WHEN bool_or(estado IN ('sin_resolver', 'a_preguntar', 'solo_formulario')) THEN 3 ELSE 0 END AS salida FROM {_L} GROUP BY repo")
def plan_exit_codes(spark, sf_dir):
    return packs.exit_codes(_plan(spark, sf_dir)[1])


#: (requirement, obligation, what covers it).
REQUIREMENTS = (("REQ-1", "AIA-010", ()), ("REQ-2", "AIA-010", ("B-FICHERO", "B-CONTENIDO")), ("REQ-3", "AIA-012", ("A-PAREJA",)), ("REQ-4", "AIA-015", ("C-APORTA", "F-2")), ("REQ-5", "AIA-014", ("E-LIMPIA",)), ("REQ-6", "AIA-014", ("F-9", "OTRO")), ("REQ-7", "AIA-050", ("OTRO",)))
_R = "(VALUES " + ", ".join(f"('{a}', '{b}', {list(c)}::VARCHAR[])" for a, b, c in REQUIREMENTS) + ") r(requisito, obligacion, cubierto_por)"


@query(f"""SELECT repo, requisito, CASE WHEN len(cubierto_por) = 0 THEN 'sin_cubrir' WHEN EXISTS (SELECT 1 FROM {_E} e WHERE e.repo = l.repo AND e.obligacion = l.obligacion AND e.hallazgos > 0 AND list_contains(cubierto_por, e.regla_id)) THEN 'con_hallazgos'
    WHEN EXISTS (SELECT 1 FROM {_E} e WHERE e.repo = l.repo AND e.obligacion = l.obligacion AND e.pregunta IS NOT NULL AND list_contains(cubierto_por, e.regla_id)) THEN 'a_preguntar' WHEN list_has_any(cubierto_por, l.controles_cubiertos) THEN 'comprobado'
    WHEN len(list_filter(cubierto_por, lambda x: starts_with(x, 'F-'))) > 0 THEN 'a_preguntar' ELSE 'no_evaluado' END AS estado FROM {_R} JOIN {_L} l USING (obligacion)""")
def plan_requirements(spark, sf_dir):
    evaluated, lines = _plan(spark, sf_dir)
    requirements = spark.createDataFrame([(a, b, list(c)) for a, b, c in REQUIREMENTS], "requisito string, obligacion string, cubierto_por array<string>")
    return packs.requirement_states(requirements, lines, evaluated.where("hallazgos > 0"), evaluated.where("pregunta is not null"))


_S = rf"""(SELECT repo, 'uno' AS paquete, path FROM {_C} WHERE lib IN ('lib0', 'lib1', 'lib2') UNION SELECT repo, 'dos', path FROM {_C}
    UNION SELECT repo, 'tres', path FROM {_F} WHERE regexp_matches(path, '/[0-9]*7\.de$') OR regexp_matches(path, '^src3/') OR (code IS NOT NULL AND regexp_matches(path, '\.es$')) OR (text IS NOT NULL AND regexp_matches(path, '9\.fr$'))
    UNION SELECT repo, 'tres', '(ninguno casa B-FICHERO)' FROM {_F} GROUP BY repo HAVING NOT bool_or(regexp_matches(path, '/[0-9]*7\.de$') OR regexp_matches(path, '^src3/'))
    UNION SELECT repo, unnest(['cuatro', 'seis']), path FROM {_F} WHERE code IS NOT NULL)"""


@query(f"SELECT * FROM {_S}")
def pack_subjects(spark, sf_dir):
    files, _, imports = _tables(spark, sf_dir)
    return packs.subject_files(files, imports, RULES)


@query("""SELECT 'L-' || (p_partkey % 7) AS obligacion, list(por_que || ': ' || que ORDER BY o) AS limites FROM (SELECT p_partkey % 7 AS k, p_partkey % 7 AS p_partkey, por_que, que, min(orden) AS o FROM
    (SELECT p_partkey, p_partkey AS orden, ['no_legible', 'falta_aporte'][(p_partkey % 2 + 1)::INT] AS por_que, p_brand AS que FROM part) GROUP BY ALL) GROUP BY p_partkey""")
def merged_pack_limits(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    why = F.element_at(F.array(F.lit("no_legible"), F.lit("falta_aporte")), (F.col("p_partkey") % 2 + 1).cast("int"))
    return packs.merged_limits(p.select(F.concat(F.lit("L-"), F.col("p_partkey") % 7).alias("obligacion"), F.col("p_partkey").alias("orden"), why.alias("por_que"), F.col("p_brand").alias("que")))


@query("SELECT s_nationkey AS obligacion, list(DISTINCT s_suppkey % 4 ORDER BY s_suppkey % 4) AS paquetes FROM supplier GROUP BY ALL")
def pack_index(spark, sf_dir):
    return packs.pack_index(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("obligacion"), (F.col("s_suppkey") % 4).alias("paquete")))
