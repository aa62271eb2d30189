"""Registered queries: each puts an operator to work on the driver's tables, beside its SQL.

documents stand for files (path source/doc_id.lang), events for observations (control user_id, subject a
digest of props, outcome event_type, place event_id), conversations for ordered transitions, lineitem for a
many-to-many bridge, labels for people's answers, nation and region for a hierarchy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatum.functions import text as tx
from probatum.operators import applicability, dossier, evidence, exports, graph, ladders, nonconformity, packs, rules
from probatum.sources import pushes
from probatum.streaming.pushes import decisions_batch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
AS_OF = "2024-01-20 00:00:00"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.concat("source", F.lit("/"), "doc_id", F.lit("."), "lang").alias("path"), F.coalesce("text", F.lit("")).alias("text"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("control_id"), F.sha2(F.coalesce("props", F.lit("")), 256).alias("sujeto_digest"), F.col("event_type").alias("resultado"), F.col("ts").alias("observado_en"), F.col("event_id").alias("n"))


LOG = "(SELECT user_id AS control_id, sha256(coalesce(props, '')) AS sujeto_digest, event_type AS resultado, ts AS observado_en, event_id AS n FROM events)"
FILES = "(SELECT doc_id, source, lang, source || '/' || doc_id || '.' || lang AS path, coalesce(text, '') AS text FROM documents)"

RULES = (
    rules.RuleSpec("R-LICENCIA", "contenido", "media", patterns=("[Ll]icen[sc]e", "copyright")),
    rules.RuleSpec("R-ALEMAN", "contenido", "alta", patterns=(r"\bund\b",), only_in=r"\.de$"),
    rules.RuleSpec("R-NUNCA", "contenido", "alta", patterns=("zzqq0",)),
    rules.RuleSpec("R-SECRETO", "contenido_prohibido", "alta", patterns=(r"AKIA[0-9A-Z]{16}", "password=", 'token = "[0-9a-f]{40}"')),
    rules.RuleSpec("R-FICHERO", "fichero", "alta", patterns=(r"^src1/.*\.fr$",)),
    rules.RuleSpec("R-AMBITO", "contenido", "alta", patterns=("a",), only_in=r"\.pt$"),
)


#: A boundary between Unicode words: the other dialect's boundary is ASCII.
UNICODE_BOUNDARY = {r"\bund\b": r"(^|[^\pL\pN_])und([^\pL\pN_]|$)"}


def _rules_sql() -> str:
    parts = []
    for r in RULES:
        scope = f"regexp_matches(path, '{r.only_in}')" if r.only_in else "TRUE"
        on = "path" if r.kind == "fichero" else "text"
        hit = f"({scope} AND ({' OR '.join(f"regexp_matches({on}, '{UNICODE_BOUNDARY.get(p, p)}')" for p in r.patterns)}))"
        parts.append(f"SELECT '{r.id}' AS regla_id, '{r.kind}' AS tipo, '{r.severity}' AS severidad, count(*) FILTER {hit.replace('(', '(WHERE (', 1)}) AS casan, min(path) FILTER (WHERE {hit}) AS p, count(*) FILTER (WHERE {scope}) AS en_ambito FROM {FILES}")
    return f"""SELECT regla_id, tipo, severidad, casan, en_ambito,
        CASE WHEN tipo <> 'fichero' AND en_ambito = 0 THEN 'no_aplicable' WHEN (tipo <> 'contenido_prohibido') = (casan > 0) THEN 'senal' ELSE 'hallazgo' END AS estado,
        CASE WHEN casan > 0 THEN p ELSE '{rules.WHOLE_REPOSITORY}' END AS localizacion FROM ({' UNION ALL '.join(parts)})"""


@query(_rules_sql())
def rule_content_any(spark, sf_dir):
    return rules.content_rules(files(spark, sf_dir), RULES)


@query(f"SELECT 'R-SECRETO' AS regla_id, 'alta' AS severidad, path AS localizacion FROM {FILES} WHERE regexp_matches(text, 'AKIA[0-9A-Z]{{16}}') OR regexp_matches(text, 'password=') OR regexp_matches(text, 'token = \"[0-9a-f]{{40}}\"')")
def rule_forbidden(spark, sf_dir):
    return rules.forbidden_findings(files(spark, sf_dir), RULES[3])


@query("SELECT min(url) FILTER (WHERE regexp_matches(url, '/fr/')) AS primero, count(*) FILTER (WHERE regexp_matches(url, '/fr/')) AS casan FROM pages")
def rule_file_pattern(spark, sf_dir):
    none = F.lit(None).cast("string")
    pages = table(spark, sf_dir, "pages").select(F.lit("r").alias("repo"), F.col("url").alias("path"), none.alias("text"), none.alias("code"))
    return packs.file_facts(pages, [rules.RuleSpec("R", "fichero", patterns=("/fr/",))]).select("primero", "casan")


@query(f"SELECT path FROM {FILES} f WHERE regexp_matches(text, '@') AND NOT regexp_matches(text, '[0-9]{{12}}')")
def rule_call_without_pair(spark, sf_dir):
    f = files(spark, sf_dir)
    return rules.without_pair(f.where(F.col("text").rlike("@")), f.where(F.col("text").rlike("[0-9]{12}")))


@query(f"SELECT path FROM {FILES} f WHERE regexp_matches(text, '[0-9]{{4}}') AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id AND l.quality = 1)")
def rule_requires_import(spark, sf_dir):
    """Texts with four digits in a row stand for files that call what the rule looks for, good ones for files that import its library."""
    f = files(spark, sf_dir).withColumn("repo", F.col("source"))
    calls = f.where(F.col("text").rlike("[0-9]{4}")).select("repo", "path", F.lit("cliente.modelo.llama").alias("dotted"))
    imports = f.join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi").select("repo", "path", F.lit("lib").alias("module"))
    rule = rules.RuleSpec("R", "llamada", signatures=("modelo.llama", "llama"), requires_import=("lib",))
    return packs.call_files(calls, imports, [rule]).select("path")


@query("""WITH c AS (SELECT page_id AS path, split_part(url, '/', 3) AS dotted FROM pages),
    s AS (SELECT path, dotted, array_to_string(p[i:], '.') AS signature FROM (SELECT path, dotted, string_split(dotted, '.') AS p, unnest(range(1, len(string_split(dotted, '.')) + 1)) AS i FROM c))
    SELECT path, signature, count(*) AS n FROM s WHERE signature IN ('example.net', 'org', 'example.com') GROUP BY ALL""")
def suffix_match_join(spark, sf_dir):
    calls = table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.split_part("url", F.lit("/"), F.lit(3)).alias("dotted"))
    return rules.call_matches(calls, spark.createDataFrame([("example.net",), ("org",), ("example.com",)], "signature string"))


@query("""SELECT lang, t.event_type AS tipo, (SELECT count(*) FROM documents d WHERE d.lang = l.lang AND (CASE WHEN text IS NULL OR text = '' THEN 'vacio' WHEN length(text) < 500 THEN 'corto' WHEN length(text) < 5000 THEN 'medio' ELSE 'largo' END) = t.event_type) AS n
    FROM (SELECT DISTINCT lang FROM documents) l, (SELECT unnest(['vacio', 'corto', 'medio', 'largo']) AS event_type) t""")
def rule_inventory_zero_filled(spark, sf_dir):
    n = F.length("text")
    kinds = files(spark, sf_dir).select("lang", F.when(n == 0, "vacio").when(n < 500, "corto").when(n < 5000, "medio").otherwise("largo").alias("tipo"))
    return rules.zero_filled(kinds, "tipo", ("vacio", "corto", "medio", "largo"), "lang")


@query(f"SELECT source, sha256(string_agg(path || ':' || sha256(text), chr(10) ORDER BY path)) AS sujeto_digest, count(*) AS ficheros FROM {FILES} GROUP BY source")
def subject_digest_by_source(spark, sf_dir):
    return rules.subject_digest(files(spark, sf_dir), "source")


# --- applicability: profiles from customers, obligations from parts -----------------------------------

_TRI = "CASE ({c} % 3) WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END"
_PROFILE = {"fines_militares": "c_custkey % 11 = 0", "solo_investigacion": "c_custkey % 13 = 0", "es_codigo_abierto": _TRI.format(c="(c_custkey // 2)"), "es_alto_riesgo": _TRI.format(c="c_custkey"), "es_sector_publico": _TRI.format(c="(c_custkey // 3)"), "provee_modelo_uso_general": _TRI.format(c="(c_custkey // 5)"), "modelo_con_riesgo_sistemico": _TRI.format(c="(c_custkey // 7)")}
_P_SQL = "SELECT c_custkey AS perfil_id, " + ", ".join(f"{v} AS {k}" for k, v in _PROFILE.items()) + ", CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 'anexo_i' ELSE 'anexo_iii' END AS via_anexo, CASE WHEN c_custkey % 6 = 0 THEN [] WHEN c_custkey % 6 < 4 THEN ['proveedor'] ELSE ['proveedor', 'importador'] END AS roles FROM customer"
_SCOPES = ("todo_sistema", "alto_riesgo", "alto_riesgo_sector_publico", "modelo_uso_general", "modelo_riesgo_sistemico")
_O_SQL = f"SELECT 'AIA-' || lpad(n_nationkey::VARCHAR, 3, '0') AS obligacion_id, [{', '.join(repr(s) for s in _SCOPES)}][(n_nationkey % 5 + 1)::INT] AS alcance, CASE WHEN n_nationkey % 4 = 3 THEN ['importador'] ELSE ['proveedor', 'distribuidor'] END AS roles_obligados, DATE '2026-08-02' AS aplica_desde, n_nationkey % 3 = 0 AS partida FROM nation"


def _profiles(spark, sf_dir):
    exprs = [f"{v.replace('//', 'div')} AS {k}" for k, v in _PROFILE.items()]
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS perfil_id", *exprs, "CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 'anexo_i' ELSE 'anexo_iii' END AS via_anexo", "CASE WHEN c_custkey % 6 = 0 THEN cast(array() AS array<string>) WHEN c_custkey % 6 < 4 THEN array('proveedor') ELSE array('proveedor', 'importador') END AS roles")


def _obligations(spark, sf_dir):
    scopes = ", ".join(f"'{s}'" for s in _SCOPES)
    return table(spark, sf_dir, "nation").selectExpr("concat('AIA-', lpad(cast(n_nationkey AS string), 3, '0')) AS obligacion_id", f"element_at(array({scopes}), cast(n_nationkey % 5 + 1 AS int)) AS alcance", "CASE WHEN n_nationkey % 4 = 3 THEN array('importador') ELSE array('proveedor', 'distribuidor') END AS roles_obligados", "DATE'2026-08-02' AS aplica_desde", "CASE WHEN n_nationkey % 3 = 0 THEN map('anexo_iii', DATE'2027-12-02', 'anexo_i', DATE'2028-08-02') END AS aplica_desde_por_via")


@query(f"""WITH x AS (SELECT *, CASE alcance WHEN 'todo_sistema' THEN true WHEN 'alto_riesgo' THEN es_alto_riesgo WHEN 'alto_riesgo_sector_publico' THEN CASE WHEN es_alto_riesgo IS NULL OR es_sector_publico IS NULL THEN NULL ELSE es_alto_riesgo AND es_sector_publico END
        WHEN 'modelo_uso_general' THEN provee_modelo_uso_general ELSE modelo_con_riesgo_sistemico END AS cubre,
        CASE WHEN partida AND es_alto_riesgo IS TRUE AND via_anexo IS NULL THEN NULL WHEN partida AND es_alto_riesgo IS TRUE THEN CASE via_anexo WHEN 'anexo_i' THEN DATE '2028-08-02' ELSE DATE '2027-12-02' END WHEN partida THEN DATE '2027-12-02' ELSE aplica_desde END AS fecha
        FROM ({_P_SQL}) p, ({_O_SQL}) o),
    y AS (SELECT *, CASE WHEN fines_militares IS TRUE THEN 'EXC-2-3' WHEN solo_investigacion IS TRUE THEN 'EXC-2-6'
        WHEN es_codigo_abierto IS TRUE AND es_alto_riesgo IS FALSE AND obligacion_id NOT IN ('AIA-005', 'AIA-050') THEN 'EXC-2-12'
        WHEN len(roles) = 0 THEN 'ROL-000' WHEN NOT list_has_any(roles, roles_obligados) THEN 'ROL-010' WHEN cubre IS NULL THEN 'ALC-NULL' WHEN NOT cubre THEN 'ALC'
        WHEN fecha IS NULL THEN 'FEC-030' WHEN fecha <= DATE '2027-12-02' THEN 'FEC-010' ELSE 'FEC-020' END AS regla FROM x)
    SELECT perfil_id, obligacion_id, CASE WHEN regla IN ('ROL-000', 'ALC-NULL', 'FEC-030') THEN 'indeterminada' WHEN regla = 'FEC-010' THEN 'ata' WHEN regla = 'FEC-020' THEN 'futura' ELSE 'no_ata' END AS situacion, regla,
        CASE WHEN regla IN ('FEC-010', 'FEC-020') THEN strftime(fecha, '%Y-%m-%d') END AS desde FROM y""")
def applicability_case(spark, sf_dir):
    return applicability.resolve(_profiles(spark, sf_dir), _obligations(spark, sf_dir), "2027-12-02").withColumn("desde", F.col("desde").cast("string"))


@query(f"SELECT perfil_id, CASE WHEN es_alto_riesgo IS NULL OR es_sector_publico IS NULL THEN NULL ELSE es_alto_riesgo AND es_sector_publico END AS ambos FROM ({_P_SQL})")
def strict_null_and(spark, sf_dir):
    return _profiles(spark, sf_dir).select("perfil_id", applicability.strict_and(F.col("es_alto_riesgo"), F.col("es_sector_publico")).alias("ambos"))


@query(f"SELECT perfil_id, obligacion_id FROM ({_P_SQL}) p, ({_O_SQL}) o WHERE list_has_any(roles, roles_obligados)")
def role_overlap_join(spark, sf_dir):
    return applicability.bound_by_role(_profiles(spark, sf_dir), _obligations(spark, sf_dir))


@query("SELECT l_suppkey AS obligacion, l_partkey % 50 AS control, count(DISTINCT l_orderkey) AS lineas FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY ALL")
def crosswalk_both_ways(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    j = l.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    once = j.select(F.col("l_suppkey").alias("obligacion"), (F.col("l_partkey") % 50).alias("control"), "l_orderkey").distinct()
    return once.groupBy("obligacion", "control").agg(F.count("*").alias("lineas"))


# --- evidence ------------------------------------------------------------------------------------------


@query(f"SELECT control_id, sujeto_digest, resultado, n FROM (SELECT *, row_number() OVER (PARTITION BY control_id ORDER BY observado_en DESC, n) AS k FROM {LOG}) WHERE k = 1")
def latest_evidence(spark, sf_dir):
    return evidence.latest(log(spark, sf_dir)).select("control_id", "sujeto_digest", "resultado", "n")


def _states(spark, sf_dir):
    kind = F.col("resultado")
    return evidence.latest(log(spark, sf_dir)).select(
        "control_id", "sujeto_digest", "observado_en", "n",
        F.when(F.col("n") % 17 == 0, "no_fiable").otherwise("valida").alias("estado_declarado"), (F.col("n") % 7 == 0).alias("revocada"), (F.col("control_id") % 10 != 3).alias("confiable"),
        F.when(F.col("control_id") % 5 == 0, F.sha2(F.lit("otro"), 256)).when(F.col("control_id") % 5 == 1, F.col("sujeto_digest")).alias("digest_actual"),
        F.when(kind == "click", F.col("observado_en") + F.expr("interval 1 day")).otherwise(F.lit(None).cast("timestamp_ntz")).alias("revalidado_en"), F.lit(2).alias("frescura_dias"),
    )


_STATES = f"""(SELECT control_id, n, CASE WHEN n % 17 = 0 THEN 'no_fiable' WHEN n % 7 = 0 THEN 'revocada' WHEN control_id % 10 = 3 THEN 'no_fiable' WHEN control_id % 5 = 0 AND sha256('otro') <> sujeto_digest THEN 'superada'
    WHEN TIMESTAMP '{AS_OF}' > (observado_en + CASE WHEN resultado = 'click' THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END) + INTERVAL 2 DAY THEN 'rancia' ELSE 'valida' END AS estado
    FROM (SELECT *, row_number() OVER (PARTITION BY control_id ORDER BY observado_en DESC, n) AS k FROM {LOG}) WHERE k = 1)"""


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


@query(f"SELECT control_id, n, estado FROM {_STATES}")
def evidence_state_as_of(spark, sf_dir):
    return _states(spark, sf_dir).select("control_id", "n", evidence.state(_as_of()).alias("estado"))


@query(f"""SELECT coalesce(s.control_id, e.c_custkey) AS control_id, CASE WHEN s.control_id IS NULL THEN 'sin_evidencia' WHEN e.c_custkey IS NULL AND s.control_id % 5 NOT IN (0, 1) THEN 'fuera_de_alcance' ELSE estado END AS estado,
    CASE CASE WHEN s.control_id IS NULL THEN 'sin_evidencia' WHEN e.c_custkey IS NULL AND s.control_id % 5 NOT IN (0, 1) THEN 'fuera_de_alcance' ELSE estado END WHEN 'valida' THEN 'nada' WHEN 'fuera_de_alcance' THEN 'nada' WHEN 'no_fiable' THEN 'corregir' ELSE 'reobservar' END AS accion
    FROM {_STATES} s FULL JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) e ON e.c_custkey = s.control_id""")
def reconcile_full_outer(spark, sf_dir):
    expected = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("control_id"))
    return evidence.reconcile(_states(spark, sf_dir), expected, _as_of())


@query(f"SELECT CASE estado WHEN 'valida' THEN 'nada' WHEN 'no_fiable' THEN 'corregir' ELSE 'reobservar' END AS accion, estado, count(*) AS n FROM {_STATES} GROUP BY ALL")
def evidence_counts_by_action(spark, sf_dir):
    return evidence.reconcile(_states(spark, sf_dir), None, _as_of()).groupBy("accion", "estado").agg(F.count("*").alias("n"))


@query(f"SELECT control_id, n, CASE WHEN n = min(n) OVER (PARTITION BY control_id, sujeto_digest, resultado) THEN 'observacion' ELSE 'revalidacion' END AS tipo FROM {LOG}")
def revalidation_split(spark, sf_dir):
    return evidence.split_revalidations(log(spark, sf_dir), "control_id", "sujeto_digest", "resultado").select("control_id", "n", "tipo")


@query(f"SELECT control_id % 20 AS grupo, count(*) AS registros, count(*) FILTER (WHERE estado = 'valida') AS validas, CASE WHEN count(*) = count(*) FILTER (WHERE estado = 'valida') THEN 'suficiente' ELSE 'insuficiente' END AS suficiencia, count(*) - count(*) FILTER (WHERE estado = 'valida') AS huecos FROM {_STATES} GROUP BY ALL")
def sufficiency(spark, sf_dir):
    rows = _states(spark, sf_dir).select((F.col("control_id") % 20).alias("grupo"), evidence.state(_as_of()).alias("estado"))
    return evidence.sufficiency(rows, "grupo")


@query("""WITH l AS (SELECT ['maquina', 'generable', 'juzgada', 'organizativa', 'otra'][(user_id % 5 + 1)::INT] AS nivel, ts FROM events), d AS (SELECT *, CASE nivel WHEN 'maquina' THEN 30 WHEN 'generable' THEN 90 WHEN 'juzgada' THEN 180 WHEN 'organizativa' THEN 365 END AS dias FROM l)
    SELECT nivel, dias AS frescura_dias, count(*) AS registros, count(*) FILTER (WHERE ts + to_days(dias::INT) < TIMESTAMP '2024-02-20') AS rancios FROM d GROUP BY nivel, dias""")
def freshness_by_level(spark, sf_dir):
    """How many days each level's evidence lasts, and how much of it has expired; an unknown level never does."""
    names = F.array(*[F.lit(x) for x in ("maquina", "generable", "juzgada", "organizativa", "otra")])
    e = table(spark, sf_dir, "events").select(F.element_at(names, (F.col("user_id") % 5 + 1).cast("int")).alias("nivel"), "ts")
    days = F.try_element_at(F.create_map(*[F.lit(x) for kv in evidence.FRESHNESS.items() for x in kv]), F.col("nivel"))
    due = F.col("ts") + F.make_dt_interval(F.col("frescura_dias"))
    return e.withColumn("frescura_dias", days).groupBy("nivel", "frescura_dias").agg(F.count("*").alias("registros"), F.count_if(due < F.lit("2024-02-20").cast("timestamp_ntz")).alias("rancios"))


_CHAIN = """(SELECT user_id, n, sello_debido, CASE WHEN event_id % 97 = 0 THEN 'x' ELSE sello_debido END AS sello, coalesce(CASE WHEN event_id % 89 = 0 THEN 'y' ELSE lag(CASE WHEN event_id % 97 = 0 THEN 'x' ELSE sello_debido END) OVER (PARTITION BY user_id ORDER BY n) END, 'genesis') AS previo
    FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, sha256(event_id || ':' || props) AS sello_debido FROM events))"""


def _chain(spark, sf_dir):
    return spark.sql("SELECT * FROM " + _CHAIN.replace("sha256(event_id || ':' || props)", "sha2(concat(event_id, ':', props), 256)").replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


@query(f"SELECT user_id, n, (previo <> coalesce(b, 'genesis') OR sello <> sello_debido) AS rota, max((previo <> coalesce(b, 'genesis') OR sello <> sello_debido)::INT) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) = 1 AS tachada FROM (SELECT *, lag(sello) OVER (PARTITION BY user_id ORDER BY n) AS b FROM {_CHAIN})")
def chain_links_broken(spark, sf_dir):
    return evidence.chain_breaks(_chain(spark, sf_dir), "user_id").select("user_id", "n", "rota", "tachada")


@query(f"SELECT user_id, min(n) AS primera, max(n) AS lineas FROM (SELECT *, lag(sello) OVER (PARTITION BY user_id ORDER BY n) AS b FROM {_CHAIN}) WHERE previo <> coalesce(b, 'genesis') OR sello <> sello_debido GROUP BY user_id")
def first_break(spark, sf_dir):
    return evidence.chain_breaks(_chain(spark, sf_dir), "user_id").where("rota").groupBy("user_id").agg(F.min("n").alias("primera"), F.max("n").alias("lineas"))


@query(f"SELECT control_id % 50 AS cliente, count(*) AS vencidas, string_agg(control_id::VARCHAR, ',' ORDER BY control_id) AS controles FROM {_STATES} WHERE estado <> 'valida' GROUP BY ALL HAVING count(*) > 1")
def per_tenant_notice(spark, sf_dir):
    rows = _states(spark, sf_dir).withColumn("estado", evidence.state(_as_of())).where("estado <> 'valida'")
    return rows.groupBy((F.col("control_id") % 50).alias("cliente")).agg(F.count("*").alias("vencidas"), F.array_join(F.array_sort(F.collect_list("control_id")), ",").alias("controles")).where("vencidas > 1")


# --- nonconformities -----------------------------------------------------------------------------------

_TRANS = "(SELECT conv_id, turn, ['abierta', 'en_analisis', 'con_accion', 'ejecutada', 'verificada'][(length(coalesce(text, '')) % 5 + 1)::INT] AS a, CASE WHEN length(coalesce(text, '')) % 3 = 0 THEN NULL ELSE role END AS responsable FROM conversations)"


def _transitions(spark, sf_dir):
    states = F.array(*[F.lit(s) for s in nonconformity.ORDER])
    n = F.length(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.element_at(states, (n % 5 + 1).cast("int")).alias("a"), F.when(n % 3 != 0, F.col("role")).alias("responsable"))


@query(f"SELECT conv_id, turn, ['abierta', 'en_analisis', 'con_accion', 'ejecutada', 'verificada'][max(list_position(['abierta', 'en_analisis', 'con_accion', 'ejecutada', 'verificada'], a)) OVER w] AS estado_nc, last_value(responsable IGNORE NULLS) OVER w AS ult_responsable FROM {_TRANS} WINDOW w AS (PARTITION BY conv_id ORDER BY turn, a ROWS UNBOUNDED PRECEDING)")
def monotone_state_fold(spark, sf_dir):
    return nonconformity.fold(_transitions(spark, sf_dir), "conv_id", "turn", "a", "a", "responsable").select("conv_id", "turn", "estado_nc", "ult_responsable")


@query("SELECT user_id, arg_min(event_type, event_id) AS apertura, floor((epoch_us(TIMESTAMP '2025-06-01 00:00:00') - epoch_us(min(ts))) / 86400000000)::BIGINT AS dias FROM events GROUP BY user_id")
def opening_and_days(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("apertura"), F.min("ts").alias("t"))
    micros = F.unix_micros(F.lit("2025-06-01 00:00:00").cast("timestamp")) - F.unix_micros(F.col("t").cast("timestamp"))
    return e.select("user_id", "apertura", F.floor(micros / F.lit(86_400_000_000)).cast("long").alias("dias"))


# --- ladders -------------------------------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN e = 'fallida' THEN 'error' WHEN e = 'no_aplicable' THEN 'no_aplica' WHEN h > 0 THEN 'con_hallazgos' WHEN s IN ('indeterminada', 'insuficiente') THEN 'indeterminado' WHEN s = 'no_exigible' THEN 'no_aplica' ELSE 'sin_hallazgos' END AS resultado
    FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'fallida' WHEN doc_id % 7 = 0 THEN 'no_aplicable' ELSE 'completa' END AS e, n_chars % 2 AS h, [NULL, 'indeterminada', 'insuficiente', 'no_exigible', 'suficiente'][(doc_id % 5 + 1)::INT] AS s FROM documents)""")
def result_projection(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    e = F.when(F.col("doc_id") % 11 == 0, "fallida").when(F.col("doc_id") % 7 == 0, "no_aplicable").otherwise("completa")
    s = F.element_at(F.array(*[F.lit(x) for x in (None, "indeterminada", "insuficiente", "no_exigible", "suficiente")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select("doc_id", ladders.result(e, F.col("n_chars") % 2, s).alias("resultado"))


@query("""SELECT doc_id, CASE WHEN l.quality IS NULL AND d.n_chars % 4 = 0 THEN 'la_contesta_el_codigo' WHEN d.doc_id % 6 = 0 THEN 'no_procede' WHEN d.doc_id % 6 = 1 AND l.quality IS NULL THEN 'espera_a' WHEN l.quality IS NULL THEN 'pendiente' WHEN l.toxic = 1 THEN 'superada' WHEN l.quality = 0 THEN 'rancia' ELSE 'contestada' END AS estado
    FROM documents d LEFT JOIN labels l USING (doc_id)""")
def question_state(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    condition = F.when(F.col("doc_id") % 6 == 0, "no_procede").when(F.col("doc_id") % 6 == 1, "espera").otherwise("procede")
    state = F.when(F.col("quality").isNull(), None).when(F.col("toxic") == 1, "revocada").when(F.col("quality") == 0, "rancia").otherwise("valida")
    return d.select("doc_id", ladders.question(F.col("n_chars") % 4 == 0, condition, state).alias("estado"))


@query("""SELECT item_id, CASE WHEN text IS NULL OR trim(text) = '' THEN ['sin contestar'] ELSE list_filter([CASE WHEN length(trim(text)) < 150 THEN 'minimo_caracteres' END, CASE WHEN item_id % 2 = 0 AND item_id % 4 = 0 THEN 'exige_justificacion' END, CASE WHEN item_id % 3 = 0 AND NOT regexp_matches(lower(text) || ' ' || CASE WHEN item_id % 4 = 0 THEN '' ELSE 'cada mes' END, 'dia|semana|mes|ano|año|trimestr|day|week|month|year|quarter') THEN 'exige_intervalo' END], lambda x: x IS NOT NULL) END AS motivos FROM benchmark""")
def answer_admissibility(spark, sf_dir):
    i = F.col("item_id")
    why = F.when(i % 4 == 0, "").otherwise("cada mes")
    return table(spark, sf_dir, "benchmark").select("item_id", ladders.admissibility(F.col("text"), why, F.lit(150), i % 2 == 0, i % 3 == 0).alias("motivos"))


@query("""SELECT p_partkey AS control, count(*) FILTER (WHERE l_returnflag = 'R') AS atan, CASE WHEN p_partkey % 9 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'incluido' ELSE 'excluido' END WHEN count(*) FILTER (WHERE l_returnflag = 'R') > 0 THEN 'derivado' WHEN count(*) FILTER (WHERE l_returnflag = 'A') > 0 THEN 'derivado_sin_resolver' ELSE 'pendiente' END AS inclusion FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey""")
def soa_inclusion(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_returnflag") == "A").alias("a"))
    j = table(spark, sf_dir, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left")
    g = j.select(F.col("p_partkey").alias("control"), F.coalesce("r", F.lit(0)).cast("long").alias("atan"), F.coalesce("a", F.lit(0)).alias("abiertas"))
    decision = F.when(F.col("control") % 9 == 0, F.col("control") % 2 == 0)
    return g.select("control", "atan", ladders.inclusion(decision, F.col("atan"), F.col("abiertas")).alias("inclusion"))


@query("""SELECT n_nationkey AS punto, CASE WHEN c.n IS NOT NULL AND s.n IS NOT NULL THEN 'ambos' WHEN c.n IS NOT NULL THEN 'derivado' WHEN s.n IS NOT NULL THEN 'aportado' ELSE 'ausente' END AS procedencia FROM nation
    LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY ALL) c ON c.k = n_nationkey LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY ALL) s ON s.k = n_nationkey""")
def annex_provenance(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("c"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("s"))
    return table(spark, sf_dir, "nation").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").select(F.col("n_nationkey").alias("punto"), ladders.provenance(F.col("c"), F.col("s")).alias("procedencia"))


@query("""SELECT user_id % 30 AS linea, arg_min(f, r) AS mas_fuerte, count(*) FILTER (WHERE f = 'comportamiento') AS comportamiento, count(*) FILTER (WHERE f = 'presencia') AS presencia, count(*) FILTER (WHERE f = 'aportado') AS aportado
    FROM (SELECT user_id, CASE WHEN value > 199 THEN 'comportamiento' WHEN value > 50 THEN 'presencia' ELSE 'aportado' END AS f, CASE WHEN value > 199 THEN 0 WHEN value > 50 THEN 1 ELSE 2 END AS r FROM events) GROUP BY ALL""")
def strongest_signal(spark, sf_dir):
    v = F.col("value")
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 30).alias("linea"), F.when(v > 199, "comportamiento").when(v > 50, "presencia").otherwise("aportado").alias("fuerza"))
    return rules.strongest(e, "linea")


# --- integrity, text, hashes ---------------------------------------------------------------------------


@query("SELECT DISTINCT c_nationkey * 2 AS a FROM customer WHERE c_nationkey * 2 NOT IN (SELECT s_nationkey FROM supplier)")
def dangling_refs(spark, sf_dir):
    """References of which some lead to no supplier's nation."""
    refs = table(spark, sf_dir, "customer").select((F.col("c_nationkey") * 2).alias("a")).distinct()
    return graph.dangling(refs, "a", table(spark, sf_dir, "supplier"), "s_nationkey")


_EDGES = "(SELECT DISTINCT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation UNION SELECT n_nationkey, (n_nationkey + 1) % 25 FROM nation WHERE n_nationkey % 4 = 0)"


def _edges(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"))
    return n.select("a", ((F.col("a") * 7 + 3) % 25).alias("b")).union(n.where("a % 4 = 0").select("a", ((F.col("a") + 1) % 25).alias("b"))).distinct()


@query(f"SELECT a, b FROM {_EDGES} e WHERE NOT EXISTS (SELECT 1 FROM {_EDGES} r WHERE r.a = e.b AND r.b = e.a)")
def asymmetric_edges(spark, sf_dir):
    return graph.asymmetric(_edges(spark, sf_dir))


@query(f"WITH RECURSIVE r AS (SELECT a, b, 1 AS pasos FROM {_EDGES} UNION ALL SELECT r.a, e.b, pasos + 1 FROM r JOIN {_EDGES} e ON e.a = r.b WHERE pasos < 6) SELECT a, b, min(pasos)::INT AS pasos FROM r GROUP BY a, b")
def graph_reachability(spark, sf_dir):
    return graph.reachable(_edges(spark, sf_dir), 6)


#: The documents hold no such secrets; every tenth gets two.
PLANTED = "(SELECT doc_id, text || CASE WHEN doc_id % 10 = 0 THEN ' ghp_abcdefghij0123456789 https://u:p@h/' ELSE '' END AS text FROM documents)"


def _planted(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.when(F.col("doc_id") % 10 == 0, " ghp_abcdefghij0123456789 https://u:p@h/").otherwise("")).alias("text"))


@query("SELECT doc_id, list_transform(" + " || ".join(f"regexp_extract_all(text, '({p})', 1)" for p in tx.SECRETS) + ", lambda x: x[1:12] || '...') AS secretos FROM " + PLANTED + " WHERE " + " OR ".join(f"regexp_matches(text, '{p}')" for p in tx.SECRETS))
def secret_scan(spark, sf_dir):
    return _planted(spark, sf_dir).select("doc_id", tx.find_secrets(F.col("text")).alias("secretos")).where("size(secretos) > 0")


def _redact_sql() -> str:
    out = "text"
    for p in tx.SECRETS:
        out = f"regexp_replace({out}, '{p}', '{tx.REDACTED}', 'g')"
    return out


@query(f"SELECT doc_id, md5({_redact_sql()}) AS huella FROM {PLANTED}")
def secret_redact(spark, sf_dir):
    return _planted(spark, sf_dir).select("doc_id", F.md5(tx.redact_secrets(F.col("text"))).alias("huella"))


@query("SELECT doc_id, md5(replace(replace(CASE WHEN length(text) > 1200 THEN text[1:1200] || ' ...' ELSE text END, '|', '\\|'), chr(10), ' ')) AS celda FROM documents")
def markdown_cell_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.markdown_cell(F.col("text"))).alias("celda"))


@query("SELECT p_partkey, regexp_extract(a, '^(\\d+)', 1)::INT AS numero, regexp_extract(a, '^\\d+(.*)$', 1) AS letra FROM (SELECT p_partkey, (p_partkey % 40)::VARCHAR || ['', 'A', 'B'][(p_partkey % 3 + 1)::INT] AS a FROM part)")
def natural_article_order(spark, sf_dir):
    a = F.concat((F.col("p_partkey") % 40).cast("string"), F.element_at(F.array(F.lit(""), F.lit("A"), F.lit("B")), (F.col("p_partkey") % 3 + 1).cast("int")))
    return table(spark, sf_dir, "part").withColumn("k", tx.article_key(a)).orderBy("k", "p_partkey").select("p_partkey", "k.numero", "k.letra")


@query("SELECT event_id, 'sha256:' || sha256('{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}') AS id FROM events")
def content_ids(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tx.content_id("user_id", "event_type").alias("id"))


@query("SELECT event_id, sha256('\\x00'::BLOB || props::BLOB) AS hoja FROM events")
def merkle_leaves(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tx.merkle_leaf(F.col("props")).alias("hoja"))


@query("SELECT page_id, list_transform(regexp_extract_all(html, '<script>([^<]*)</script>', 1), lambda x: sha256(x)) AS resumenes FROM pages")
def html_inline_hashes(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.inline_hashes(F.col("html"), "script").alias("resumenes"))


@query("SELECT source AS raiz, count(*) AS modulos, count(*) FILTER (WHERE regexp_matches(text, '[0-9]+\\.[0-9]+')) AS fijadas FROM documents GROUP BY source")
def modules_by_root(spark, sf_dir):
    return dossier.modules(files(spark, sf_dir), r"[0-9]+\.[0-9]+")


@query(f"SELECT 'R-SECRETO' AS rule_id, 'error' AS level, path AS uri FROM {FILES} WHERE regexp_matches(text, 'AKIA[0-9A-Z]{{16}}') OR regexp_matches(text, 'password=') OR regexp_matches(text, 'token = \"[0-9a-f]{{40}}\"')")
def sarif_rows(spark, sf_dir):
    found = rules.forbidden_findings(files(spark, sf_dir), RULES[3])
    return found.select(F.col("regla_id").alias("rule_id"), exports.level(F.col("severidad")).alias("level"), F.col("localizacion").alias("uri"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'github' WHEN event_id % 3 = 1 THEN 'gitlab' ELSE 'bitbucket' END AS provider, sha1(event_id::VARCHAR) AS sha, CASE event_id % 3 WHEN 0 THEN event_id % 5 <> 0 WHEN 1 THEN event_id % 2 = 1 ELSE false END AS complete FROM events""")
def push_list_complete(spark, sf_dir):
    sha = F.sha1(F.col("event_id").cast("string").cast("binary"))
    body = (
        F.when(F.col("event_id") % 3 == 0, F.format_string('{"ref":"r","after":"%s","forced":%s,"repository":{"full_name":"a/b"},"commits":[{}]}', sha, (F.col("event_id") % 5 == 0).cast("string")))
        .when(F.col("event_id") % 3 == 1, F.format_string('{"object_kind":"push","checkout_sha":"%s","total_commits_count":%s,"commits":[{}]}', sha, F.when(F.col("event_id") % 2 == 1, "1").otherwise("2")))
        .otherwise(F.format_string('{"push":{"changes":[{"new":{"name":"m","target":{"hash":"%s"}}}]}}', sha))
    )
    return pushes.decode(table(spark, sf_dir, "events").select("event_id", body.alias("body"))).select("event_id", "provider", "sha", "complete")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, sha1((event_id % 50)::VARCHAR) AS sha, sha1(((event_id + 49) % 50)::VARCHAR) AS antes, event_type <> 'purchase' AS inert FROM events),
    s AS (SELECT user_id, k, event_id, sha, 'reobservar' AS decision, sha AS visto, []::VARCHAR[] AS cadena FROM e WHERE k = 1
        UNION ALL SELECT user_id, k, event_id, sha, decision, CASE WHEN decision = 'reobservar' THEN sha ELSE visto END, CASE decision WHEN 'ignorar' THEN list_append(cadena, sha) WHEN 'revalidar' THEN cadena ELSE [] END
        FROM (SELECT e.*, s.visto, s.cadena, CASE WHEN e.sha = s.visto OR list_contains(s.cadena, e.sha) THEN 'revalidar' WHEN len(s.cadena) < 10 AND e.inert AND e.antes = CASE WHEN len(s.cadena) > 0 THEN s.cadena[-1] ELSE s.visto END THEN 'ignorar' ELSE 'reobservar' END AS decision
            FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1))
    SELECT 'repo-' || user_id AS location, 'main' AS ref, event_id AS n, sha, decision, len(cadena)::INT AS chain FROM s""")
def inert_chain(spark, sf_dir):
    """A sequential fold: each decision depends on the one before."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.concat(F.lit("repo-"), "user_id").alias("location"), F.lit("main").alias("ref"), F.col("event_id").alias("n"), F.sha1((F.col("event_id") % 50).cast("string").cast("binary")).alias("sha"), F.sha1(((F.col("event_id") + 49) % 50).cast("string").cast("binary")).alias("before"), (F.col("event_type") != "purchase").alias("inert"))
    return decisions_batch(rows)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_content_any(spark, sf_dir)
