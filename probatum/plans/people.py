"""Registered queries on what people answer, append and decide: questionnaires, the log, nonconformities, dossiers.

parts stand for questions, lineitems for answers, events for log lines and structure rows, conversations for transitions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from probatum.functions import text as tx
from probatum.operators import applicability, controls, dossier, evidence, nonconformity, questionnaire
from probatum.plans import queries
from probatum.plans.queries import query, table


def _pick(expr, *names):
    """The expr-th of some words, counted from 0."""
    return F.element_at(F.array(*[F.lit(x) for x in names]), (expr + 1).cast("int"))


@query(queries.ORACLE["applicability_case"])
def applicability_by_table(spark, sf_dir):
    """The decision table against the SQL of the ladder."""
    return applicability.resolve_by_table(queries._profiles(spark, sf_dir), queries._obligations(spark, sf_dir), "2027-12-02").withColumn("desde", F.col("desde").cast("string"))


# --- the log -------------------------------------------------------------------------------------------

_K = "(SELECT event_id, 'C' || (user_id % 50) AS control_id, event_type AS sujeto_digest, 'v' || (event_id % 5) AS contenido, 'T' || lpad(event_id::VARCHAR, 9, '0') AS cuando, sha256('C' || (user_id % 50) || chr(31) || event_type || chr(31) || 'v' || (event_id % 5)) AS clave FROM events)"


def _lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.concat(F.lit("C"), F.col("user_id") % 50).alias("control_id"), F.col("event_type").alias("sujeto_digest"), F.concat(F.lit("v"), F.col("event_id") % 5).alias("contenido"), F.concat(F.lit("T"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("cuando"))


@query(f"""WITH k AS {_K}, l AS (SELECT clave, arg_max('R' || event_id, event_id) AS ya FROM k WHERE event_id % 4 <> 0 AND user_id_ok GROUP BY clave), b AS (SELECT *, min(event_id) OVER (PARTITION BY clave) AS primera, arg_min(cuando, event_id) OVER (PARTITION BY clave) AS c1 FROM k WHERE event_id % 4 = 0)
    SELECT event_id + 1000000 AS n, CASE WHEN ya IS NULL AND event_id = primera THEN 'observacion' ELSE 'revalidacion' END AS tipo, coalesce(ya, 'sha256:' || sha256(clave || chr(31) || c1)) AS registro_id, control_id, sujeto_digest, contenido, cuando
    FROM b LEFT JOIN l USING (clave)""".replace("user_id_ok", "event_id % 3 = 0"))
def evidence_append(spark, sf_dir):
    """A third of the lines are in the log already; a quarter is appended."""
    lines = _lines(spark, sf_dir)
    log = lines.where("event_id % 4 <> 0 and event_id % 3 = 0").select(F.col("event_id").alias("n"), F.lit("observacion").alias("tipo"), F.concat(F.lit("R"), "event_id").alias("registro_id"), "control_id", "sujeto_digest", "contenido", "cuando")
    return evidence.append(log, lines.where("event_id % 4 = 0").withColumnRenamed("event_id", "orden"), 1_000_000)


def _log(spark, sf_dir):
    """Of four lines two observe, the third sees one of them again, every second fourth one revokes the other."""
    i = F.col("event_id")
    kind = F.when(i % 4 < 2, "observacion").when(i % 4 == 2, "revalidacion").when(i % 8 == 3, "revocacion")
    rows = _lines(spark, sf_dir).withColumn("tipo", kind).where("tipo is not null").withColumn("registro_id", F.concat(F.lit("R"), F.when(i % 4 == 2, i - 2).when(i % 4 == 3, i - 2).otherwise(i)))
    return rows.withColumnRenamed("event_id", "n")


_LOG = f"(SELECT *, CASE WHEN event_id % 4 < 2 THEN 'observacion' WHEN event_id % 4 = 2 THEN 'revalidacion' WHEN event_id % 8 = 3 THEN 'revocacion' END AS tipo, 'R' || CASE WHEN event_id % 4 >= 2 THEN event_id - 2 ELSE event_id END AS registro_id FROM {_K})"


@query(f"SELECT o.registro_id, o.cuando AS observado_en, (SELECT max(cuando) FROM {_LOG} r WHERE r.tipo = 'revalidacion' AND r.registro_id = o.registro_id) AS revalidado_en, EXISTS (SELECT 1 FROM {_LOG} r WHERE r.tipo = 'revocacion' AND r.registro_id = o.registro_id) AS revocada FROM {_LOG} o WHERE tipo = 'observacion'")
def evidence_records(spark, sf_dir):
    return evidence.records_of(_log(spark, sf_dir)).select("registro_id", "observado_en", "revalidado_en", "revocada")


@query(f"SELECT count(*) AS lineas, count(*) FILTER (WHERE tipo = 'observacion') AS registros, count(DISTINCT control_id) FILTER (WHERE tipo = 'observacion') AS controles, count(DISTINCT sujeto_digest) FILTER (WHERE tipo = 'observacion') AS sujetos FROM {_LOG} WHERE tipo IS NOT NULL")
def evidence_log_counts(spark, sf_dir):
    return evidence.log_counts(_log(spark, sf_dir))


@query(f"SELECT 1000000 + event_id AS n, 'revocacion' AS tipo, 'R' || event_id AS registro_id, event_type AS motivo, 'U' || user_id AS quien, 'T' || lpad(event_id::VARCHAR, 9, '0') AS cuando FROM {_LOG} JOIN events USING (event_id) WHERE event_id % 12 = 0")
def evidence_revoke(spark, sf_dir):
    asked = table(spark, sf_dir, "events").where("event_id % 12 = 0").select(F.concat(F.lit("R"), "event_id").alias("registro_id"), F.col("event_type").alias("motivo"), F.concat(F.lit("U"), "user_id").alias("quien"), F.concat(F.lit("T"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("cuando"), F.col("event_id").alias("orden"))
    return evidence.revoke(_log(spark, sf_dir), asked, 1_000_000)


@query("SELECT count(*) FILTER (WHERE estado = 'valida') AS con_evidencia, count(*) FILTER (WHERE estado NOT IN ('valida', 'no_fiable', 'fuera_de_alcance')) AS a_reobservar FROM (" + queries.ORACLE["reconcile_full_outer"] + ")")
def evidence_work_saved(spark, sf_dir):
    return evidence.work_saved(queries.reconcile_full_outer(spark, sf_dir))


_SEALS = """(SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, sha256(event_id::VARCHAR) AS sello_debido, CASE WHEN event_id % 53 <> 0 THEN CASE WHEN event_id % 71 = 0 THEN 'x' ELSE sha256(event_id::VARCHAR) END END AS sello, event_id FROM events)"""
_LINKED = f"(SELECT user_id, n, sello_debido, sello, CASE WHEN event_id % 59 <> 0 THEN CASE WHEN n = 1 THEN 'genesis' ELSE lag(sello) OVER (PARTITION BY user_id ORDER BY n) END END AS previo FROM {_SEALS})"


@query(f"""WITH c AS (SELECT *, lag(sello) OVER (PARTITION BY user_id ORDER BY n) AS antes FROM {_LINKED}), r AS (SELECT user_id, n, (sello IS NULL OR sello <> sello_debido OR previo IS NULL OR CASE WHEN n = 1 THEN previo <> 'genesis' ELSE antes IS NULL OR previo <> antes END) AS rota FROM c)
    SELECT user_id, n, rota, max(rota::INT) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) = 1 AS tachada FROM r""")
def chain_breaks_of_stripped_lines(spark, sf_dir):
    """Lines without a seal or a predecessor are breaks, and taint what follows."""
    rows = spark.sql("SELECT * FROM " + _LINKED.replace("sha256(event_id::VARCHAR)", "sha2(cast(event_id AS string), 256)").replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
    return evidence.chain_breaks(rows, "user_id").select("user_id", "n", "rota", "tachada")


_W = """(SELECT user_id % 200 AS control_id, event_id AS n, ts, 'd' || (event_id % 3) AS sujeto_digest, CASE WHEN event_id % 4 < 2 THEN 'observacion' WHEN event_id % 4 = 2 THEN 'revalidacion' WHEN event_id % 8 = 3 THEN 'revocacion' END AS tipo,
    'R' || CASE WHEN event_id % 4 >= 2 THEN event_id - 2 ELSE event_id END AS registro_id, event_id % 13 <> 0 AS confiable FROM events)"""
_WATCH = f"""(WITH o AS (SELECT *, row_number() OVER (PARTITION BY control_id ORDER BY ts DESC, n) AS f FROM {_W} WHERE tipo = 'observacion'),
    x AS (SELECT o.*, (SELECT max(ts) FROM {_W} v WHERE v.tipo = 'revalidacion' AND v.registro_id = o.registro_id) AS de_nuevo, EXISTS (SELECT 1 FROM {_W} v WHERE v.tipo = 'revocacion' AND v.registro_id = o.registro_id) AS revocada FROM o WHERE f = 1),
    s AS (SELECT control_id, CASE WHEN control_id % 5 <> 0 THEN 'd' || (control_id % 3) END AS hoy, CASE WHEN revocada THEN 'revocada' WHEN NOT confiable THEN 'no_fiable' WHEN control_id % 5 <> 0 AND 'd' || (control_id % 3) <> sujeto_digest THEN 'superada'
        WHEN TIMESTAMP '2024-02-10' > greatest(ts, coalesce(de_nuevo, ts)) + INTERVAL 30 DAY THEN 'rancia' ELSE 'valida' END AS e FROM x),
    w AS (SELECT coalesce(s.control_id, k.k) AS control_id, CASE WHEN s.control_id IS NULL THEN 'sin_evidencia' WHEN k.k IS NULL AND hoy IS NULL THEN 'fuera_de_alcance' ELSE e END AS estado FROM s FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey < 250) k ON k.k = s.control_id)
    SELECT control_id, estado, CASE estado WHEN 'valida' THEN 'nada' WHEN 'fuera_de_alcance' THEN 'nada' WHEN 'no_fiable' THEN 'corregir' ELSE 'reobservar' END AS accion FROM w)"""


@query(f"SELECT * FROM {_WATCH}")
def watch_controls(spark, sf_dir):
    """From log rows to verdicts: records, their latest, today's digests, what was expected."""
    i = F.col("event_id")
    kind = F.when(i % 4 < 2, "observacion").when(i % 4 == 2, "revalidacion").when(i % 8 == 3, "revocacion")
    log = table(spark, sf_dir, "events").select((F.col("user_id") % 200).alias("control_id"), i.alias("n"), F.col("ts").cast("timestamp_ntz").alias("cuando"), F.concat(F.lit("d"), i % 3).alias("sujeto_digest"), kind.alias("tipo"), F.concat(F.lit("R"), F.when(i % 4 >= 2, i - 2).otherwise(i)).alias("registro_id"), (i % 13 != 0).alias("confiable"), F.lit("valida").alias("estado_declarado"), F.lit(30).alias("frescura_dias")).where("tipo is not null")
    current = log.select("control_id").distinct().where("control_id % 5 <> 0").select("control_id", F.concat(F.lit("d"), F.col("control_id") % 3).alias("digest_actual"))
    expected = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0 and c_custkey < 250").select(F.col("c_custkey").alias("control_id"))
    return evidence.watch(log, current, expected, F.lit("2024-02-10").cast("timestamp_ntz"))


# --- questionnaires ------------------------------------------------------------------------------------

_Q = """(SELECT p_partkey AS k, 'Q' || p_partkey AS id, 'F-' || (p_partkey % 4) AS paquete, p_size AS posicion, ['tecnico', 'direccion', 'responsable'][(p_partkey % 3 + 1)::INT] AS destinatario, ['texto', 'si_no', 'lista', 'eleccion'][(p_partkey % 4 + 1)::INT] AS formato, p_name AS texto,
    CASE WHEN p_partkey % 4 = 3 THEN ['A', 'N', 'R'] ELSE [] END AS opciones, CASE WHEN p_partkey % 5 = 0 THEN 'Q' || (p_partkey - p_partkey % 10 + 1) END AS si_pregunta, ['vale', 'distinto_de', 'contiene'][(p_partkey % 3 + 1)::INT] AS operador, ['A', 'N', 'R'][(p_partkey % 3 + 1)::INT] AS si_valor,
    CASE WHEN p_partkey % 7 = 0 THEN ['C' || (p_partkey % 11), 'C99'] ELSE [] END AS salta FROM part)"""


def _questions(spark, sf_dir):
    k = F.col("p_partkey")
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "part").select(
        k, F.concat(F.lit("Q"), k).alias("id"), F.concat(F.lit("F-"), k % 4).alias("paquete"), F.col("p_size").alias("posicion"), _pick(k % 3, "tecnico", "direccion", "responsable").alias("destinatario"),
        _pick(k % 4, "texto", "si_no", "lista", "eleccion").alias("formato"), F.col("p_name").alias("texto"), F.when(k % 4 == 3, F.array(*[F.lit(x) for x in "ANR"])).otherwise(none).alias("opciones"),
        F.create_map(F.lit("minimo_caracteres"), (k % 9).cast("string"), F.lit("exige_justificacion"), F.when(k % 2 == 0, "true").otherwise("false")).alias("exige"),
        F.when(k % 5 == 0, F.struct(F.concat(F.lit("Q"), k - k % 10 + 1).alias("pregunta"), _pick(k % 3, "vale", "distinto_de", "contiene").alias("operador"), _pick(k % 3, *"ANR").alias("valor"))).alias("si"),
        F.when(k % 7 == 0, F.array(F.concat(F.lit("C"), k % 11), F.lit("C99"))).otherwise(none).alias("salta_si_cubre"),
        F.array(F.concat(F.lit("S"), k % 30), F.concat(F.lit("N"), k % 25), F.concat(F.lit("R"), k % 7)).alias("sirve_a"), F.lit(900).alias("vigencia_dias"),
    )


_A = "(SELECT 'Q' || l_partkey AS pregunta, l_partkey AS k, CASE WHEN l_linenumber % 2 = 0 THEN [l_returnflag, 'B'] ELSE [l_returnflag] END AS valor, l_shipdate AS cuando, l_orderkey * 10 + l_linenumber AS n, l_suppkey % 9 = 0 AS revocada, l_suppkey % 4 <> 0 AS confiable, l_suppkey % 7 <> 0 AS igual FROM lineitem WHERE l_partkey % 6 <> 0)"
_LAST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pregunta ORDER BY cuando DESC, n) AS f FROM {_A}) WHERE f = 1)"


def _answers(spark, sf_dir, questions):
    a = table(spark, sf_dir, "lineitem").where("l_partkey % 6 <> 0")
    s = F.col("l_suppkey")
    prints = questions.select(F.col("p_partkey").alias("l_partkey"), questionnaire.fingerprint().alias("due"))
    value = F.when(F.col("l_linenumber") % 2 == 0, F.array("l_returnflag", F.lit("B"))).otherwise(F.array("l_returnflag"))
    return a.join(prints, "l_partkey").select(F.concat(F.lit("Q"), "l_partkey").alias("pregunta"), value.alias("valor"), F.col("l_shipdate").alias("cuando"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"), (s % 9 == 0).alias("revocada"), (s % 4 != 0).alias("confiable"), F.when(s % 7 != 0, F.col("due")).otherwise("otra").alias("huella"))


_STATE = f"""(SELECT q.id, q.paquete, q.posicion, q.destinatario, cub, a.valor, si_pregunta, CASE WHEN cub IS NOT NULL AND a.n IS NULL THEN 'la_contesta_el_codigo' WHEN si_pregunta IS NOT NULL AND g.n IS NOT NULL AND NOT CASE operador WHEN 'distinto_de' THEN len(list_filter(g.valor, lambda x: x <> si_valor)) > 0 ELSE list_contains(g.valor, si_valor) END THEN 'no_procede'
    WHEN si_pregunta IS NOT NULL AND g.n IS NULL AND a.n IS NULL THEN 'espera_a' WHEN a.n IS NULL THEN 'pendiente' WHEN a.revocada THEN 'superada' WHEN NOT a.confiable THEN 'no_fiable' WHEN NOT a.igual THEN 'superada' WHEN TIMESTAMP '2000-01-01' > a.cuando + INTERVAL 900 DAY THEN 'rancia' ELSE 'contestada' END AS estado
    FROM (SELECT *, CASE WHEN k % 7 = 0 AND k % 11 < 5 THEN ['C' || (k % 11)] END AS cub FROM {_Q}) q LEFT JOIN {_LAST} a ON a.pregunta = q.id LEFT JOIN {_LAST} g ON g.pregunta = q.si_pregunta)"""


def _states(spark, sf_dir):
    questions = _questions(spark, sf_dir)
    covered = spark.createDataFrame([(f"C{k}",) for k in range(5)], "control_id string")
    return questionnaire.states(questions, _answers(spark, sf_dir, questions), covered, F.lit("2000-01-01").cast("timestamp_ntz"))


@query(f"SELECT id, paquete, posicion, destinatario, estado, CASE WHEN estado IN ('no_procede', 'espera_a') THEN si_pregunta END AS depende_de, CASE WHEN estado = 'la_contesta_el_codigo' THEN cub END AS cubierta_por, CASE WHEN estado = 'contestada' THEN valor END AS valor FROM {_STATE}")
def questionnaire_states(spark, sf_dir):
    return _states(spark, sf_dir)


@query(f"SELECT count(*) FILTER (WHERE estado = 'la_contesta_el_codigo') AS preguntas, coalesce(list_sort(list_distinct(flatten(list(cub) FILTER (WHERE estado = 'la_contesta_el_codigo')))), []) AS controles FROM {_STATE}")
def questionnaire_savings(spark, sf_dir):
    return questionnaire.savings(_states(spark, sf_dir))


@query(f"SELECT paquete, list(id ORDER BY posicion, id) AS preguntas FROM {_Q} GROUP BY paquete")
def questionnaire_packages(spark, sf_dir):
    return questionnaire.packages(_states(spark, sf_dir))


@query(f"SELECT id, estado FROM {_STATE} WHERE estado IN ('pendiente', 'rancia', 'superada', 'no_fiable') AND destinatario IN ('tecnico', 'direccion')")
def questionnaire_pending(spark, sf_dir):
    return questionnaire.pending(_states(spark, sf_dir), "tecnico", "direccion").select("id", "estado")


@query("""SELECT 'Q' || p_partkey AS id, sirve, CASE WHEN sirve IN (SELECT 'S' || s_suppkey FROM supplier) THEN 'articulo' WHEN sirve IN (SELECT 'N' || n_nationkey FROM nation) THEN 'clausula' ELSE 'anexo_a' END AS marco
    FROM (SELECT p_partkey, unnest(['S' || (p_partkey % 30), 'N' || (p_partkey % 25), 'R' || (p_partkey % 7)]) AS sirve FROM part) WHERE sirve IN (SELECT 'S' || s_suppkey FROM supplier UNION SELECT 'N' || n_nationkey FROM nation UNION SELECT 'R' || r_regionkey FROM region UNION SELECT 'S1')""")
def question_serves(spark, sf_dir):
    ids = lambda t, k, p: table(spark, sf_dir, t).select(F.concat(F.lit(p), k).alias("id"))
    both = ids("region", "r_regionkey", "R").unionByName(spark.createDataFrame([("S1",)], "id string"))
    return questionnaire.serves(_questions(spark, sf_dir), ids("supplier", "s_suppkey", "S"), ids("nation", "n_nationkey", "N"), both)


@query(f"SELECT id, 'sha256:' || sha256(id || chr(30) || texto || chr(30) || formato || chr(30) || array_to_string(opciones, chr(31)) || chr(30) || 'exige_justificacion=' || (k % 2 = 0)::VARCHAR || chr(31) || 'minimo_caracteres=' || (k % 9)) AS huella FROM {_Q}")
def question_fingerprints(spark, sf_dir):
    return _questions(spark, sf_dir).select("id", questionnaire.fingerprint().alias("huella"))


_FORM = """(SELECT p_partkey AS k, ['texto', 'si_no', 'fecha', 'lista', 'eleccion'][(p_partkey % 5 + 1)::INT] AS formato, CASE WHEN p_partkey % 13 = 0 THEN [] WHEN p_partkey % 3 = 0 THEN [p_name] WHEN p_partkey % 3 = 1 THEN [p_type, p_brand] ELSE ['A', 'B', 'nada'] END AS valor, CASE WHEN p_partkey % 3 = 0 THEN 'texto' ELSE 'lista' END AS tipo,
    CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN 'cada dos meses' END AS justificacion FROM part)"""


@query(f"""SELECT k, CASE WHEN len(valor) = 0 THEN ['sin contestar'] ELSE list_filter([CASE WHEN formato = 'si_no' THEN 'si_no' END, CASE WHEN formato = 'fecha' AND tipo <> 'texto' THEN 'fecha' END, CASE WHEN formato IN ('lista', 'eleccion') AND tipo <> 'lista' THEN 'lista' END,
    CASE WHEN formato = 'eleccion' AND tipo = 'lista' AND k % 3 = 1 THEN 'opcion' END, CASE WHEN formato = 'eleccion' AND k % 3 = 2 THEN 'excluyente' END, CASE WHEN k % 2 = 0 AND list_sum(list_transform(valor, lambda x: length(trim(x)))) < 20 THEN 'minimo_caracteres' END,
    CASE WHEN tipo = 'lista' AND len(valor) < 3 THEN 'minimo_elementos' END, CASE WHEN k % 6 = 0 AND trim(coalesce(justificacion, '')) = '' THEN 'exige_justificacion' END, CASE WHEN k % 7 = 0 AND NOT regexp_matches(lower(array_to_string(valor, ' ')) || ' ' || lower(coalesce(justificacion, '')), 'dia|semana|mes|ano|año|trimestr|day|week|month|year|quarter') THEN 'exige_intervalo' END], lambda x: x IS NOT NULL) END AS motivos FROM {_FORM}""")
def answer_forms(spark, sf_dir):
    k = F.col("p_partkey")
    value = F.when(k % 13 == 0, F.array().cast("array<string>")).when(k % 3 == 0, F.array("p_name")).when(k % 3 == 1, F.array("p_type", "p_brand")).otherwise(F.array(*[F.lit(x) for x in ("A", "B", "nada")]))
    asks = {"excluyente": F.lit("nada"), "minimo_elementos": F.lit("3"), "minimo_caracteres": F.when(k % 2 == 0, "20").otherwise("0"), "exige_justificacion": (k % 6 == 0).cast("string"), "exige_intervalo": (k % 7 == 0).cast("string")}
    rows = table(spark, sf_dir, "part").select(
        k.alias("k"), _pick(k % 5, "texto", "si_no", "fecha", "lista", "eleccion").alias("formato"), value.alias("valor"), F.when(k % 3 == 0, "texto").otherwise("lista").alias("tipo"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, "cada dos meses").alias("justificacion"), F.array(*[F.lit(x) for x in ("A", "B", "nada")]).alias("opciones"), F.create_map(*[x for a, b in asks.items() for x in (F.lit(a), b)]).alias("exige"),
    )
    return rows.select("k", questionnaire.admissibility().alias("motivos"))


# --- nonconformities -----------------------------------------------------------------------------------

_T = """(SELECT conv_id AS no_conformidad_id, turn AS n, ['abierta', 'en_analisis', 'con_accion', 'ejecutada', 'verificada'][(length(coalesce(text, '')) % 5 + 1)::INT] AS a, TIMESTAMP '2024-01-01' + to_hours((conv_id * 7 + turn * 400 + length(coalesce(text, '')) % 50)::INT) AS cuando,
    CASE WHEN length(coalesce(text, '')) % 4 = 0 THEN 'causa' END AS causa_raiz, CASE WHEN length(coalesce(text, '')) % 3 = 0 THEN role END AS accion, CASE WHEN length(coalesce(text, '')) % 6 = 0 THEN DATE '2024-01-01' + (turn * 20)::INT END AS compromiso FROM conversations)"""


def _transitions(spark, sf_dir):
    n = F.length(F.coalesce("text", F.lit("")))
    hours = (F.col("conv_id") * 7 + F.col("turn") * 400 + n % 50).cast("int")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("no_conformidad_id"), F.col("turn").alias("n"), F.element_at(F.array(*[F.lit(s) for s in nonconformity.ORDER]), (n % 5 + 1).cast("int")).alias("a"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hours)).alias("cuando"), F.when(n % 4 == 0, "causa").alias("causa_raiz"), F.when(n % 3 == 0, F.col("role")).alias("accion"),
        F.when(n % 6 == 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("turn") * 20).cast("int"))).alias("compromiso"),
    )


_NOW = "TIMESTAMP '2024-06-01'"
_H = f"""(WITH g AS (SELECT no_conformidad_id, max(list_position(['abierta', 'en_analisis', 'con_accion', 'ejecutada', 'verificada'], a)) AS r, min(cuando) AS t0, max(cuando) AS t1, last(causa_raiz ORDER BY cuando, n) FILTER (WHERE causa_raiz IS NOT NULL) AS causa, last(accion ORDER BY cuando, n) FILTER (WHERE accion IS NOT NULL) AS accion,
        last(compromiso ORDER BY cuando, n) FILTER (WHERE compromiso IS NOT NULL) AS comp, max(cuando) FILTER (WHERE a = 'ejecutada') AS e, min(cuando) FILTER (WHERE a = 'verificada') AS v FROM {_T} GROUP BY 1),
    d AS (SELECT *, floor((epoch_us(CASE WHEN r = 5 THEN t1 ELSE {_NOW} END) - epoch_us(t0)) / 86400000000)::BIGINT AS dias FROM g)
    SELECT no_conformidad_id, ['abierta', 'en_analisis', 'con_accion', 'ejecutada', 'verificada'][r] AS estado_nc, dias, r < 5 AND coalesce(comp < DATE '2024-06-01', false) AS vencida, r < 5 AND comp IS NULL AND dias > 90 AS estancada,
    list_filter([CASE WHEN r = 5 AND e IS NULL THEN 'sin_ejecucion' END, CASE WHEN r = 5 AND (causa IS NULL OR accion IS NULL) THEN 'sin_causa_o_accion' END, CASE WHEN r = 5 AND v < e THEN 'antes_de_ejecutar' END], lambda x: x IS NOT NULL) AS incoherencias FROM d)"""


def _histories(spark, sf_dir):
    return nonconformity.history(_transitions(spark, sf_dir), F.lit("2024-06-01").cast("timestamp_ntz"))


@query(f"SELECT * FROM {_H}")
def nonconformity_history(spark, sf_dir):
    return _histories(spark, sf_dir)


@query(f"SELECT count(*) FILTER (WHERE estado_nc = 'abierta') AS abierta, count(*) FILTER (WHERE estado_nc = 'en_analisis') AS en_analisis, count(*) FILTER (WHERE estado_nc = 'con_accion') AS con_accion, count(*) FILTER (WHERE estado_nc = 'ejecutada') AS ejecutada, count(*) FILTER (WHERE estado_nc = 'verificada') AS verificada, count(*) FILTER (WHERE vencida) AS vencidas, count(*) FILTER (WHERE estancada) AS estancadas, count(*) FILTER (WHERE len(incoherencias) > 0) AS incoherentes FROM {_H}")
def nonconformity_counts(spark, sf_dir):
    return nonconformity.counts(_histories(spark, sf_dir))


@query("""SELECT event_id, list_filter([CASE WHEN event_id % 10 = 0 THEN 'sin quien' END, CASE WHEN event_id % 9 = 0 THEN 'sin cargo' END, CASE WHEN a = 2 AND event_id % 4 = 0 THEN 'con_accion exige accion' END, CASE WHEN a = 2 THEN 'con_accion exige responsable' END, CASE WHEN a = 2 AND event_id % 6 = 0 THEN 'con_accion exige compromiso' END,
    CASE WHEN a = 0 AND event_id % 4 = 0 THEN 'abierta exige origen' END, CASE WHEN a = 4 THEN 'verificada exige evidencia_de_eficacia' END, CASE WHEN a = 5 THEN 'estado desconocido' END], lambda x: x IS NOT NULL) AS motivos FROM (SELECT event_id, event_id % 7 % 6 AS a FROM events)""")
def nonconformity_guards(spark, sf_dir):
    i = F.col("event_id")
    said = lambda n: F.when(i % n != 0, "x")
    rows = table(spark, sf_dir, "events").select(i, F.lit("NC-1").alias("no_conformidad_id"), _pick(i % 7 % 6, *nonconformity.ORDER, "otra").alias("a"), said(10).alias("quien"), said(9).alias("cargo"), F.lit("2024").alias("cuando"), said(4).alias("accion"), F.lit("  ").alias("responsable"), said(6).alias("compromiso"), said(4).alias("origen"), F.lit("d").alias("descripcion"), F.lit(None).cast("string").alias("evidencia_de_eficacia"))
    return rows.select("event_id", nonconformity.guard_problems().alias("motivos"))


# --- dossiers ------------------------------------------------------------------------------------------

_SOA = """(WITH m AS (SELECT ps_c AS c, count(*) AS lineas, sum(h) AS h, list_sort(list_distinct(flatten(list(cc)))) AS cc FROM (SELECT p_partkey AS ps_c, p_partkey % 41 AS o FROM part WHERE p_partkey % 4 <> 0 UNION ALL SELECT p_partkey, p_partkey % 17 + 1 FROM part WHERE p_partkey % 4 = 1)
        JOIN (SELECT s_suppkey AS o, CASE WHEN s_suppkey % 5 = 0 THEN 2 ELSE 0 END AS h, CASE WHEN s_suppkey % 3 = 0 THEN ['A-' || (s_suppkey % 4)] ELSE [] END AS cc FROM supplier) USING (o) GROUP BY 1),
    a AS (SELECT l_partkey AS c, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 3 = 0 GROUP BY 1)
    SELECT p_partkey AS control_id, CASE WHEN coalesce(h, 0) > 0 THEN 'con_hallazgos' WHEN len(coalesce(cc, [])) > 0 THEN 'con_evidencia_tecnica' WHEN coalesce(n, 0) > 0 THEN 'con_respuesta_firmada' WHEN lineas > 0 THEN 'sin_evidencia_todavia' ELSE 'fuera_del_cruce' END AS estado, coalesce(h, 0)::BIGINT AS hallazgos, coalesce(cc, []) AS controles, coalesce(n, 0) AS respuestas
    FROM part LEFT JOIN m ON m.c = p_partkey LEFT JOIN a ON a.c = p_partkey)"""


@query(f"SELECT * FROM {_SOA}")
def implementation_status(spark, sf_dir):
    p, s, k = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier"), F.col("p_partkey")
    cross = p.where(k % 4 != 0).select(k.alias("control_id"), (k % 41).alias("obligacion")).unionByName(p.where(k % 4 == 1).select(k.alias("control_id"), (k % 17 + 1).alias("obligacion")))
    i = F.col("s_suppkey")
    lines = s.select(i.alias("obligacion"), F.when(i % 5 == 0, 2).otherwise(0).alias("hallazgos"), F.when(i % 3 == 0, F.array(F.concat(F.lit("A-"), i % 4))).otherwise(F.array().cast("array<string>")).alias("controles_cubiertos"))
    answered = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_partkey % 3 = 0").select(F.col("l_partkey").alias("control_id"), F.col("l_suppkey").alias("pregunta"))
    return dossier.implementation(p.select(k.alias("control_id")), cross, lines, answered)


@query("SELECT count(*) FILTER (WHERE c_custkey % 3 = 0) AS incluidos, count(*) FILTER (WHERE c_custkey % 3 = 1) AS excluidos, count(*) FILTER (WHERE c_custkey % 3 = 2) AS pendientes, count(*) FILTER (WHERE c_custkey % 4 < 2) AS derivados FROM customer")
def inclusion_counts(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("incluido"), _pick(k % 4, "derivado", "derivado_sin_resolver", "pendiente", "persona").alias("procedencia"))
    return dossier.inclusion_counts(rows)


@query("""SELECT n_nationkey AS seccion, CASE WHEN n_nationkey % 3 = 0 AND s.v IS NOT NULL THEN 'ambos' WHEN n_nationkey % 3 = 0 THEN 'derivado' WHEN s.v IS NOT NULL THEN 'aportado' ELSE 'ausente' END AS procedencia,
    CASE WHEN n_nationkey % 3 <> 0 AND s.v IS NULL THEN CASE WHEN n_nationkey % 3 = 1 THEN 'no hay arbol' ELSE 'nadie lo ha aportado' END END AS motivo FROM nation LEFT JOIN (SELECT s_nationkey AS k, min(s_name) AS v FROM supplier GROUP BY 1) s ON s.k = n_nationkey""")
def annex_sections(spark, sf_dir):
    n = F.col("n_nationkey")
    spec = table(spark, sf_dir, "nation").select(n.alias("seccion"))
    derived = table(spark, sf_dir, "nation").where(n % 3 != 2).select(n.alias("seccion"), F.when(n % 3 == 0, F.col("n_name")).alias("contenido"), F.when(n % 3 == 1, "no hay arbol").alias("motivo"))
    supplied = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("seccion")).agg(F.min("s_name").alias("valor"))
    return dossier.sections(spec, derived, supplied)


@query("""WITH p AS (SELECT n_nationkey AS k, ['formula', 'derivada', 'aportada'][(n_nationkey % 3 + 1)::INT] AS origen, CASE WHEN n_nationkey % 5 = 4 THEN n_nationkey - 1 END AS si FROM nation), a AS (SELECT c_nationkey AS q, min(c_mktsegment) AS v FROM customer WHERE c_acctbal > 8000 GROUP BY 1),
    s AS (SELECT p.k, CASE WHEN si IS NOT NULL AND (g.v IS NULL OR g.v <> 'AUTOMOBILE') THEN 'no_procede' WHEN origen <> 'aportada' THEN origen WHEN a.v IS NOT NULL THEN 'aportada' ELSE 'ausente' END AS procedencia FROM p LEFT JOIN a ON a.q = p.k LEFT JOIN a g ON g.q = p.si)
    SELECT k AS punto, procedencia, k = 8 AND procedencia = 'aportada' AS firma, NOT bool_or(k = 8 AND procedencia = 'aportada') OVER () AS borrador FROM s""")
def annex_points(spark, sf_dir):
    n = F.col("n_nationkey")
    spec = table(spark, sf_dir, "nation").select(n.alias("punto"), _pick(n % 3, "formula", "derivada", "aportada").alias("origen"), n.alias("pregunta"), (n == 8).alias("es_la_firma"), F.when(n % 5 == 4, n - 1).alias("si_pregunta"), F.lit("AUTOMOBILE").alias("si_valor"))
    c = table(spark, sf_dir, "customer")
    answers = c.where("c_acctbal > 8000").groupBy(F.col("c_nationkey").alias("pregunta")).agg(F.min("c_mktsegment").alias("valor")).withColumn("vale", F.lit(True))
    rows = dossier.points(spec, True, answers)
    return rows.join(F.broadcast(dossier.is_draft(rows)), F.lit(True))  # one row


@query("""SELECT o_orderkey AS no_conformidad_id, '[' || o_custkey % 40 || '] ' || CASE WHEN s_suppkey IS NOT NULL THEN s_name ELSE substr(o_orderpriority || repeat('x', (o_orderkey % 90)::INT), 1, 70) END AS titulo, CASE WHEN s_suppkey IS NOT NULL THEN s_address ELSE '' END AS cuerpo, s_suppkey IS NOT NULL AS de_regla
    FROM orders LEFT JOIN (SELECT s_suppkey, s_name, 'd' || s_nationkey AS s_address FROM supplier WHERE s_suppkey % 2 = 0) ON s_suppkey = o_custkey % 40""")
def remediation_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("no_conformidad_id"), (F.col("o_custkey") % 40).cast("string").alias("origen"), F.concat("o_orderpriority", F.repeat(F.lit("x"), (F.col("o_orderkey") % 90).cast("int"))).alias("descripcion"))
    rules = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("regla_id"), F.col("s_name").alias("titulo"), F.concat(F.lit("d"), "s_nationkey").alias("remediacion"))
    return dossier.orders(o, rules)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 = 0 THEN 'sin_nc' WHEN l_shipmode <> 'AIR' THEN 'otro_sistema' ELSE 'consultar' END AS destino FROM (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 2 = 0 THEN 'AIR' ELSE 'RAIL' END AS l_shipmode FROM lineitem)")
def delegation_targets(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("no_conformidad_id"), F.when(F.col("l_suppkey") % 2 == 0, "AIR").otherwise("RAIL").alias("sistema"))
    known = table(spark, sf_dir, "part").where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("no_conformidad_id"))
    return dossier.delegations(d, known, "AIR").select("l_orderkey", "l_linenumber", "destino")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 > 0 AND s_suppkey % 2 > 0 AND contains(lower(s_name), '00000000')")
def plan_reader_filters(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", (F.col("s_suppkey") % 3).alias("hallazgos"), (F.col("s_suppkey") % 2).alias("preguntas"))
    return dossier.line_filter(s, findings=True, questions=True, contains="00000000").select("s_suppkey", "s_name")


# --- controls ------------------------------------------------------------------------------------------

_X = "(SELECT user_id % 60 AS repo, event_id AS i, ['tool', 'limit', 'delegation', 'server', 'framework', 'nada'][(CASE WHEN user_id % 60 % 6 = 5 THEN 4 WHEN user_id % 60 % 6 = 4 THEN 5 WHEN event_id % 11 = 0 THEN 1 WHEN event_id % 7 = 0 THEN 2 WHEN event_id % 5 = 0 THEN 3 ELSE 0 END + 1)::INT] AS kind FROM events)"
_XR = f"""(SELECT repo, i, kind, CASE kind WHEN 'limit' THEN CASE WHEN repo % 4 = 0 THEN 'pasos' ELSE 'gasto' END WHEN 'server' THEN 's' || (i % 3) WHEN 'tool' THEN 's' || (i % 2) || '.t' || (i % 40) ELSE 'x' || (i % 4) END AS name, CASE WHEN kind = 'tool' AND i % 2 = 0 THEN 'mcp' ELSE 'lista' END AS origin, 'f' || (i % 9) || '.py' AS path, i % 30 AS line, kind = 'tool' AND i % 3 = 0 AS noted FROM {_X} WHERE kind <> 'nada')"""
_XP = "CASE WHEN line > 0 THEN path || ':' || line ELSE path END"
_XT = f"(SELECT repo, name, arg_min(origin, (NOT noted, {_XP}, origin)) AS origin, bool_or(noted) AS declared, string_agg(DISTINCT {_XP}, ', ' ORDER BY {_XP}) AS places FROM {_XR} WHERE kind = 'tool' GROUP BY repo, name)"
_XF = f"""(WITH r AS (SELECT repo, bool_or(kind IN ('tool', 'delegation', 'server')) AS hay, bool_or(kind = 'limit') AS lim, bool_or(kind = 'limit' AND name = 'pasos') AS pasos FROM {_XR} GROUP BY repo)
    SELECT repo, 'ACT-AG-EFECTO-SIN-DECLARAR' AS regla_id, name || ' (' || places || ')' AS localizacion FROM {_XT} WHERE NOT declared
    UNION ALL SELECT DISTINCT repo, 'ACT-AG-SERVIDOR-SIN-INVENTARIO', name FROM {_XR} s WHERE kind = 'server' AND NOT EXISTS (SELECT 1 FROM {_XT} t WHERE t.repo = s.repo AND t.origin = 'mcp' AND split_part(t.name, '.', 1) = s.name)
    UNION ALL SELECT repo, 'ACT-AG-SIN-LIMITES', '(la estructura entera)' FROM r WHERE hay AND NOT lim
    UNION ALL SELECT repo, 'ACT-AG-DELEGACION-SIN-TOPE', {_XP} FROM {_XR} d WHERE kind = 'delegation' AND repo IN (SELECT repo FROM r WHERE hay AND NOT pasos))"""


def _structure(spark, sf_dir):
    i, r = F.col("event_id"), F.col("user_id") % 60
    kind = F.when(r % 6 == 5, "framework").when(r % 6 == 4, "nada").when(i % 11 == 0, "limit").when(i % 7 == 0, "delegation").when(i % 5 == 0, "server").otherwise("tool")
    rows = table(spark, sf_dir, "events").select(r.alias("repo"), i, kind.alias("kind")).where("kind <> 'nada'")
    name = F.when(F.col("kind") == "limit", F.when(F.col("repo") % 4 == 0, "pasos").otherwise("gasto")).when(F.col("kind") == "server", F.concat(F.lit("s"), i % 3)).when(F.col("kind") == "tool", F.concat(F.lit("s"), i % 2, F.lit(".t"), i % 40)).otherwise(F.concat(F.lit("x"), i % 4))
    tool = F.col("kind") == "tool"
    notes = F.when(tool & (i % 3 == 0), F.array(F.lit("effect"))).otherwise(F.array().cast("array<string>"))
    return rows.select("repo", "kind", name.alias("name"), F.when(tool & (i % 2 == 0), "mcp").otherwise("lista").alias("origin"), F.concat(F.lit("f"), i % 9, F.lit(".py")).alias("path"), (i % 30).alias("line"), notes.alias("annotations"))


@query(f"SELECT * FROM {_XF}")
def agent_control_findings(spark, sf_dir):
    from probatum.sources import agents

    rows = _structure(spark, sf_dir)
    return controls.agent_findings(rows, agents.tools(rows))


@query(f"""SELECT repo, CASE WHEN hay OR marco THEN 'completada' ELSE 'no_aplicable' END AS ejecucion, CASE WHEN NOT hay AND marco THEN 'indeterminada' WHEN hay AND h = 0 THEN 'insuficiente' END AS suficiencia, h AS hallazgos, CASE WHEN NOT (hay OR marco) THEN 'no_aplica' WHEN h > 0 THEN 'con_hallazgos' ELSE 'indeterminado' END AS resultado
    FROM (SELECT DISTINCT user_id % 60 AS repo FROM events) LEFT JOIN (SELECT repo, bool_or(kind IN ('tool', 'delegation', 'server')) AS a, bool_or(kind = 'framework') AS b FROM {_XR} GROUP BY repo) USING (repo), LATERAL (SELECT coalesce(a, false) AS hay, coalesce(b, false) AS marco, (SELECT count(*) FROM {_XF} f WHERE f.repo = events_repo.repo) AS h FROM (SELECT repo) events_repo)""")
def agent_control_outcomes(spark, sf_dir):
    from probatum.sources import agents

    rows = _structure(spark, sf_dir)
    repos = table(spark, sf_dir, "events").select((F.col("user_id") % 60).alias("repo"))
    return controls.agent_outcomes(repos, rows, controls.agent_findings(rows, agents.tools(rows)))


@query("""WITH a AS (SELECT l_suppkey AS repo, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_suppkey % 4 = 0 AND l_partkey % 9 = 0 THEN CASE WHEN l_partkey % 2 = 0 THEN 'no_reconocida' ELSE 'ausente' END WHEN l_suppkey % 4 = 1 AND l_partkey % 5 = 0 THEN 'sin_verificar' WHEN l_suppkey % 4 < 3 THEN 'presente' END AS v FROM lineitem WHERE l_suppkey % 4 < 3 OR l_linenumber = 7),
    m AS (SELECT repo, count(*) FILTER (WHERE v IN ('no_reconocida', 'ausente')) AS h, count(*) FILTER (WHERE v = 'sin_verificar') AS d, count(*) FILTER (WHERE v = 'presente') AS ok FROM a GROUP BY 1),
    r AS (SELECT s_suppkey AS repo, s_suppkey % 5 <> 0 AS gen, s_suppkey % 3 AS q, coalesce(h, 0) AS h, coalesce(d, 0) AS d, coalesce(ok, 0) AS ok FROM supplier LEFT JOIN m ON m.repo = s_suppkey)
    SELECT repo, CASE WHEN gen THEN 'completada' ELSE 'no_aplicable' END AS ejecucion, CASE WHEN NOT gen OR h > 0 THEN NULL WHEN d > 0 OR ok = 0 THEN 'indeterminada' WHEN q > 0 THEN 'insuficiente' ELSE 'suficiente' END AS suficiencia, CASE WHEN gen THEN h ELSE 0 END AS hallazgos,
    CASE WHEN NOT gen THEN 'no_aplica' WHEN h > 0 THEN 'con_hallazgos' WHEN d > 0 OR ok = 0 OR q > 0 THEN 'indeterminado' ELSE 'sin_hallazgos' END AS resultado FROM r""")
def marking_control(spark, sf_dir):
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    bad, c2pa = (s % 4 == 0) & (p % 9 == 0), (s % 4 == 1) & (p % 5 == 0)
    art = table(spark, sf_dir, "lineitem").where((s % 4 < 3) | (F.col("l_linenumber") == 7))
    art = art.select(s.alias("repo"), F.when(F.col("l_linenumber") != 7, _pick(p % 2, "png", "jpeg")).alias("container"), F.when(bad, F.when(p % 2 == 0, "no_reconocido").otherwise("sin_marca")).when(c2pa, "sin_marca").otherwise(_pick(p % 2, "sintetico", "otro")).alias("marca"), F.when(c2pa, "present_unverified").alias("c2pa"))
    k = F.col("s_suppkey")
    gen = table(spark, sf_dir, "supplier").select(k.alias("repo"), F.when(k % 5 != 0, k % 2).otherwise(0).alias("imagen"), F.when(k % 5 != 0, 1 - k % 2).otherwise(0).alias("texto"), F.lit(0).alias("bot"), (k % 3).alias("preguntas"))
    return controls.marking_outcomes(gen, art)


# --- orders --------------------------------------------------------------------------------------------


@query("""WITH x AS (SELECT s_nationkey AS k, (s_suppkey % 12) || '.' || (s_suppkey % 7 + 5) AS c, (s_suppkey % 9 + 1) || CASE WHEN s_suppkey % 3 = 0 THEN 'A' ELSE '' END AS a, s_suppkey AS i FROM supplier)
    SELECT k, string_agg(c, ' ' ORDER BY split_part(c, '.', 1)::INT, split_part(c, '.', 2)::INT, i) AS clausulas, string_agg(a, ' ' ORDER BY regexp_extract(a, '^([0-9]+)', 1)::INT, regexp_extract(a, '^[0-9]+(.*)$', 1), i) AS articulos, string_agg(a, ' ' ORDER BY length(a), a, i) AS por_longitud FROM x GROUP BY k""")
def ordered_references(spark, sf_dir):
    s = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), s, F.concat_ws(".", s % 12, s % 7 + 5).alias("c"), F.concat(s % 9 + 1, F.when(s % 3 == 0, "A").otherwise("")).alias("a"))
    listed = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", x))), lambda r: r[x]).alias(x)
    g = rows.groupBy("k").agg(listed("c"), listed("a"))
    return g.select("k", *[F.array_join(tx.ordered(F.col(x), key), " ").alias(name) for x, key, name in (("c", tx.clause_key, "clausulas"), ("a", tx.article_key, "articulos"), ("a", tx.length_key, "por_longitud"))])


@query("SELECT s_nationkey AS k, string_agg(x, ' ' ORDER BY i) AS distintos FROM (SELECT s_nationkey, 'v' || (s_suppkey * 7 % 5) AS x, min(s_suppkey) AS i FROM supplier GROUP BY 1, 2) GROUP BY 1")
def distinct_in_order(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey", F.concat(F.lit("v"), F.col("s_suppkey") * 7 % 5).alias("x"))
    g = rows.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "x"))), lambda r: r["x"]).alias("xs"))
    return g.select("k", F.array_join(F.array_distinct("xs"), " ").alias("distintos"))
