"""More registered queries: plans, reviews, tickets, documents, images, agent structure, limits.

The tables hold no images, tickets or agent code: rows are made from ids, and every row of a table takes part.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from probatum.functions import text as tx
from probatum.operators import applicability, evidence, exports, ladders, nonconformity, rules, tickets
from probatum.plans.queries import FILES, LOG, RULES, _as_of, _profiles, _P_SQL, _states, _STATES, files, log, query, table
from probatum.sources import agents, images
from probatum.streaming.limits import throttle_batch


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'no_ata' WHEN p_size % 5 = 1 THEN 'sin_resolver' WHEN p_size % 5 = 2 THEN 'futura' WHEN p_partkey % 4 = 0 THEN CASE WHEN p_partkey % 8 = 0 THEN 'solo_formulario' ELSE 'a_preguntar' END
    WHEN p_partkey % 3 = 0 THEN 'con_hallazgos' WHEN p_partkey % 3 = 1 AND p_partkey % 7 < 4 THEN 'comprobada' ELSE 'a_preguntar' END AS estado FROM part""")
def plan_line_state(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    situation = F.when(size % 5 == 0, "no_ata").when(size % 5 == 1, "indeterminada").when(size % 5 == 2, "futura").otherwise("ata")
    outcome = F.when(k % 3 == 0, "con_hallazgos").when(k % 3 == 1, "sin_hallazgos").otherwise("indeterminado")
    questions = F.when(k % 7 < 4, 0).otherwise(2)
    return table(spark, sf_dir, "part").select("p_partkey", ladders.plan_line(situation, k % 4, k % 8 == 0, outcome, questions).alias("estado"))


@query("""WITH g AS (SELECT l_orderkey, list(DISTINCT CASE WHEN l_partkey % 6 = 0 THEN 'F-' || (l_partkey % 3)::VARCHAR ELSE (l_partkey % 20)::VARCHAR END) FILTER (WHERE l_returnflag <> 'A') AS cubre FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, CASE WHEN cubre IS NULL THEN 'no_cubierto' WHEN list_has_any(cubre, ['1', '2']) THEN 'con_hallazgos' WHEN list_has_any(cubre, ['3', '4', '5']) THEN 'pendiente' WHEN list_has_any(cubre, ['7', '8', '9', '10']) THEN 'sin_hallazgos' WHEN len(list_filter(cubre, lambda x: x LIKE 'F-%')) > 0 THEN 'formulario' ELSE 'no_evaluado' END AS estado FROM g""")
def requirement_ladder(spark, sf_dir):
    k = F.col("l_partkey")
    cover = F.when(k % 6 == 0, F.concat(F.lit("F-"), (k % 3).cast("string"))).otherwise((k % 20).cast("string"))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") != "A", cover)).alias("c"))
    names = lambda *xs: F.array(*[F.lit(x) for x in xs])
    return g.select("l_orderkey", ladders.requirement(F.col("c"), names("1", "2"), names("3", "4", "5"), names("7", "8", "9", "10")).alias("estado"))


_CLAUSES = sorted({c for cs in ladders.REVIEW_INPUTS.values() for c in cs})
_INPUT_ROWS = ", ".join(f"('{name}', '{c}')" for name, cs in ladders.REVIEW_INPUTS.items() for c in cs)
#: Two of the clauses get no evidence, others only evidence that no longer counts.
_CLAUSE_OF = f"[{', '.join(repr(c) for c in _CLAUSES[:-2])}][(control_id % {len(_CLAUSES) - 2} + 1)::INT]"


@query(f"""WITH e AS (SELECT {_CLAUSE_OF} AS clausula, estado FROM {_STATES}),
    c AS (SELECT entrada, count(*) FILTER (WHERE estado = 'valida') AS apoyos, count(*) FILTER (WHERE estado <> 'valida') AS caducados FROM (VALUES {_INPUT_ROWS}) i(entrada, clausula) LEFT JOIN e USING (clausula) GROUP BY entrada)
    SELECT entrada, CASE WHEN apoyos > 0 THEN 'aportada' WHEN caducados > 0 THEN 'caducada' ELSE 'ausente' END AS situacion, apoyos, caducados FROM c""")
def review_inputs(spark, sf_dir):
    names = F.array(*[F.lit(c) for c in _CLAUSES[:-2]])
    clause = F.element_at(names, (F.col("control_id") % (len(_CLAUSES) - 2) + 1).cast("int"))
    return ladders.review(_states(spark, sf_dir).select(evidence.state(_as_of()).alias("estado"), clause.alias("control_id")))


_TICKET = """(SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'jira' WHEN 1 THEN 'linear' ELSE 'github' END AS s, CASE o_orderstatus WHEN 'F' THEN 'Done' WHEN 'O' THEN 'In Progress' ELSE 'closed' END AS x,
    CASE o_orderkey % 4 WHEN 0 THEN 'abierta' WHEN 1 THEN 'en_analisis' ELSE 'ejecutada' END AS c FROM orders)"""


@query(f"""WITH r AS (SELECT *, CASE WHEN x = 'In Progress' AND s <> 'github' THEN 'en_analisis' WHEN x = 'Done' AND s <> 'github' THEN 'ejecutada' WHEN x = 'closed' AND s <> 'linear' THEN 'ejecutada' END AS read FROM {_TICKET}),
    v AS (SELECT *, CASE WHEN read IS NULL THEN 'estado_desconocido' WHEN o_orderkey % 11 = 0 THEN 'sin_persona' WHEN o_orderkey % 13 = 0 THEN 'sin_fecha'
        WHEN list_position(['abierta', 'en_analisis', 'con_accion', 'ejecutada'], read) <= list_position(['abierta', 'en_analisis', 'con_accion', 'ejecutada'], c) THEN 'no_retrocede' WHEN o_orderkey % 17 = 0 THEN 'sin_cargo' ELSE 'mueve' END AS verdict FROM r)
    SELECT o_orderkey, read, verdict, CASE WHEN verdict = 'mueve' THEN read ELSE c END AS after FROM v""")
def external_status_cap(spark, sf_dir):
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select(
        k,
        F.when(k % 3 == 0, "jira").when(k % 3 == 1, "linear").otherwise("github").alias("system"),
        F.when(status == "F", "Done").when(status == "O", "In Progress").otherwise("closed").alias("external"),
        F.when(k % 4 == 0, "abierta").when(k % 4 == 1, "en_analisis").otherwise("ejecutada").alias("current"),
        F.when(k % 11 == 0, " ").otherwise("ana").alias("actor"),
        F.when(k % 13 != 0, F.col("o_orderdate").cast("string")).alias("when"),
        F.when(k % 17 != 0, "responsable").alias("role"),
    )
    return tickets.translate(rows).select("o_orderkey", "read", "verdict", "after")


@query(f"SELECT perfil_id, strftime(CASE WHEN es_alto_riesgo IS TRUE AND via_anexo IS NULL THEN NULL WHEN es_alto_riesgo IS TRUE AND via_anexo = 'anexo_i' THEN DATE '2028-08-02' ELSE DATE '2027-12-02' END, '%Y-%m-%d') AS desde FROM ({_P_SQL})")
def split_calendar_date(spark, sf_dir):
    calendar = F.expr("map('anexo_iii', DATE'2027-12-02', 'anexo_i', DATE'2028-08-02')")
    p = _profiles(spark, sf_dir).withColumn("aplica_desde", F.lit("2026-08-02").cast("date")).withColumn("aplica_desde_por_via", calendar)
    return p.select("perfil_id", applicability.start_date().cast("string").alias("desde"))


@query(f"SELECT control_id, arg_max(resultado, (observado_en, -n)) AS resultado, max(observado_en) AS observado_en FROM {LOG} GROUP BY control_id")
def latest_evidence_max_by(spark, sf_dir):
    """The latest row as an aggregate: partial on the map side, no sort, unlike a window."""
    return log(spark, sf_dir).groupBy("control_id").agg(F.max_by("resultado", F.struct("observado_en", (-F.col("n")).alias("n"))).alias("resultado"), F.max("observado_en").alias("observado_en"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ultimo FROM events")
def last_nonnull_attribute(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("dicho", F.when(F.col("event_type") == "click", F.col("props")))
    return nonconformity.last_known(e, "user_id", ("ts", "event_id"), "dicho", "ultimo").select("event_id", "ultimo")


@query("""WITH a AS (SELECT p_partkey, [p_partkey % 3, p_partkey % 5, p_partkey % 3] AS x, [p_partkey % 7, p_partkey % 5] AS y FROM part)
    SELECT p_partkey, list_sort(list_distinct(x || y)) AS unidos, list_sort(list_distinct(list_filter(x, lambda v: NOT list_contains(y, v)))) AS faltan FROM a""")
def ordered_distinct_union_except(spark, sf_dir):
    k = F.col("p_partkey")
    x, y = F.array(k % 3, k % 5, k % 3), F.array(k % 7, k % 5)
    return table(spark, sf_dir, "part").select("p_partkey", tx.united(x, y).alias("unidos"), tx.lacking(x, y).alias("faltan"))


@query(f"""SELECT 'R-SECRETO' AS rule_id, '{{"ruleId":"R-SECRETO","level":"error","message":{{"text":"retirar"}},"partialFingerprints":{{"evidencia/v1":"R-SECRETO:' || path || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || path || '"}}}}}}]}}' AS result
    FROM {FILES} WHERE {' OR '.join(f"regexp_matches(text, '{p}')" for p in RULES[3].patterns)}""")
def sarif_results(spark, sf_dir):
    return exports.sarif_results(rules.forbidden_findings(files(spark, sf_dir), RULES[3]).withColumn("mensaje", F.lit("retirar")))


_KIND = "CASE event_id % 4 WHEN 0 THEN 'trainedAlgorithmicMedia' WHEN 1 THEN 'digitalArt' WHEN 2 THEN 'potato' END"


@query(f"""SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN 'png' END AS container, CASE WHEN event_id % 7 <> 0 THEN event_id % 4096 END AS width, CASE WHEN event_id % 7 <> 0 THEN 600 END AS height,
    CASE WHEN event_id % 7 = 0 OR k IS NULL THEN 'sin_marca' WHEN k = 'potato' THEN 'no_reconocido' WHEN k = 'digitalArt' THEN 'otro' ELSE 'sintetico' END AS marca FROM (SELECT event_id, {_KIND} AS k FROM events)""")
def image_facts(spark, sf_dir):
    """Images made from bytes: a header, and a text chunk with a declared source type in three of four."""
    i = F.col("event_id")
    word = lambda n: F.unhex(F.lpad(F.hex(n), 8, "0"))
    b = lambda s: F.lit(s).cast("binary")
    kind = F.when(i % 4 == 0, "trainedAlgorithmicMedia").when(i % 4 == 1, "digitalArt").when(i % 4 == 2, "potato")
    body = F.concat(b("XML:com.adobe.xmp"), F.unhex(F.lit("00")), F.concat(F.lit(f'<d a:DigitalSourceType="{images.VOCABULARY}'), kind, F.lit('"/>')).cast("binary"))
    mark = F.coalesce(F.concat(word(F.octet_length(body)), b("tEXt"), body, word(F.lit(0))), b(""))
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A")), word(F.lit(13)), b("IHDR"), word(i % 4096), word(F.lit(600)), F.unhex(F.lit("0802000000")), word(F.lit(0)), mark)
    f = table(spark, sf_dir, "events").select(i, images.facts(F.when(i % 7 != 0, png).otherwise(b("GIF89a"))).alias("f"))
    return f.select("event_id", "f.container", "f.width", "f.height", images.marking(F.col("f.digital_source_type")).alias("marca"))


@query("""SELECT 't' || (p_partkey % 40)::VARCHAR AS name, CASE WHEN bool_or(p_partkey % 3 = 0) THEN 'declarado' ELSE 'sin_declarar' END AS effect, count(*) AS sitios FROM part GROUP BY ALL""")
def agent_tools(spark, sf_dir):
    """One Python file for each part: a decorated tool, some with an annotation."""
    k = F.col("p_partkey").cast("string")
    note = F.when(F.col("p_partkey") % 3 == 0, "readOnlyHint=True").otherwise("")
    code = F.concat(F.lit("@sdk.tool("), note, F.lit(")\ndef t"), (F.col("p_partkey") % 40).cast("string"), F.lit("():\n    pass\n"))
    rows = agents.structure(table(spark, sf_dir, "part").select(F.concat(k, F.lit(".py")).alias("path"), code.alias("text")))
    return agents.tools(rows).select("name", "effect", F.size(F.split("places", ", ")).cast("long").alias("sitios"))


@query("""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS key, event_id AS n, ts, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    b AS (SELECT key, n, ts, k, us AS last, true AS allowed, 2.0::DOUBLE AS tokens FROM e WHERE k = 1
        UNION ALL SELECT key, n, ts, k, last, t >= 1, CASE WHEN t >= 1 THEN t - 1 ELSE t END FROM (SELECT e.key, e.n, e.ts, e.k, greatest(e.us, b.last) AS last, CASE WHEN e.us > b.last THEN least(3.0::DOUBLE, b.tokens + (e.us - b.last) * (2::DOUBLE / 1440) / 60e6::DOUBLE) ELSE b.tokens END AS t FROM b JOIN e ON e.key = b.key AND e.k = b.k + 1))
    SELECT key, n, ts, allowed FROM b""")
def token_bucket(spark, sf_dir):
    """Two requests a day with bursts of three, so that some are refused; each depends on the one before."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("n"), F.col("ts").cast("timestamp").alias("ts"))
    return throttle_batch(e, 2 / 1440, 3)
