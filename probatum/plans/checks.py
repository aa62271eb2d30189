"""Registered queries on documents, invariants and validators."""

from __future__ import annotations

from pyspark.sql import functions as F

from probatum.functions import text as tx
from probatum.operators import access, controls, dossier, exports
from probatum.plans import compliance
from probatum.plans.queries import query, table
from probatum.sources import catalogues


@query(r"""SELECT page_id, list_transform(list_filter(b, lambda x, i: list_position(b, x) = i), lambda x: '''sha256-' || to_base64(unhex(sha256(x))) || '''') AS fuentes FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '(?is)<script\b[^>]*>(.*?)</script>', 1) AS b FROM pages)""")
def csp_script_sources(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.csp_sources(F.coalesce("html", F.lit("")), "script").alias("fuentes"))


@query(f"""SELECT repo, '| obligacion | estado | hallazgos |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || obligacion || ' | ' || estado || ' | ' || hallazgos || ' |', chr(10) ORDER BY obligacion) AS documento FROM {compliance._L} GROUP BY repo""")
def plan_as_markdown(spark, sf_dir):
    return exports.markdown(compliance.plan_lines(spark, sf_dir), "repo", "obligacion", ("obligacion", "estado", "hallazgos"))


@query(f"""SELECT repo, '{{"esquema":"plan/v1","repo":"' || repo || '","lineas":[' || string_agg('{{"obligacion":"' || obligacion || '","estado":"' || estado || '","fuerza_maxima":' || coalesce('"' || fuerza_maxima || '"', 'null') || ',"preguntas":' || preguntas || '}}', ',' ORDER BY obligacion) || ']}}' AS documento FROM {compliance._L} GROUP BY repo""")
def plan_as_json(spark, sf_dir):
    return exports.document(compliance.plan_lines(spark, sf_dir).select("repo", "obligacion", "estado", "fuerza_maxima", "preguntas"), "plan/v1", "repo", "obligacion", "lineas")


@query("""SELECT event_id, CASE WHEN len(pasos) = 0 THEN NULL WHEN list_contains(pasos, 'filtro') THEN 'sin_decidir' WHEN list_contains(pasos, 'quitar_metadatos') THEN 'PIPE-BORRA' ELSE 'PIPE-FRAGIL' END AS veredicto
    FROM (SELECT event_id, list_filter([CASE WHEN event_id % 2 = 0 THEN 'a_png' END, CASE WHEN event_id % 3 = 0 THEN 'quitar_metadatos' END, CASE WHEN event_id % 5 = 0 THEN 'filtro' END], lambda x: x IS NOT NULL) AS pasos FROM events)""")
def pipeline_durability(spark, sf_dir):
    i = F.col("event_id")
    steps = F.array_compact(F.array(F.when(i % 2 == 0, "a_png"), F.when(i % 3 == 0, "quitar_metadatos"), F.when(i % 5 == 0, "filtro")))
    return table(spark, sf_dir, "events").select("event_id", controls.durability(steps).alias("veredicto"))


@query("""SELECT event_id, list_filter([CASE WHEN e <> 'completada' AND event_id % 2 = 0 THEN 'ejecucion_sin_motivo' END, CASE WHEN e = 'completada' AND event_id % 4 = 0 AND event_id % 5 = 0 THEN 'completada_sin_leer' END, CASE WHEN event_id % 6 = 0 THEN 'observacion_sin_limites' END,
    CASE WHEN s = 'suficiente' AND event_id % 7 > 0 THEN 'suficiente_con_faltas' END, CASE WHEN s = 'suficiente' AND event_id % 8 = 0 THEN 'suficiente_sin_apoyo' END, CASE WHEN s = 'insuficiente' AND event_id % 7 = 0 THEN 'insuficiente_sin_falta' END, CASE WHEN s IN ('indeterminada', 'no_exigible') AND event_id % 9 = 0 THEN 'suficiencia_sin_motivo' END,
    CASE WHEN r <> CASE WHEN e = 'fallida' THEN 'error' WHEN e = 'no_aplicable' THEN 'no_aplica' WHEN event_id % 10 > 7 THEN 'con_hallazgos' WHEN s IN ('indeterminada', 'insuficiente') THEN 'indeterminado' WHEN s = 'no_exigible' THEN 'no_aplica' ELSE 'sin_hallazgos' END THEN 'resultado_que_no_proyecta' END,
    CASE WHEN r = 'sin_hallazgos' AND event_id % 11 = 0 THEN 'limpio_sin_alcance' END], lambda x: x IS NOT NULL) AS problemas
    FROM (SELECT event_id, ['completada', 'no_aplicable', 'fallida'][(CASE WHEN event_id % 13 < 10 THEN 0 ELSE event_id % 13 - 10 END % 3 + 1)::INT] AS e, ['suficiente', 'insuficiente', 'indeterminada', 'no_exigible'][(event_id // 3 % 4 + 1)::INT] AS s, ['sin_hallazgos', 'con_hallazgos', 'indeterminado'][(event_id % 3 + 1)::INT] AS r FROM events)""")
def layer_invariants(spark, sf_dir):
    i = F.col("event_id")
    pick = lambda n, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (n + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(
        i, pick(F.when(i % 13 < 10, 0).otherwise(i % 13 - 10) % 3, "completada", "no_aplicable", "fallida").alias("ejecucion"), F.when(i % 2 != 0, "m").alias("motivo"), (i % 4).alias("leidos"), (i % 5).alias("ilegibles"), (i % 6).alias("limites"),
        F.when(i % 10 > 7, 1).otherwise(0).alias("hallazgos"), (i % 11).alias("senales"), pick(F.floor(i / 3) % 4, "suficiente", "insuficiente", "indeterminada", "no_exigible").alias("suficiencia"), F.when(i % 9 != 0, "m").alias("motivo_suficiencia"),
        (i % 7).alias("falta"), (i % 8).alias("apoyos"), pick(i % 3, "sin_hallazgos", "con_hallazgos", "indeterminado").alias("resultado"),
    )
    return rows.select("event_id", dossier.layer_problems().alias("problemas"))


_SUF = "(SELECT c_nationkey AS caso, c_custkey AS requisito_id, CASE WHEN c_acctbal > 0 THEN 'suficiente' ELSE 'insuficiente' END AS estado FROM customer)"


@query(f"SELECT n_nationkey AS decision_id, n_nationkey % 3 <> 0 AND h IS NOT NULL AS sigue_atada FROM nation LEFT JOIN (SELECT caso, sha256(string_agg(requisito_id || '=' || estado, chr(10) ORDER BY requisito_id)) AS h FROM {_SUF} GROUP BY 1) ON caso = n_nationkey")
def bound_decisions(spark, sf_dir):
    """A third of the decisions speaks of another state of things."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("caso"), F.col("c_custkey").alias("requisito_id"), F.when(F.col("c_acctbal") > 0, "suficiente").otherwise("insuficiente").alias("estado"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("caso"))
    decisions = n.join(dossier.digests(c), "caso", "left").select(F.col("caso").alias("decision_id"), "caso", F.when(F.col("caso") % 3 == 0, "otro").otherwise(F.coalesce("sobre", F.lit("nada"))).alias("sobre"))
    return dossier.bound(decisions, c).select("decision_id", "sigue_atada")


@query(r"""SELECT doc_id, count(*) FILTER (WHERE regexp_full_match(w, '[a-z0-9][a-z0-9-]{1,38}[a-z0-9]')) AS clientes, count(*) FILTER (WHERE regexp_full_match(w, '[A-Za-z0-9][A-Za-z0-9._-]{0,63}')) AS identificadores, count(*) FILTER (WHERE regexp_full_match(CASE WHEN length(w) % 2 = 0 THEN sha1(w) ELSE w END, '[0-9a-f]{40}')) AS confirmaciones
    FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w FROM documents) GROUP BY doc_id""")
def validators(spark, sf_dir):
    """Every word of every text; words of even length are hashed, so that some are commits."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")).alias("w"))
    commit = F.when(F.length("w") % 2 == 0, F.sha1(F.col("w").cast("binary"))).otherwise(F.col("w"))
    return w.groupBy("doc_id").agg(F.count_if(access.is_tenant(F.col("w"))).alias("clientes"), F.count_if(access.is_identifier(F.col("w"))).alias("identificadores"), F.count_if(access.is_commit(commit)).alias("confirmaciones"))


@query("SELECT n_nationkey AS id FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def coverage_gaps(spark, sf_dir):
    covers = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("id")).agg(F.collect_set(F.col("s_suppkey").cast("string")).alias("cubierto_por"))
    return catalogues.coverage_gaps(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")).join(covers, "id", "left")).select("id")


@query("SELECT DISTINCT event_type AS valor FROM events WHERE event_type NOT IN ('click', 'view')")
def unlabelled_values(spark, sf_dir):
    words = spark.createDataFrame([("click", "clic", "click"), ("view", "vista", "view"), ("purchase", "compra", None)], "valor string, es string, en string")
    return catalogues.unlabelled(table(spark, sf_dir, "events").select(F.col("event_type").alias("valor")), words)


@query("SELECT n_nationkey, 'ir a ' || n_name || ' por ' || coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey::VARCHAR END, '') || '.' AS texto FROM nation")
def filled_templates(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", tx.filled(F.lit("ir a {nombre} por {region}."), {"nombre": F.col("n_name"), "region": F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey"))}).alias("texto"))
