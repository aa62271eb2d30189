"""Registered queries that make documents of what other queries find, and Annex V of many systems."""

from __future__ import annotations

from pyspark.sql import functions as F

from probatum.operators import evidence, ladders, nonconformity, papers
from probatum.plans import documents, people  # noqa: F401  whose queries these documents are made of
from probatum.plans.queries import ORACLE, QUERIES, query, table

#: document: (query whose rows it holds, key as SQL that both dialects read, its name, order, name of the list, state, states).
PAPERS = {
    "soa_document": ("soa_inclusion", "control % 5", "caso", "control", "controles", "inclusion", ("incluido", "excluido", "derivado", "derivado_sin_resolver", "pendiente")),
    "nonconformities_document": ("nonconformity_history", "no_conformidad_id % 4", "caso", "no_conformidad_id", "no_conformidades", "estado_nc", nonconformity.ORDER),
    "watch_document": ("watch_controls", "control_id % 6", "caso", "control_id", "controles", "estado", tuple(evidence.ACTION)),
    "review_document": ("review_inputs", "length(entrada) % 2", "caso", "entrada", "entradas", "situacion", ("aportada", "caducada", "ausente")),
    "applicability_document": ("applicability_case", "perfil_id % 1000000", "caso", "obligacion_id", "obligaciones", "situacion", ("ata", "no_ata", "indeterminada", "futura")),
    "questionnaire_document": ("questionnaire_states", "substr(paquete, 1, 20)", "grupo", "id", "preguntas", "estado", (*ladders.EVIDENCE_TO_QUESTION.values(), "pendiente", "espera_a", "no_procede", "la_contesta_el_codigo")),
}


def _registered(name, base, key, called, order, listed, state, states):
    states = tuple(dict.fromkeys(states))
    counts = ", ".join(f"\"{s}\": count(*) FILTER (WHERE {state} = '{s}')" for s in states)
    columns = _COLUMNS[base]
    row = ", ".join(f"{c}: {c}" for c in columns)
    sql = f"SELECT {called}, to_json({{esquema: '{name}/v1', {called}: {called}, recuento: {{{counts}}}, total: count(*), {listed}: list({{{row}}} ORDER BY {order})}})::VARCHAR AS documento FROM (SELECT *, {key} AS {called} FROM ({ORACLE[base]})) GROUP BY {called}"

    def run(spark, sf_dir):
        rows = QUERIES[base](spark, sf_dir).select(F.expr(key).alias(called), *columns)
        return papers.paper(rows, f"{name}/v1", called, order, listed, state, states)

    run.__name__ = name
    query(sql)(run)


#: What a document says of a row.
_COLUMNS = {
    "soa_inclusion": ("control", "atan", "inclusion"), "nonconformity_history": ("no_conformidad_id", "estado_nc", "dias", "vencida", "estancada", "incoherencias"), "watch_controls": ("control_id", "estado", "accion"),
    "review_inputs": ("entrada", "situacion", "apoyos", "caducados"), "applicability_case": ("obligacion_id", "situacion", "regla", "desde"), "questionnaire_states": ("id", "posicion", "destinatario", "estado", "depende_de", "cubierta_por", "valor"),
}
for _name, _paper in PAPERS.items():
    _registered(_name, *_paper)


@query(f"""WITH r AS (SELECT control, atan, inclusion, control % 5 AS caso FROM ({ORACLE['soa_inclusion']}))
    SELECT caso, '# Declaración de aplicabilidad: ' || caso || chr(10) || chr(10) || concat_ws(', ', {', '.join(f"CASE WHEN count(*) FILTER (WHERE inclusion = '{s}') > 0 THEN count(*) FILTER (WHERE inclusion = '{s}') || ' {s}' END" for s in PAPERS['soa_document'][6])})
        || chr(10) || chr(10) || '| control | inclusion | atan |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || control || ' | ' || inclusion || ' | ' || coalesce(atan::VARCHAR, '') || ' |', chr(10) ORDER BY control) AS documento FROM r GROUP BY caso""")
def soa_as_markdown(spark, sf_dir):
    rows = QUERIES["soa_inclusion"](spark, sf_dir).withColumn("caso", F.col("control") % 5)
    return papers.paper_markdown(rows, "Declaración de aplicabilidad", "caso", "control", ("control", "inclusion", "atan"), "inclusion", PAPERS["soa_document"][6])


_ASKED = ("F-PRV-2", "F-CNF-1", "F-CNF-2", "F-PRV-3", "F-CNF-3", "F-CNF-4")
_ANSWERS = f"""(SELECT s_suppkey AS caso, q AS pregunta, CASE q WHEN 'F-CNF-1' THEN CASE WHEN c % 2 = 0 THEN 'true' ELSE 'false' END WHEN 'F-PRV-3' THEN CASE WHEN c % 3 = 0 THEN 'Organismo Notificado' ELSE 'interno' END ELSE s_name || ' ' || q END AS valor, 'p' || (c % 4) AS quien, 'dirección' AS cargo, '2026-01-0' || (c % 9 + 1) AS cuando, (c + i) % 4 <> 0 AS vale
    FROM (SELECT s_suppkey, s_name, s_suppkey + s_nationkey AS c, unnest({list(_ASKED)}) AS q, unnest([1, 2, 3, 4, 5, 6]) AS i FROM supplier))"""
_POINTS = "(VALUES " + ", ".join("(" + ", ".join([str(i), *["NULL::VARCHAR" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'" for x in p]]) + ")" for i, p in enumerate(papers.POINTS)) + ") p(orden, id, punto, origen, pregunta, si, si_valor, como, firma)"
_V = f"""(WITH a AS (SELECT * FROM {_ANSWERS} WHERE vale), j AS (SELECT s.s_suppkey AS caso, CASE WHEN s.s_nationkey % 3 <> 0 THEN s.s_name END AS ident, p.*, a.valor, a.quien, a.cargo, a.cuando, coalesce(CASE p.como WHEN 'contiene' THEN contains(lower(b.valor), p.si_valor) ELSE lower(b.valor) = p.si_valor END, false) AS met
        FROM supplier s CROSS JOIN {_POINTS} LEFT JOIN a ON a.caso = s.s_suppkey AND a.pregunta = p.pregunta LEFT JOIN a b ON b.caso = s.s_suppkey AND b.pregunta = p.si),
    o AS (SELECT *, CASE WHEN si IS NOT NULL AND NOT met THEN 'no_procede' WHEN origen = 'formula' THEN 'formula' WHEN origen = 'derivada' THEN CASE WHEN ident IS NOT NULL THEN 'derivada' ELSE 'ausente' END WHEN valor IS NOT NULL THEN 'aportada' ELSE 'ausente' END AS procedencia FROM j)
    SELECT caso, orden, id, punto, procedencia, CASE procedencia WHEN 'derivada' THEN ident WHEN 'aportada' THEN valor END AS contenido, CASE WHEN procedencia = 'aportada' THEN quien END AS respondida_por, CASE WHEN procedencia = 'aportada' THEN cargo END AS cargo, CASE WHEN procedencia = 'aportada' THEN cuando END AS cuando,
        CASE WHEN procedencia = 'no_procede' THEN 'depende de ' || si WHEN procedencia = 'ausente' THEN CASE origen WHEN 'derivada' THEN 'el código no identifica el sistema' ELSE 'falta una respuesta vigente a ' || pregunta END END AS motivo, firma AND procedencia = 'aportada' AS es_la_firma FROM o)"""


def _declarations(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("c", F.col("s_suppkey") + F.col("s_nationkey"))
    systems = s.select(F.col("s_suppkey").alias("caso"), F.when(F.col("s_nationkey") % 3 != 0, F.col("s_name")).alias("contenido"))
    each = s.select(F.col("s_suppkey").alias("caso"), "s_name", "c", F.posexplode(F.array(*[F.lit(q) for q in _ASKED])).alias("i", "pregunta"))
    c = F.col("c")
    value = F.when(F.col("pregunta") == "F-CNF-1", (c % 2 == 0).cast("string")).when(F.col("pregunta") == "F-PRV-3", F.when(c % 3 == 0, "Organismo Notificado").otherwise("interno")).otherwise(F.concat_ws(" ", "s_name", "pregunta"))
    answers = each.select("caso", "pregunta", value.alias("valor"), F.concat(F.lit("p"), c % 4).alias("quien"), F.lit("dirección").alias("cargo"), F.concat(F.lit("2026-01-0"), c % 9 + 1).alias("cuando"), ((c + F.col("i") + 1) % 4 != 0).alias("vale"))
    return papers.declarations(systems, answers)


@query(f"SELECT * FROM {_V}")
def declarations_of_conformity(spark, sf_dir):
    return _declarations(spark, sf_dir)


_KEPT = ("orden", "id", "punto", "procedencia", "contenido", "respondida_por", "cargo", "cuando", "motivo", "es_la_firma")


@query(f"""SELECT caso, '{{"firmado":' || bool_or(es_la_firma) || ',"aviso":' || CASE WHEN bool_or(es_la_firma) THEN 'null' ELSE '"BORRADOR: nadie la ha firmado"' END || ',' || substr(to_json({{esquema: 'anexo-v/v1', caso: caso, recuento: {{{', '.join(f"{o}: count(*) FILTER (WHERE procedencia = '{o}')" for o in papers.ORIGINS)}}}, total: count(*),
    puntos: list({{{', '.join(f'{c}: {c}' for c in _KEPT)}}} ORDER BY orden)}})::VARCHAR, 2) AS documento FROM {_V} GROUP BY caso""")
def declaration_document(spark, sf_dir):
    return papers.declaration(_declarations(spark, sf_dir))


@query(f"""SELECT caso, '# Declaración UE de conformidad' || CASE WHEN bool_or(es_la_firma) THEN '' ELSE ' — BORRADOR' END || chr(10) || chr(10) || string_agg('## ' || punto || '. ' || id || chr(10) || chr(10) || CASE procedencia WHEN 'aportada' THEN '*APORTADA por ' || respondida_por || ' (' || cargo || ')*' || chr(10) || chr(10) || contenido
    WHEN 'derivada' THEN '*DERIVADA del código*' || chr(10) || chr(10) || contenido WHEN 'formula' THEN '*FÓRMULA que asume quien firma*' ELSE '*' || CASE procedencia WHEN 'no_procede' THEN 'NO PROCEDE' ELSE 'AUSENTE' END || '*: ' || motivo END, chr(10) || chr(10) ORDER BY orden) AS documento FROM {_V} GROUP BY caso""")
def declaration_as_markdown(spark, sf_dir):
    return papers.declaration_markdown(_declarations(spark, sf_dir))
