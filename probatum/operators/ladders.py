"""Precedence ladders over plans, requirements, questions, inclusion and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def result(execution: Column, findings: Column, sufficiency: Column) -> Column:
    return (
        F.when(execution == "fallida", "error")
        .when(execution == "no_aplicable", "no_aplica")
        .when(findings > 0, "con_hallazgos")
        .when(sufficiency.isin("indeterminada", "insuficiente"), "indeterminado")
        .when(sufficiency == "no_exigible", "no_aplica")
        .otherwise("sin_hallazgos")
    )


def requirement(covered_by: Column, with_findings: Column, pending: Column, clean: Column) -> Column:
    """The first that holds: uncovered, a finding, pending, clean, a form (F-...), not assessed."""
    return (
        F.when(F.size(covered_by) == 0, "no_cubierto")
        .when(F.arrays_overlap(covered_by, with_findings), "con_hallazgos")
        .when(F.arrays_overlap(covered_by, pending), "pendiente")
        .when(F.arrays_overlap(covered_by, clean), "sin_hallazgos")
        .when(F.exists(covered_by, lambda x: x.startswith("F-")), "formulario")
        .otherwise("no_evaluado")
    )


EVIDENCE_TO_QUESTION = {"valida": "contestada", "rancia": "rancia", "superada": "superada", "revocada": "superada", "no_fiable": "no_fiable"}


def question(covered: Column, condition: Column, evidence: Column) -> Column:
    """covered: by code; condition: procede, no_procede, espera; evidence: state of the latest answer or null."""
    out = F.when(covered & evidence.isNull(), "la_contesta_el_codigo").when(condition == "no_procede", "no_procede").when((condition == "espera") & evidence.isNull(), "espera_a").when(evidence.isNull(), "pendiente")
    for state, shown in EVIDENCE_TO_QUESTION.items():
        out = out.when(evidence == state, shown)
    return out


#: Words that name a unit of time (fixed values).
TIME_UNITS = ("dia", "semana", "mes", "ano", "año", "trimestr", "day", "week", "month", "year", "quarter")


def admissibility(value: Column, justification: Column, least: Column, needs_reason: Column, needs_interval: Column) -> Column:
    """Reasons against a text answer; none means admissible. An empty answer has that one reason."""
    text = F.trim(value)
    named = F.concat(F.lower(value), F.lit(" "), F.lower(F.coalesce(justification, F.lit(""))))
    unit = F.exists(F.array(*[F.lit(u) for u in TIME_UNITS]), lambda u: F.contains(named, u))
    reasons = F.filter(
        F.array(
            F.when(F.length(text) < least, "minimo_caracteres"),
            F.when(needs_reason & (F.trim(F.coalesce(justification, F.lit(""))) == ""), "exige_justificacion"),
            F.when(needs_interval & ~unit, "exige_intervalo"),
        ),
        lambda x: x.isNotNull(),
    )
    return F.when(value.isNull() | (text == ""), F.array(F.lit("sin contestar"))).otherwise(reasons)


def inclusion(decision: Column, binding: Column, unresolved: Column) -> Column:
    """A person's decision first; then derived, derived but unresolved, pending. Never excluded by itself."""
    return F.when(decision.isNotNull(), F.when(decision, "incluido").otherwise("excluido")).when(binding > 0, "derivado").when(unresolved > 0, "derivado_sin_resolver").otherwise("pendiente")


def provenance(derived: Column, supplied: Column) -> Column:
    return F.when(derived.isNotNull() & supplied.isNotNull(), "ambos").when(derived.isNotNull(), "derivado").when(supplied.isNotNull(), "aportado").otherwise("ausente")


def plan_line(situation: Column, packs: Column, organisational: Column, outcome: Column, questions: Column) -> Column:
    """State of a plan's line: by situation, then whether rules exist, then their outcome and open questions."""
    return (
        F.when(situation == "no_ata", "no_ata")
        .when(situation == "indeterminada", "sin_resolver")
        .when(situation == "futura", "futura")
        .when(packs == 0, F.when(organisational, "solo_formulario").otherwise("a_preguntar"))
        .when(outcome == "con_hallazgos", "con_hallazgos")
        .when((outcome == "sin_hallazgos") & (questions == 0), "comprobada")
        .otherwise("a_preguntar")
    )


#: Inputs of a management review and the clauses that support each.
REVIEW_INPUTS = {
    "estado_de_acciones_previas": ("ISO-9.3.3",),
    "cambios_en_el_contexto": ("ISO-4.1", "ISO-4.2"),
    "cambios_en_las_partes_interesadas": ("ISO-4.2",),
    "no_conformidades_y_acciones": ("ISO-10.2",),
    "seguimiento_y_medicion": ("ISO-9.1",),
    "resultados_de_auditoria": ("ISO-9.2.2",),
    "cumplimiento_de_objetivos": ("ISO-6.2",),
    "resultados_de_riesgo": ("ISO-8.2", "ISO-8.3"),
    "evaluaciones_de_impacto": ("ISO-8.4", "ISO-6.1.4"),
    "oportunidades_de_mejora": ("ISO-10.1",),
}


def review(evidence: DataFrame) -> DataFrame:
    """(entrada, situacion, apoyos, caducados) from evidence(control_id, estado).

    Evidence that no longer counts (caducada) differs from none at all (ausente). Evidence is counted for
    each clause before it meets the inputs, so a hot clause is one row.
    """
    rows = [(name, clause) for name, clauses in REVIEW_INPUTS.items() for clause in clauses]
    inputs = evidence.sparkSession.createDataFrame(rows, "entrada string, control_id string")
    valid = F.col("estado") == "valida"
    counts = evidence.groupBy("control_id").agg(F.count_if(valid).alias("a"), F.count_if(~valid).alias("c"))
    g = inputs.join(counts, "control_id", "left").groupBy("entrada").agg(F.coalesce(F.sum("a"), F.lit(0)).alias("apoyos"), F.coalesce(F.sum("c"), F.lit(0)).alias("caducados"))
    state = F.when(F.col("apoyos") > 0, "aportada").when(F.col("caducados") > 0, "caducada").otherwise("ausente")
    return g.select("entrada", state.alias("situacion"), "apoyos", "caducados")
