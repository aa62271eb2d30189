"""Questionnaires: conditions, what code already answers, fingerprints, admissibility, packages and what each question serves.

questions: id, paquete, posicion, destinatario, formato, texto, ayuda, opciones array<string>, exige map<string, string>, sirve_a,
salta_si_cubre array<string>, si struct<pregunta, operador, valor>. answers: pregunta, valor array<string>, cuando, n and what came with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import evidence, ladders

#: Forms of answers, by format.
MANY, OPERATORS = ("lista", "eleccion"), ("vale", "distinto_de", "contiene")


def fingerprint() -> Column:
    """Moves with what changes a question's meaning: id, text, format, options and requirements, not its help."""
    asks = F.array_sort(F.transform(F.map_entries("exige"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    parts = [F.col("id"), F.coalesce("texto", F.lit("")), F.col("formato"), F.array_join(F.coalesce("opciones", F.array().cast("array<string>")), "\x1f"), F.array_join(F.coalesce(asks, F.array().cast("array<string>")), "\x1f")]
    return F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.array(*parts), "\x1e"), 256))


def condition(operator: Column, wanted: Column, value: Column) -> Column:
    """procede, no_procede, or espera while the governing question has no answer; value: all values of its answer."""
    holds = F.when(operator.isin("vale", "contiene"), F.array_contains(value, wanted)).when(operator == "distinto_de", F.exists(value, lambda v: ~v.eqNullSafe(wanted))).otherwise(True)
    return F.when(operator.isNull(), "procede").when(value.isNull(), "espera").when(holds, "procede").otherwise("no_procede")


def latest_answers(answers: DataFrame) -> DataFrame:
    return evidence.latest(answers, "pregunta", "cuando", "n")


def serves(questions: DataFrame, obligations: DataFrame, clauses: DataFrame, controls: DataFrame) -> DataFrame:
    """(id, sirve, marco): what each question serves, an obligation before a clause before a control of the same id."""
    ranked = lambda df, mark, n: df.select(F.col("id").alias("sirve"), F.lit(mark).alias("marco"), F.lit(n).alias("orden"))
    known = ranked(obligations, "articulo", 0).unionByName(ranked(clauses, "clausula", 1)).unionByName(ranked(controls, "anexo_a", 2))
    first = known.groupBy("sirve").agg(F.min_by("marco", "orden").alias("marco"))
    return questions.select("id", F.explode("sirve_a").alias("sirve")).join(first, "sirve").select("id", "sirve", "marco")


def states(questions: DataFrame, answers: DataFrame, covered: DataFrame, as_of: Column) -> DataFrame:
    """(id, paquete, posicion, destinatario, estado, depende_de, cubierta_por, valor) of every question.

    covered: control_id of the rules that came out clean, with their obligation. An answer is judged as evidence whose subject is the question's
    fingerprint (huella of the answer); its value is shown only while it counts.
    """
    last = latest_answers(answers)
    own = last.select(F.col("pregunta").alias("id"), F.struct(*[c for c in last.columns if c != "pregunta"]).alias("r"))
    governs = last.select(F.col("pregunta").alias("si_pregunta"), F.col("valor").alias("si_valor"))
    clean = covered.select(F.col("control_id").alias("c")).distinct()
    skips = questions.select("id", F.explode("salta_si_cubre").alias("c")).join(clean, "c").groupBy("id").agg(F.array_sort(F.collect_set("c")).alias("cubierta_por"))  # a question's own list
    rows = questions.withColumn("si_pregunta", F.col("si.pregunta")).join(governs, "si_pregunta", "left").join(own, "id", "left").join(skips, "id", "left")
    verdict = condition(F.col("si.operador"), F.col("si.valor"), F.col("si_valor"))
    judged = evidence.state_of(F.lit("valida"), F.col("r.revocada"), F.col("r.confiable"), F.col("r.huella"), fingerprint(), F.col("r.cuando"), F.lit(None).cast("timestamp_ntz"), F.col("vigencia_dias"), as_of)
    state = ladders.question(F.col("cubierta_por").isNotNull(), verdict, F.when(F.col("r").isNotNull(), judged))
    return rows.select(
        "id", "paquete", "posicion", "destinatario", state.alias("estado"), F.when(state.isin("no_procede", "espera_a"), F.col("si_pregunta")).alias("depende_de"),
        F.when(state == "la_contesta_el_codigo", F.col("cubierta_por")).alias("cubierta_por"), F.when(state == "contestada", F.col("r.valor")).alias("valor"),
    )


def savings(states_: DataFrame) -> DataFrame:
    """One row: questions that code answers, and the sorted distinct controls that do."""
    return states_.agg(F.count("cubierta_por").alias("preguntas"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("cubierta_por")))).alias("controles"))  # a catalogue


def packages(states_: DataFrame) -> DataFrame:
    """(paquete, preguntas): ids in catalogue order."""
    return states_.groupBy("paquete").agg(F.transform(F.array_sort(F.collect_list(F.struct("posicion", "id"))), lambda x: x["id"]).alias("preguntas"))  # a catalogue


def pending(states_: DataFrame, *recipients: str) -> DataFrame:
    """Questions that somebody still has to answer, of these recipients, or of all if none is named."""
    rows = states_.where(F.col("estado").isin("pendiente", "rancia", "superada", "no_fiable"))
    return rows.where(F.col("destinatario").isin(*recipients)) if recipients else rows


def admissibility() -> Column:
    """Reasons against an answer by its form; none means admissible. Columns of a question and of its answer.

    tipo: texto, si_no or lista, what the answer is; valor: its values; justificacion. An answer without content has one reason.
    """
    values, kind, asks = F.coalesce("valor", F.array().cast("array<string>")), F.col("tipo"), F.col("exige")
    trimmed = F.transform(values, lambda v: F.length(F.trim(F.coalesce(v, F.lit("")))))
    length, n = F.aggregate(trimmed, F.lit(0), lambda a, b: a + b), F.size(values)
    asked = lambda k: F.try_element_at(asks, F.lit(k))
    number = lambda k: asked(k).cast("int")
    yes = lambda k: F.coalesce(asked(k) == "true", F.lit(False))
    reason = F.trim(F.coalesce("justificacion", F.lit("")))
    named = F.concat(F.lower(F.array_join(values, " ")), F.lit(" "), F.lower(reason))
    unit = F.exists(F.array(*[F.lit(u) for u in ladders.TIME_UNITS]), lambda u: F.contains(named, u))
    choice = (F.col("formato") == "eleccion") & (kind == "lista")
    reasons = F.array(
        F.when((F.col("formato") == "si_no") & (kind != "si_no"), "si_no"),
        F.when((F.col("formato") == "fecha") & (kind != "texto"), "fecha"),
        F.when(F.col("formato").isin(*MANY) & (kind != "lista"), "lista"),
        F.when(choice & (F.size(F.array_except(values, F.coalesce("opciones", F.array().cast("array<string>")))) > 0), "opcion"),
        F.when(choice & asked("excluyente").isNotNull() & F.array_contains(values, asked("excluyente")) & (n > 1), "excluyente"),
        F.when(number("minimo_caracteres").isNotNull() & (length < number("minimo_caracteres")), "minimo_caracteres"),
        F.when(number("minimo_elementos").isNotNull() & (kind == "lista") & (n < number("minimo_elementos")), "minimo_elementos"),
        F.when(yes("exige_justificacion") & (reason == ""), "exige_justificacion"),
        F.when(yes("exige_intervalo") & ~unit, "exige_intervalo"),
    )
    empty = (n == 0) | ((kind == "texto") & (length == 0))
    return F.when(empty, F.array(F.lit("sin contestar"))).otherwise(F.array_compact(reasons))
