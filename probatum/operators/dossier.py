"""Documents about a system: the statement of applicability, Annex IV sections, Annex V points, remediation orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probatum.functions.text import redact_secrets

from . import ladders


def implementation(controls: DataFrame, crosswalk: DataFrame, lines: DataFrame, answered: DataFrame) -> DataFrame:
    """(control_id, estado, hallazgos, controles, respuestas) of each control.

    crosswalk: control_id, obligacion; lines: obligacion, hallazgos, controles_cubiertos; answered: control_id, pregunta of signed answers that count.
    Findings, then technical evidence, then a signed answer, then nothing yet; outside the crosswalk if no line meets it.
    """
    met = crosswalk.join(lines, "obligacion").groupBy("control_id").agg(F.count("*").alias("lineas"), F.sum("hallazgos").alias("hallazgos"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("controles_cubiertos")))).alias("controles"))  # a catalogue's rules
    said = answered.groupBy("control_id").agg(F.countDistinct("pregunta").alias("respuestas"))
    rows = controls.select("control_id").join(met, "control_id", "left").join(said, "control_id", "left")
    n, said_n, none = F.coalesce("hallazgos", F.lit(0)), F.coalesce("respuestas", F.lit(0)), F.array().cast("array<string>")
    state = F.when(n > 0, "con_hallazgos").when(F.size(F.coalesce("controles", none)) > 0, "con_evidencia_tecnica").when(said_n > 0, "con_respuesta_firmada").when(F.col("lineas") > 0, "sin_evidencia_todavia").otherwise("fuera_del_cruce")
    return rows.select("control_id", state.alias("estado"), n.cast("long").alias("hallazgos"), F.coalesce("controles", none).alias("controles"), said_n.alias("respuestas"))


def inclusion_counts(rows: DataFrame) -> DataFrame:
    """One row of rows (incluido, procedencia): included, excluded, undecided (null) and derived."""
    return rows.agg(F.count_if(F.col("incluido")).alias("incluidos"), F.count_if(~F.col("incluido")).alias("excluidos"), F.count_if(F.col("incluido").isNull()).alias("pendientes"), F.count_if(F.col("procedencia").startswith("derivad")).alias("derivados"))


def sections(spec: DataFrame, derived: DataFrame, supplied: DataFrame) -> DataFrame:
    """(seccion, procedencia, motivo) of an annex: spec (seccion), derived (seccion, contenido, motivo), supplied (seccion, valor)."""
    rows = spec.join(derived, "seccion", "left").join(supplied, "seccion", "left")
    state = ladders.provenance(F.col("contenido"), F.col("valor"))
    return rows.select("seccion", state.alias("procedencia"), F.when(state == "ausente", F.coalesce("motivo", F.lit("nadie lo ha aportado"))).alias("motivo"))


def points(spec: DataFrame, identified: bool, answers: DataFrame) -> DataFrame:
    """(punto, procedencia) of Annex V: spec (punto, origen, pregunta, es_la_firma, si_pregunta, si_valor), answers (pregunta, valor, vale).

    A point whose condition isn't met does not apply; formulas stand as they are; the system's identification is derived; the rest needs
    an answer that counts.
    """
    good = answers.where("vale").select("pregunta", "valor")
    rows = spec.join(good, "pregunta", "left").join(good.select(F.col("pregunta").alias("si_pregunta"), F.col("valor").alias("dicho")), "si_pregunta", "left")
    off = F.col("si_pregunta").isNotNull() & ~F.col("si_valor").eqNullSafe(F.col("dicho"))
    state = F.when(off, "no_procede").when(F.col("origen") == "formula", "formula").when(F.col("origen") == "derivada", "derivada" if identified else "ausente").when(F.col("valor").isNotNull(), "aportada").otherwise("ausente")
    return rows.select("punto", state.alias("procedencia"), (F.col("es_la_firma") & (state == "aportada")).alias("firma"))


def is_draft(rows: DataFrame) -> DataFrame:
    """One boolean: nobody's valid answer to the signature point."""
    return rows.agg((~F.coalesce(F.bool_or("firma"), F.lit(False))).alias("borrador"))


def orders(nonconformities: DataFrame, rules: DataFrame) -> DataFrame:
    """(no_conformidad_id, titulo, cuerpo, de_regla): the text of the rule that a nonconformity comes from, else the client's own words, cut at 70, without secrets."""
    text = rules.select(F.col("regla_id").alias("origen"), F.col("titulo").alias("t"), F.col("remediacion").alias("c"))
    rows = nonconformities.join(text, "origen", "left")
    known = F.col("t").isNotNull() & F.col("c").isNotNull()
    title = redact_secrets(F.concat(F.lit("["), F.col("origen"), F.lit("] "), F.when(known, F.col("t")).otherwise(F.substring("descripcion", 1, 70))))
    return rows.select("no_conformidad_id", title.alias("titulo"), F.when(known, F.col("c")).otherwise("").alias("cuerpo"), known.alias("de_regla"))


def latest_order(orders_: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """(key, encargo, encargos): the last of a key's orders and how many there were, combined map-side."""
    return orders_.groupBy(key).agg(F.max_by(column, order).alias("encargo"), F.count("*").alias("encargos"))


def delegations(delegated: DataFrame, nonconformities: DataFrame, system: str) -> DataFrame:
    """delegated (no_conformidad_id, sistema) with destino: consultar, otro_sistema (asking here would give an answer nobody gave) or sin_nc."""
    there = nonconformities.select("no_conformidad_id").distinct().withColumn("hay", F.lit(True))
    rows = delegated.join(there, "no_conformidad_id", "left")
    return rows.withColumn("destino", F.when(F.col("hay").isNull(), "sin_nc").when(F.col("sistema") != system, "otro_sistema").otherwise("consultar")).drop("hay")


def line_filter(lines: DataFrame, findings: bool = False, questions: bool = False, contains: str = "") -> DataFrame:
    """Lines of a plan for a reader: with findings, with questions, holding a text in any of their strings."""
    names = [c for c, t in lines.dtypes if t == "string"]
    held = F.contains(F.lower(F.concat_ws(" ", *names)), F.lit(contains.lower()))
    return lines.where((F.col("hallazgos") > 0) | F.lit(not findings)).where((F.col("preguntas") > 0) | F.lit(not questions)).where(held | F.lit(not contains))


def layer_problems() -> Column:
    """What contradicts itself in a result's layers; none means that it may be published.

    Columns: ejecucion, motivo, leidos, ilegibles, limites, hallazgos, senales, suficiencia, motivo_suficiencia, falta, apoyos, resultado.
    """
    due = ladders.result(F.col("ejecucion"), F.col("hallazgos"), F.col("suficiencia"))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return F.array_compact(F.array(
        F.when((F.col("ejecucion") != "completada") & blank("motivo"), "ejecucion_sin_motivo"),
        F.when((F.col("ejecucion") == "completada") & (F.col("leidos") == 0) & (F.col("ilegibles") == 0), "completada_sin_leer"),
        F.when(F.col("limites") == 0, "observacion_sin_limites"),
        F.when((F.col("suficiencia") == "suficiente") & (F.col("falta") > 0), "suficiente_con_faltas"),
        F.when((F.col("suficiencia") == "suficiente") & (F.col("apoyos") == 0), "suficiente_sin_apoyo"),
        F.when((F.col("suficiencia") == "insuficiente") & (F.col("falta") == 0), "insuficiente_sin_falta"),
        F.when(F.col("suficiencia").isin("indeterminada", "no_exigible") & blank("motivo_suficiencia"), "suficiencia_sin_motivo"),
        F.when(~due.eqNullSafe(F.col("resultado")), "resultado_que_no_proyecta"),
        F.when((F.col("resultado") == "sin_hallazgos") & (F.col("senales") == 0), "limpio_sin_alcance"),
    ))


def digests(sufficiencies: DataFrame) -> DataFrame:
    """(caso, sobre): one digest of a case's sufficiencies in the order of their requirements, a catalogue."""
    parts = F.array_sort(F.collect_list(F.struct("requisito_id", "estado")))
    return sufficiencies.groupBy("caso").agg(F.sha2(F.array_join(F.transform(parts, lambda x: F.concat_ws("=", x["requisito_id"], x["estado"])), "\n"), 256).alias("sobre"))


def bound(decisions: DataFrame, sufficiencies: DataFrame) -> DataFrame:
    """decisions (decision_id, caso, sobre) with sigue_atada: whether they still speak of the sufficiencies (caso, requisito_id, estado) there are."""
    now = digests(sufficiencies).withColumnRenamed("sobre", "hoy")
    return decisions.join(now, "caso", "left").withColumn("sigue_atada", F.col("sobre").eqNullSafe(F.col("hoy"))).drop("hoy")


#: A declared version that can't move (a fixed value).
PINNED = "[=~]=|@sha256:"


def dependencies(declared: DataFrame, key: str, column: str, most: int = 60) -> DataFrame:
    """(key, total, fijadas, lista): how many declarations, how many pinned, and the first of the sorted distinct ones, kept apart before they are gathered."""
    counts = declared.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col(column).rlike(PINNED)).alias("fijadas"))
    first = declared.select(key, column).distinct().withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(column))).where(F.col("nth") <= most)
    return counts.join(first.groupBy(key).agg(F.array_sort(F.collect_list(column)).alias("lista")), key)


def modules(files: DataFrame, pinned: str) -> DataFrame:
    """(raiz, modulos, fijadas): files of each top folder, and those whose text holds a pattern."""
    return files.groupBy(F.substring_index("path", "/", 1).alias("raiz")).agg(F.count("*").alias("modulos"), F.count_if(F.col("text").rlike(pinned)).alias("fijadas"))
