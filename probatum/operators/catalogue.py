"""What doesn't hold within a catalogue: each check returns its violations as rows (id, problema, detalle).

Checks are joins over tables of obligations, clauses, controls and questions; an empty result means that all was
looked at and nothing found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import closure

#: Forms of an answer, who is asked, and the clauses that a cycle must lead back to.
FORMATS = ("texto_corto", "texto_largo", "si_no", "fecha", "lista", "eleccion", "persona", "artefacto")
RECIPIENTS = ("direccion", "responsable", "tecnico")
MUST_REACH = (("ISO-9.3.3", "ISO-6.2"), ("ISO-10.2", "ISO-6.1.2"), ("ISO-9.1", "ISO-10.2"))


def _rows(df: DataFrame, problem: str, detail="detalle") -> DataFrame:
    return df.select(F.col("id").cast("string").alias("id"), F.lit(problem).alias("problema"), F.col(detail).cast("string").alias("detalle") if isinstance(detail, str) else detail.cast("string").alias("detalle"))


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def missing(refs: DataFrame, ids: DataFrame, problem: str) -> DataFrame:
    """References (id, detalle) to what ids (id) doesn't hold; a null reference names nothing."""
    known = ids.select(F.col("id").alias("detalle")).distinct()
    return _rows(refs.where(F.col("detalle").isNotNull()).join(known, "detalle", "left_anti"), problem)


def crosswalk_problems(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (a, b) of which a side isn't in its catalogue."""
    return _all(missing(pairs.select(F.col("b").alias("id"), F.col("a").alias("detalle")), left, "par_sin_origen"), missing(pairs.select(F.col("a").alias("id"), F.col("b").alias("detalle")), right, "par_sin_destino"))


def question_problems(questions: DataFrame, obligations: DataFrame, clauses: DataFrame, controls: DataFrame, declared: DataFrame) -> DataFrame:
    """Of questions (id, sirve_a, salta_si_cubre, formato, destinatario, opciones, si): references, values, and who serves nobody.

    obligations have id and nivel; clauses, controls and declared controls have id.
    """
    serves = questions.select("id", F.explode("sirve_a").alias("detalle"))
    every = _all(*[t.select("id") for t in (obligations, clauses, controls)])
    served = serves.select(F.col("detalle").alias("id")).distinct()
    return _all(
        missing(serves, every, "sirve_a_inexistente"),
        missing(questions.select("id", F.explode("salta_si_cubre").alias("detalle")), declared, "control_no_declarado"),
        _rows(questions.where(~F.coalesce(F.col("formato").isin(*FORMATS), F.lit(False))), "formato", "formato"),
        _rows(questions.where(~F.coalesce(F.col("destinatario").isin(*RECIPIENTS), F.lit(False))), "destinatario", "destinatario"),
        _rows(questions.where((F.col("formato") == "eleccion") & (F.coalesce(F.size("opciones"), F.lit(0)) <= 0)), "eleccion_sin_opciones", "formato"),
        missing(questions.select("id", F.col("si").alias("detalle")), questions, "condicion_inexistente"),
        _rows(clauses.join(served, "id", "left_anti"), "clausula_sin_pregunta", F.lit(None)),
        _rows(obligations.where(F.col("nivel").isin("organizativa", "juzgada")).join(served, "id", "left_anti"), "obligacion_sin_pregunta", "nivel"),
    )


def management_problems(clauses: DataFrame, must_reach=MUST_REACH, depth: int = 32) -> DataFrame:
    """Of clauses (id, alimenta, depende_de, exige, produce): dangling and one-sided edges, missing products, open cycles.

    depth bounds the walk and must be at least the number of clauses for a catalogue of any shape.
    """
    feeds = clauses.select("id", F.explode("alimenta").alias("detalle")).distinct()
    needs = clauses.select("id", F.explode("depende_de").alias("detalle")).distinct()
    known = clauses.select(F.col("id").alias("detalle"))
    one_sided = needs.join(known, "detalle", "left_semi").join(feeds.select(F.col("id").alias("detalle"), F.col("detalle").alias("id")), ["id", "detalle"], "left_anti")
    reach = closure(feeds.select(F.col("id").alias("a"), F.col("detalle").alias("b")), depth).select(F.col("a").alias("id"), F.col("b").alias("detalle"))
    must = clauses.sparkSession.createDataFrame(list(must_reach), "id string, detalle string")
    return _all(
        missing(feeds, clauses, "alimenta_inexistente"),
        missing(needs, clauses, "depende_inexistente"),
        _rows(one_sided, "una_sola_direccion"),
        _rows(clauses.where(F.col("exige") & (F.coalesce(F.size("produce"), F.lit(0)) <= 0)), "sin_producto", F.lit(None)),
        _rows(must.join(reach, ["id", "detalle"], "left_anti"), "ciclo_abierto"),
    )


def duplicate_ids(table: DataFrame, *key: str) -> DataFrame:
    return table.groupBy(*(key or ("id",))).agg(F.count("*").alias("veces")).where("veces > 1")
