"""Documents from tables: JSON with counts by state and rows in order, the same as Markdown, and Annex V of many systems.

A document belongs to a key (a system, an organisation, a package) and is one string: its rows are a catalogue's or a system's, not a corpus's.
Counts name every state, also those that don't occur. Nothing is cut in JSON; a Markdown cell is, and says so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatum.functions.text import markdown_cell


def _counts(state: str, states: Sequence[str]) -> list[Column]:
    return [F.count_if(F.col(state) == s).alias(f"_{i}") for i, s in enumerate(states)]


def paper(rows: DataFrame, schema: str, key: str, order: str, name: str, state: str, states: Sequence[str]) -> DataFrame:
    """(key, documento): {"esquema", key, "recuento": {state: n}, "total", name: [rows in order]} for each key; nulls are kept."""
    fields = [c for c in rows.columns if c != key]
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*fields).alias("x")))).alias("rs"), *_counts(state, states))
    counts = F.struct(*[F.col(f"_{i}").alias(s) for i, s in enumerate(states)])
    body = F.struct(F.lit(schema).alias("esquema"), F.col(key), counts.alias("recuento"), F.size("rs").cast("long").alias("total"), F.transform("rs", lambda r: r["x"]).alias(name))
    return g.select(key, F.to_json(body, {"ignoreNullFields": "false"}).alias("documento"))


def paper_markdown(rows: DataFrame, title: str, key: str, order: str, columns: Sequence[str], state: str, states: Sequence[str]) -> DataFrame:
    """(key, documento): a heading, the counts of the states that occur, and a table of escaped cells in order."""
    cells = [markdown_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("x")))).alias("rs"), *_counts(state, states))
    counts = F.concat_ws(", ", *[F.when(F.col(f"_{i}") > 0, F.concat(F.col(f"_{i}").cast("string"), F.lit(f" {s}"))) for i, s in enumerate(states)])
    head = F.concat(F.lit(f"# {title}: "), F.col(key).cast("string"), F.lit("\n\n"), counts, F.lit("\n\n| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns) + "\n"))
    return g.select(key, F.concat(head, F.array_join(F.transform("rs", lambda r: r["x"]), "\n")).alias("documento"))


#: Points of Annex V (id, point, origin, question, condition's question, its value, "vale" or "contiene", the signature), a fixed value.
POINTS = (
    ("AV-1", "1", "derivada", None, None, None, None, False), ("AV-2", "2", "aportada", "F-PRV-2", None, None, None, False), ("AV-3", "3", "formula", None, None, None, None, False),
    ("AV-4", "4", "formula", None, None, None, None, False), ("AV-5", "5", "formula", None, "F-CNF-1", "true", "vale", False), ("AV-6", "6", "aportada", "F-CNF-2", None, None, None, False),
    ("AV-7", "7", "aportada", "F-CNF-3", "F-PRV-3", "notificado", "contiene", False), ("AV-8", "8", "aportada", "F-CNF-4", None, None, None, True),
)
ORIGINS = ("derivada", "aportada", "formula", "no_procede", "ausente")


def declarations(systems: DataFrame, answers: DataFrame, points: Sequence[tuple] = POINTS) -> DataFrame:
    """(caso, orden, id, punto, procedencia, contenido, respondida_por, cargo, cuando, motivo, es_la_firma) of every system's Annex V.

    systems: caso, contenido (what the code identifies it by; null if nothing). answers: caso, pregunta, valor, quien, cargo, cuando, vale, one for each
    question: only those that count (vale) do. A point whose condition isn't met doesn't apply; a formula is assumed by who signs.
    """
    kind = "array<struct<orden: int, id: string, punto: string, origen: string, pregunta: string, si: string, si_valor: string, como: string, es_la_firma: boolean>>"
    spec = F.array(*[F.struct(F.lit(i), *[F.lit(x) for x in p]) for i, p in enumerate(points)]).cast(kind)
    good = answers.where("vale").select("caso", "pregunta", "valor", "quien", "cargo", "cuando")
    rows = systems.select("caso", F.col("contenido").alias("identificacion"), F.inline(spec)).join(good, ["caso", "pregunta"], "left")
    rows = rows.join(good.select("caso", F.col("pregunta").alias("si"), F.col("valor").alias("dicho")), ["caso", "si"], "left")
    met = F.when(F.col("como") == "contiene", F.contains(F.lower("dicho"), F.col("si_valor"))).otherwise(F.lower("dicho") == F.col("si_valor"))
    off = F.col("si").isNotNull() & ~F.coalesce(met, F.lit(False))
    origin = (
        F.when(off, "no_procede").when(F.col("origen") == "formula", "formula").when(F.col("origen") == "derivada", F.when(F.col("identificacion").isNotNull(), "derivada").otherwise("ausente"))
        .when(F.col("valor").isNotNull(), "aportada").otherwise("ausente")
    )
    given = lambda c: F.when(origin == "aportada", F.col(c))
    reason = F.when(off, F.concat(F.lit("depende de "), "si")).when(origin == "ausente", F.when(F.col("origen") == "derivada", "el código no identifica el sistema").otherwise(F.concat(F.lit("falta una respuesta vigente a "), "pregunta")))
    return rows.select(
        "caso", "orden", "id", "punto", origin.alias("procedencia"), F.when(origin == "derivada", F.col("identificacion")).when(origin == "aportada", F.col("valor")).alias("contenido"),
        given("quien").alias("respondida_por"), given("cargo").alias("cargo"), given("cuando").alias("cuando"), reason.alias("motivo"), (F.col("es_la_firma") & (origin == "aportada")).alias("es_la_firma"),
    )


def declaration(rows: DataFrame, schema: str = "anexo-v/v1") -> DataFrame:
    """(caso, documento) of declarations(): with whether somebody signed; without, the document is a draft and says so."""
    signed = rows.groupBy("caso").agg(F.bool_or("es_la_firma").alias("firmado"))
    whole = paper(rows, schema, "caso", "orden", "puntos", "procedencia", ORIGINS).join(signed, "caso")
    notice = F.when(F.col("firmado"), F.lit("null")).otherwise(F.lit('"BORRADOR: nadie la ha firmado"'))
    return whole.select("caso", F.concat(F.lit('{"firmado":'), F.col("firmado").cast("string"), F.lit(',"aviso":'), notice, F.lit(","), F.substr("documento", F.lit(2))).alias("documento"))


def declaration_markdown(rows: DataFrame) -> DataFrame:
    """(caso, documento): the declaration as text, a draft in its title if nobody signed."""
    body = (
        F.when(F.col("procedencia") == "aportada", F.concat(F.lit("*APORTADA por "), F.coalesce("respondida_por", F.lit("?")), F.lit(" ("), F.coalesce("cargo", F.lit("?")), F.lit(")*\n\n"), "contenido"))
        .when(F.col("procedencia") == "derivada", F.concat(F.lit("*DERIVADA del código*\n\n"), "contenido")).when(F.col("procedencia") == "formula", "*FÓRMULA que asume quien firma*")
        .otherwise(F.concat(F.lit("*"), F.when(F.col("procedencia") == "no_procede", "NO PROCEDE").otherwise("AUSENTE"), F.lit("*: "), "motivo"))
    )
    one = F.concat(F.lit("## "), "punto", F.lit(". "), "id", F.lit("\n\n"), body)
    g = rows.groupBy("caso").agg(F.array_sort(F.collect_list(F.struct("orden", one.alias("x")))).alias("s"), F.bool_or("es_la_firma").alias("f"))
    title = F.concat(F.lit("# Declaración UE de conformidad"), F.when(F.col("f"), "").otherwise(" — BORRADOR"))
    return g.select("caso", F.concat(title, F.lit("\n\n"), F.array_join(F.transform("s", lambda s: s["x"]), "\n\n")).alias("documento"))
