"""Documents as JSON: SARIF 2.1.0 from findings and unreadable files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatum.functions.text import markdown_cell
from probatum.operators.rules import WHOLE_REPOSITORY

SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def level(severity: Column) -> Column:
    return F.when(severity == "alta", "error").when(severity == "media", "warning").when(severity == "baja", "note").otherwise("warning")


def sarif_results(findings: DataFrame) -> DataFrame:
    """(rule_id, result) for findings(regla_id, severidad, localizacion, mensaje), one JSON result each.

    Whole-repository findings carry no location; a location ends before its first " (".
    """
    whole = F.col("localizacion") == WHOLE_REPOSITORY
    uri = F.split_part("localizacion", F.lit(" ("), F.lit(1))
    place = F.array(F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation")).alias("physicalLocation")))
    message = F.concat(F.when(whole, "Sobre el repositorio entero: ").otherwise(""), F.coalesce("mensaje", F.lit("")))
    print_ = F.struct(F.concat_ws(":", "regla_id", "localizacion").alias("evidencia/v1"))
    row = F.struct(F.col("regla_id").alias("ruleId"), level(F.col("severidad")).alias("level"), F.struct(message.alias("text")).alias("message"), print_.alias("partialFingerprints"), F.when(~whole, place).alias("locations"))
    return findings.select(F.col("regla_id").alias("rule_id"), F.to_json(row).alias("result"))


def sarif_document(findings: DataFrame, unreadable: DataFrame, tool: str, version: str) -> DataFrame:
    """One row, column sarif: the run's document. unreadable is (fichero, por_que).

    A document is one string: findings of one repository, not of a corpus. For more, write sarif_results.
    """
    results = sarif_results(findings).groupBy().agg(F.array_sort(F.collect_list("result")).alias("r"))
    rules = findings.groupBy().agg(F.array_sort(F.collect_set("regla_id")).alias("ids"))
    note = F.struct(F.lit("warning").alias("level"), F.struct(F.concat_ws(": ", "fichero", "por_que").alias("text")).alias("message"), F.struct(F.lit("ilegible").alias("id")).alias("descriptor"))
    lost = unreadable.groupBy().agg(F.array_sort(F.collect_list(F.to_json(note))).alias("n"))
    text = F.format_string(
        '{"$schema":"%s","version":"2.1.0","runs":[{"tool":{"driver":{"name":"%s","version":"%s","semanticVersion":"%s","rules":[%s]}},"results":[%s],"invocations":[{"executionSuccessful":%s,"toolExecutionNotifications":[%s]}]}]}',
        F.lit(SCHEMA),
        F.lit(tool),
        F.lit(version),
        F.lit(version),
        F.array_join(F.transform("ids", lambda i: F.to_json(F.struct(i.alias("id")))), ","),
        F.array_join("r", ","),
        (F.size("n") == 0).cast("string"),
        F.array_join("n", ","),
    )
    return results.crossJoin(rules).crossJoin(lost).select(text.alias("sarif"))  # three tables of one row


def markdown(rows: DataFrame, key: str, order: str, columns: tuple[str, ...]) -> DataFrame:
    """(key, documento): a Markdown table for each key, its cells escaped and cut, rows in order; a catalogue's rows, not a corpus's."""
    cells = [markdown_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns) + "\n"
    g = rows.select(key, F.struct(F.col(order).alias("o"), line.alias("x")).alias("r")).groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return g.select(key, F.concat(F.lit(head), F.array_join(F.transform("rs", lambda r: r["x"]), "\n")).alias("documento"))


def document(rows: DataFrame, schema: str, key: str, order: str, name: str) -> DataFrame:
    """(key, documento): one JSON document for each key, {"esquema": ..., key: ..., name: [rows in order]}; a catalogue's rows."""
    fields = [c for c in rows.columns if c != key]
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*fields).alias("x")))).alias("rs"))
    body = F.struct(F.lit(schema).alias("esquema"), F.col(key), F.transform("rs", lambda r: r["x"]).alias(name))
    return g.select(key, F.to_json(body, {"ignoreNullFields": "false"}).alias("documento"))
