"""States of external tickets as transitions of a nonconformity: forward only, never beyond executed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatum.operators.nonconformity import rank

#: What a column of each system means. Verified is no ticket's to say.
MEANING = {
    "jira": {"to do": "abierta", "backlog": "abierta", "open": "abierta", "in progress": "en_analisis", "in review": "ejecutada", "done": "ejecutada", "closed": "ejecutada", "resolved": "ejecutada"},
    "linear": {"backlog": "abierta", "todo": "abierta", "unstarted": "abierta", "started": "en_analisis", "in progress": "en_analisis", "completed": "ejecutada", "done": "ejecutada", "canceled": "abierta"},
    "github": {"open": "abierta", "closed": "ejecutada"},
    "fichero": {"escrito": "abierta"},
}


def meaning(system: Column, external: Column) -> Column:
    """The state that a system's column stands for; null if it has none."""
    table = F.create_map(*[F.lit(x) for s, m in MEANING.items() for e, n in m.items() for x in (f"{s}/{e}", n)])
    return F.try_element_at(table, F.concat(system, F.lit("/"), F.lower(F.trim(external))))


def movement(current: Column, read: Column, actor: Column, when: Column, role: Column) -> Column:
    """mueve, or the first reason not to."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return (
        F.when(read.isNull(), "estado_desconocido")
        .when(blank(actor), "sin_persona")
        .when(blank(when), "sin_fecha")
        .when(rank(read) <= rank(current), "no_retrocede")
        .when(read == "con_accion", "exige_accion")
        .when(blank(role), "sin_cargo")
        .otherwise("mueve")
    )


def translate(tickets: DataFrame) -> DataFrame:
    """tickets(system, external, current, actor, when, role) with read, verdict and the state after it."""
    t = tickets.withColumn("read", meaning(F.col("system"), F.col("external")))
    t = t.withColumn("verdict", movement(*[F.col(c) for c in ("current", "read", "actor", "when", "role")]))
    return t.withColumn("after", F.when(F.col("verdict") == "mueve", F.col("read")).otherwise(F.col("current")))


PROFILE, COLUMN = "system string, ruta_estado string, ruta_actor string, ruta_cuando string", "system string, external string, estado string"


def json_path(dotted: Column) -> Column:
    """A path of names and places with dots as a JSON path: fields.list.0.name becomes $.fields.list[0].name."""
    steps = F.transform(F.filter(F.split(dotted, r"\."), lambda x: x != ""), lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(F.lit("["), x, F.lit("]"))).otherwise(F.concat(F.lit("."), x)))
    return F.concat(F.lit("$"), F.array_join(steps, ""))


def answers(responses: DataFrame, profiles: DataFrame) -> DataFrame:
    """responses (system, respuesta: JSON) with external, actor and when, read by the paths of the system's profile.

    A profile is a row, so a new system needs no code. What a path doesn't lead to is null, and so is all of a response that isn't JSON, or
    of a system without a profile.
    """
    rows = responses.join(profiles.withColumnRenamed("system", "_s"), F.col("system") == F.col("_s"), "left")
    body = F.try_parse_json("respuesta")
    at = lambda path: F.when(F.col(path).isNotNull(), F.try_variant_get(body, F.coalesce(json_path(F.col(path)), F.lit("$")), "string"))
    return rows.select(*responses.columns, at("ruta_estado").alias("external"), at("ruta_actor").alias("actor"), at("ruta_cuando").alias("when"))


def translate_by(tickets: DataFrame, columns: DataFrame) -> DataFrame:
    """translate() with meanings from a table (COLUMN) instead of the built-in ones."""
    known = columns.select(F.col("system").alias("_s"), F.lower(F.trim("external")).alias("_x"), F.col("estado").alias("read")).dropDuplicates(["_s", "_x"])
    t = tickets.join(known, (F.col("system") == F.col("_s")) & (F.lower(F.trim("external")) == F.col("_x")), "left").drop("_s", "_x")
    t = t.withColumn("verdict", movement(*[F.col(c) for c in ("current", "read", "actor", "when", "role")]))
    return t.withColumn("after", F.when(F.col("verdict") == "mueve", F.col("read")).otherwise(F.col("current")))


def request_body(template: Column, values: dict[str, Column]) -> Column:
    """A JSON template with {name} in any of its texts replaced; values are escaped, so that none can end a text or add a field."""
    out = template
    for name, value in values.items():
        text = F.to_json(F.struct(F.coalesce(value.cast("string"), F.lit("")).alias("v")))
        out = F.replace(out, F.lit("{" + name + "}"), F.substr(text, F.lit(7), F.length(text) - 8))
    return out
