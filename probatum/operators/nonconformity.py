"""Nonconformities as folds of dated transitions: the state only rises, attributes keep their last value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ORDER = ("abierta", "en_analisis", "con_accion", "ejecutada", "verificada")


def last_known(rows: DataFrame, key: str, order: tuple[str, ...], column: str, name: str) -> DataFrame:
    """Adds the last value of a column that isn't null, up to each row, in a key's order: what a later row leaves out still holds."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(column, ignorenulls=True).over(w))


def rank(state: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in ORDER]), state).cast("int")


def fold(transitions: DataFrame, key: str, when: str, n: str, state: str, *attributes: str) -> DataFrame:
    """Every transition with the state reached so far and the last non-null attributes."""
    w = Window.partitionBy(key).orderBy(when, n).rowsBetween(Window.unboundedPreceding, 0)
    reached = F.max(rank(F.col(state))).over(w)
    out = transitions.withColumn("estado_nc", F.element_at(F.array(*[F.lit(s) for s in ORDER]), reached))
    return out.withColumns({f"ult_{a}": F.last(a, ignorenulls=True).over(w) for a in attributes})


def summary(transitions: DataFrame, key: str, when: str, n: str, state: str, as_of: Column, stalled_days: int = 90) -> DataFrame:
    """One row for each nonconformity: state, opening, whole days open and whether it stalls."""
    g = transitions.groupBy(key).agg(F.max(rank(F.col(state))).alias("r"), F.min(when).alias("abierta_en"), F.max(when).alias("ultima"))
    end = F.when(F.col("r") == len(ORDER), F.col("ultima")).otherwise(as_of)
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col("abierta_en").cast("timestamp"))
    days = F.floor(micros / F.lit(86_400_000_000)).cast("long")
    return g.select(key, F.element_at(F.array(*[F.lit(s) for s in ORDER]), F.col("r")).alias("estado_nc"), "abierta_en", days.alias("dias"), ((F.col("r") < len(ORDER)) & (days > stalled_days)).alias("parada"))


def guard_problems() -> Column:
    """Reasons against a transition (no_conformidad_id, a, quien, cargo, cuando and what its target needs); none means it may be appended."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    needs = {"con_accion": ("accion", "responsable", "compromiso"), "abierta": ("origen", "descripcion"), "verificada": ("evidencia_de_eficacia",)}
    reasons = [F.when(blank(c), f"sin {c}") for c in ("no_conformidad_id", "quien", "cargo", "cuando")]
    reasons += [F.when((F.col("a") == state) & blank(c), f"{state} exige {c}") for state, fields in needs.items() for c in fields]
    return F.array_compact(F.array(*reasons, F.when(rank(F.col("a")) == 0, "estado desconocido")))


def history(transitions: DataFrame, as_of: Column, stalled_days: int = 90) -> DataFrame:
    """One row for each nonconformity: state, whole days open, vencida, estancada and its incoherencies.

    transitions: no_conformidad_id, a, cuando (timestamp), n and the attributes causa_raiz, accion, compromiso (date), of which the last
    that isn't null counts. Overdue: the committed day is past and nobody has verified. Stalled: open for long and nothing committed.
    Incoherent: verified without execution, without cause or action, or before the last execution.
    """
    order = F.struct("cuando", "n")
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c)
    at = lambda s, f, name: f(F.when(F.col("a") == s, F.col("cuando"))).alias(name)
    g = transitions.groupBy("no_conformidad_id").agg(
        F.max(rank(F.col("a"))).alias("r"), F.min("cuando").alias("abierta_en"), F.max("cuando").alias("ultima"), last("causa_raiz"), last("accion"), last("compromiso"),
        at("ejecutada", F.max, "ejecutada_en"), at("verificada", F.min, "verificada_en"),
    )
    closed = F.col("r") == len(ORDER)
    micros = F.unix_micros(F.when(closed, F.col("ultima")).otherwise(as_of).cast("timestamp")) - F.unix_micros(F.col("abierta_en").cast("timestamp"))
    days = F.floor(micros / F.lit(86_400_000_000)).cast("long")
    wrong = F.array_compact(F.array(
        F.when(closed & F.col("ejecutada_en").isNull(), "sin_ejecucion"),
        F.when(closed & (F.col("causa_raiz").isNull() | F.col("accion").isNull()), "sin_causa_o_accion"),
        F.when(closed & (F.col("verificada_en") < F.col("ejecutada_en")), "antes_de_ejecutar"),
    ))
    return g.select(
        "no_conformidad_id", F.element_at(F.array(*[F.lit(s) for s in ORDER]), F.col("r")).alias("estado_nc"), days.alias("dias"),
        (~closed & F.coalesce(as_of.cast("date") > F.col("compromiso"), F.lit(False))).alias("vencida"),
        (~closed & F.col("compromiso").isNull() & (days > stalled_days)).alias("estancada"), wrong.alias("incoherencias"),
    )


def counts(histories: DataFrame) -> DataFrame:
    """One row: how many are in each state, overdue, stalled and incoherent."""
    return histories.agg(*[F.count_if(F.col("estado_nc") == s).alias(s) for s in ORDER], F.count_if("vencida").alias("vencidas"), F.count_if("estancada").alias("estancadas"), F.count_if(F.size("incoherencias") > 0).alias("incoherentes"))
