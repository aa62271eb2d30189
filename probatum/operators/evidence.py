"""The evidence log: appending and revoking, latest record, state as of a moment, reconciliation, chain checks.

Log rows: n, tipo (observacion, revalidacion, revocacion), registro_id, control_id, sujeto_digest, contenido, cuando. Nothing is
ever changed or deleted: every state is derived from the rows and a moment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What each state asks for, and freshness in days by level.
ACTION = {"valida": "nada", "rancia": "reobservar", "superada": "reobservar", "revocada": "reobservar", "no_fiable": "corregir", "fuera_de_alcance": "nada", "sin_evidencia": "reobservar"}
FRESHNESS = {"maquina": 30, "generable": 90, "juzgada": 180, "organizativa": 365}


def lookup(column: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), column)


def latest(log: DataFrame, key: str = "control_id", when: str = "observado_en", n: str = "n") -> DataFrame:
    """The newest record of each key; of equal times the first appended. A struct maximum, combined map-side."""
    others = [c for c in log.columns if c != key]
    best = F.max_by(F.struct(*others), F.struct(F.col(when), -F.col(n)))
    return log.groupBy(key).agg(best.alias("r")).select(key, "r.*")


def state_of(declared: Column, revoked: Column, trusted: Column, subject: Column, now: Column, seen_at: Column, again_at: Column, days: Column, as_of: Column) -> Column:
    """The first that holds: not declared valid, revoked, untrusted (as what is unknown is), superseded, stale, valid."""
    seen = F.greatest(seen_at, again_at)
    stale = days.isNotNull() & (as_of > seen + F.make_dt_interval(days))
    return (
        F.when(declared != "valida", declared)
        .when(F.coalesce(revoked, F.lit(False)), "revocada")
        .when(~F.coalesce(trusted, F.lit(False)), "no_fiable")
        .when(now.isNotNull() & ~now.eqNullSafe(subject), "superada")
        .when(stale, "rancia")
        .otherwise("valida")
    )


def state(as_of: Column) -> Column:
    """Of joined rows (estado_declarado, revocada, confiable, sujeto_digest, digest_actual, observado_en, revalidado_en, frescura_dias)."""
    return state_of(*[F.col(c) for c in ("estado_declarado", "revocada", "confiable", "sujeto_digest", "digest_actual", "observado_en", "revalidado_en", "frescura_dias")], as_of)


def reconcile(latest_rows: DataFrame, expected: DataFrame | None, as_of: Column) -> DataFrame:
    """Verdict of each control: its state, out of scope, or without evidence.

    expected None means that nobody looked: then nothing is out of scope and nothing is missing.
    """
    rows = latest_rows.withColumn("estado", state(as_of))
    if expected is None:
        out = rows.select("control_id", "estado")
    else:
        joined = rows.withColumn("visto", F.lit(True)).join(expected.select("control_id").withColumn("esperado", F.lit(True)), "control_id", "full_outer")
        outside = F.col("esperado").isNull() & F.col("digest_actual").isNull()
        out = joined.select("control_id", F.when(F.col("visto").isNull(), "sin_evidencia").when(outside, "fuera_de_alcance").otherwise(F.col("estado")).alias("estado"))
    return out.withColumn("accion", lookup(F.col("estado"), ACTION))


def split_revalidations(log: DataFrame, *key: str) -> DataFrame:
    """Each record is an observation if its content is new for its key, else a revalidation."""
    first = log.groupBy(*key).agg(F.min("n").alias("primero"))
    return log.join(first, list(key)).withColumn("tipo", F.when(F.col("n") == F.col("primero"), "observacion").otherwise("revalidacion")).drop("primero")


#: Lines of a log that one task checks in order.
RUN = 8_192


def chain_breaks(log: DataFrame, tenant: str, run: int = RUN, genesis: str = "genesis") -> DataFrame:
    """Adds rota: n not consecutive, previo not the seal before, or a seal that isn't its line's hash; tachada: it or a line before it is; and debido, its due n.

    Logs are checked in runs of so many n, side by side: a run's first line meets the last of the run before, of which there is one row a
    run. What is ordered by a log as a whole are these rows, not its lines, so a long log is no task of its own. Lines of equal n are
    told apart by their seals; lines without n come first, and are breaks.
    """
    rows = log.withColumn("_tramo", F.coalesce(F.floor(F.col("n") / run), F.lit(-1)).cast("long"))
    runs, order = Window.partitionBy(tenant, "_tramo"), Window.partitionBy(tenant).orderBy("_tramo")

    def by_run(df: DataFrame, *made: Column) -> DataFrame:
        """Adds made, computed over runs, to every line of a run."""
        few = made[0].select(F.col(tenant).alias("_de"), F.col("_tramo").alias("_en"), *made[1:])
        return df.join(few, F.col(tenant).eqNullSafe(F.col("_de")) & (F.col("_tramo") == F.col("_en"))).drop("_de", "_en")

    ends = rows.groupBy(tenant, "_tramo").agg(F.max(F.struct("n", "sello")).alias("_fin"))
    placed = by_run(rows, ends, F.lag("_fin").over(order).alias("_fin"))
    line = runs.orderBy("n", "sello")
    first = F.row_number().over(line) == 1
    before, n_before = F.when(first, F.col("_fin.sello")).otherwise(F.lag("sello").over(line)), F.when(first, F.col("_fin.n")).otherwise(F.lag("n").over(line))
    due, start = F.coalesce(n_before + 1, F.lit(1)), first & F.col("_fin").isNull()
    # A line without a seal or a predecessor proves nothing: it is a break, not an unknown.
    follows = F.col("previo").isNotNull() & F.col("previo").eqNullSafe(F.when(start, genesis).otherwise(before))
    broken = F.coalesce(F.col("n") != due, F.lit(True)) | ~follows | F.coalesce(F.col("sello") != F.col("sello_debido"), F.lit(True))
    marked = placed.withColumn("rota", broken).withColumn("debido", due.cast("long"))
    marked = marked.withColumn("_aqui", F.max(F.col("rota").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    earlier = F.max("_rota").over(order.rowsBetween(Window.unboundedPreceding, -1))
    tainted = by_run(marked, marked.groupBy(tenant, "_tramo").agg(F.bool_or("rota").alias("_rota")), F.coalesce(earlier, F.lit(False)).alias("_ya"))
    return tainted.withColumn("tachada", F.col("_aqui") | F.col("_ya")).drop("_tramo", "_fin", "_aqui", "_ya")


def sufficiency(states: DataFrame, by: str) -> DataFrame:
    """suficiente only if every record is valid; valid ids stay either way."""
    g = states.groupBy(by).agg(F.count("estado").alias("registros"), F.count_if(F.col("estado") == "valida").alias("validas"))
    return g.withColumn("suficiencia", F.when((F.col("registros") > 0) & (F.col("registros") == F.col("validas")), "suficiente").otherwise("insuficiente")).withColumn("huecos", F.col("registros") - F.col("validas"))


def keyed(records: DataFrame) -> DataFrame:
    """Adds clave: what makes two records of a control the same, its subject and its content as canonical JSON."""
    return records.withColumn("clave", F.sha2(F.concat_ws("\x1f", F.col("control_id").cast("string"), F.coalesce("sujeto_digest", F.lit("")), F.coalesce("contenido", F.lit(""))), 256))


def append(log: DataFrame, records: DataFrame, offset: int) -> DataFrame:
    """Rows to append for records (control_id, sujeto_digest, contenido, cuando, orden): observations of what is new, else revalidations.

    Any earlier record of the same control, subject and content counts, also one earlier in the batch; a revalidation
    names the last of them that was appended. offset: rows in the log.
    """
    seen = keyed(log.where("tipo = 'observacion'")).groupBy("clave").agg(F.max_by("registro_id", "n").alias("ya"))
    fresh = keyed(records)
    once = fresh.groupBy("clave").agg(F.min("orden").alias("primera"))
    rows = fresh.join(once, "clave").join(seen, "clave", "left")
    new = F.col("ya").isNull() & (F.col("orden") == F.col("primera"))
    own = F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\x1f", "clave", F.col("cuando").cast("string")), 256))
    named = rows.withColumn("propio", own)
    first = named.where(F.col("orden") == F.col("primera")).select("clave", F.col("propio").alias("primero"))
    out = named.join(first, "clave").select(
        (F.col("orden") + offset).alias("n"), F.when(new, "observacion").otherwise("revalidacion").alias("tipo"), F.coalesce("ya", "primero").alias("registro_id"),
        "control_id", "sujeto_digest", "contenido", "cuando",
    )
    return out


def revoke(log: DataFrame, revocations: DataFrame, offset: int) -> DataFrame:
    """Rows to append for revocations (registro_id, motivo, quien, cuando, orden); of an unknown record, an error."""
    known = log.where("tipo = 'observacion'").select("registro_id").distinct().withColumn("hay", F.lit(True))
    checked = revocations.join(known, "registro_id", "left")
    named = F.when(F.col("hay"), F.col("registro_id")).otherwise(F.raise_error(F.concat(F.lit("no such record: "), F.coalesce("registro_id", F.lit("null")))))
    return checked.select((F.col("orden") + offset).alias("n"), F.lit("revocacion").alias("tipo"), named.alias("registro_id"), "motivo", "quien", "cuando")


def records_of(log: DataFrame) -> DataFrame:
    """Each observation with its latest revalidation (revalidado_en) and whether it is revoked."""
    later = log.groupBy(F.col("registro_id").alias("r")).agg(F.max(F.when(F.col("tipo") == "revalidacion", F.col("cuando"))).alias("revalidado_en"), F.bool_or(F.col("tipo") == "revocacion").alias("revocada"))
    seen = log.where("tipo = 'observacion'").join(later, F.col("registro_id") == F.col("r")).drop("r")
    return seen.withColumnRenamed("cuando", "observado_en")


def retained(rows: DataFrame, most: int, *order: Column) -> DataFrame:
    """The first rows in an order, at most so many: what a bounded register of failures keeps. That bound is the operator."""
    return rows.orderBy(*order).limit(most)


def log_counts(log: DataFrame) -> DataFrame:
    """One row: rows, records, distinct controls and subjects."""
    seen = F.col("tipo") == "observacion"
    return log.agg(F.count("*").alias("lineas"), F.count_if(seen).alias("registros"), F.countDistinct(F.when(seen, F.col("control_id"))).alias("controles"), F.countDistinct(F.when(seen, F.col("sujeto_digest"))).alias("sujetos"))


def work_saved(reconciled: DataFrame) -> DataFrame:
    """One row: controls whose evidence still counts, and those to be looked at again."""
    return reconciled.agg(F.count_if(F.col("estado") == "valida").alias("con_evidencia"), F.count_if(F.col("accion") == "reobservar").alias("a_reobservar"))


def verified(records: DataFrame) -> DataFrame:
    """Adds integro: whether a record's id is the digest of its own content."""
    due = F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\x1f", "clave", F.col("cuando").cast("string")), 256))
    return keyed(records).withColumn("integro", F.col("registro_id").eqNullSafe(due)).drop("clave")


def watch(log: DataFrame, current: DataFrame | None, expected: DataFrame | None, as_of: Column) -> DataFrame:
    """(control_id, estado, accion) of every control, from the log alone or with the subjects' digests of today.

    log: log rows with estado_declarado, confiable and frescura_dias. current: control_id, digest_actual, of the controls that were looked at; None: nobody
    looked, and nothing is superseded, missing or out of scope.
    """
    last = latest(records_of(log), "control_id", "observado_en", "n")
    rows = last.join(current, "control_id", "left") if current is not None else last.withColumn("digest_actual", F.lit(None).cast("string"))
    return reconcile(rows, expected if current is not None else None, as_of)
