"""The evidence log as JSON lines: reading, finding the first break, and moving a log to a new chain.

A line is an object with n, previo, sello and its facts. A seal is the hash of the line's canonical JSON (sorted
keys, no spaces) without the seal. Sealing is sequential within a log, so each log is one ordered stream of
rows that keeps only the seal before; checking isn't, as every seal follows from its own line.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probatum.operators.evidence import chain_breaks

GENESIS = "genesis"
#: Why a line that was moved proves nothing about its past.
UNPROVEN = ("migrada_sin_cadena", "migrada_desde_cadena_rota")


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def seal_of(line: dict) -> str:
    body = canonical_json({k: v for k, v in line.items() if k != "sello"})
    return "sha256:" + hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest()


def _due(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: seal_of(json.loads(x)))


def due_seal(line: Column) -> Column:
    """The seal that a line of valid JSON should have."""
    return F.pandas_udf(_due, "string")(line)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(log, line) of every line that isn't blank below path; log is its file."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.input_file_name().alias("log"), F.col("value").alias("line"))


def parsed(lines: DataFrame) -> DataFrame:
    """Adds n, previo, sello, origen and sello_debido. A line that isn't a JSON object is an error, never skipped."""
    checked = F.when(F.get_json_object("line", "$").startswith("{"), F.col("line")).otherwise(F.raise_error(F.concat(F.lit("unreadable line in the log: "), F.substring("line", 1, 80))))
    at = lambda name: F.get_json_object("line", f"$.{name}").alias(name)
    out = lines.withColumn("line", checked)
    return out.select("*", at("n").cast("long").alias("n"), at("previo"), at("sello"), at("origen"), due_seal(F.col("line")).alias("sello_debido"))


def first_breaks(lines: DataFrame, genesis: str = GENESIS) -> DataFrame:
    """(log, rotura) of each log: the place of the first line at which its chain breaks, null if none does.

    A log without any seal has no break: it never had a chain, which isn't the same as having been altered.
    """
    marked = chain_breaks(parsed(lines), "log", genesis=genesis)
    place = F.min_by("debido", F.struct("n", "sello"))
    broken = marked.where("rota").groupBy("log").agg(place.alias("rotura"))
    sealed = lines.groupBy("log").agg(F.count(F.get_json_object("line", "$.sello")).alias("sellos"))
    return sealed.join(broken, "log", "left").select("log", F.when(F.col("sellos") > 0, F.col("rotura")).alias("rotura"))


def _resealed(genesis: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log, seal, n = None, genesis, 0
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                if r.log != log:
                    log, seal, n = r.log, genesis, 0
                n += 1
                body = {k: v for k, v in json.loads(r.line).items() if k not in ("sello", "origen") and v is not None}
                body |= {"n": n, "previo": seal} | ({"origen": r.mark} if isinstance(r.mark, str) else {})
                seal = body["sello"] = seal_of(body)
                out.append((log, n, body.get("origen"), seal, canonical_json(body)))
            yield pd.DataFrame(out, columns=["log", "n", "origen", "sello", "line"])

    return run


RESEALED = "log string, n long, origen string, sello string, line string"


def migrate(lines: DataFrame, accept_broken: bool = False, genesis: str = GENESIS) -> DataFrame:
    """(log, n, origen, sello, line) of every log under a new chain.

    Lines without a seal, and lines from a break on, are marked inside their new seal. A broken chain is an
    error unless it is accepted, as its break would otherwise vanish. Lines keep the order of n; older lines
    without it must come with a column n.
    """
    rows = lines if "n" in lines.columns else lines.withColumn("n", F.get_json_object("line", "$.n").cast("long"))
    both = rows.select("log", "line", F.col("n").alias("order")).join(first_breaks(rows.select("log", "line"), genesis), "log")
    w = Window.partitionBy("log").orderBy("order")
    sealed = F.get_json_object("line", "$.sello").isNotNull()
    marked = both.withColumn("place", F.row_number().over(w)).withColumn(
        "mark",
        F.when(F.col("place") >= F.col("rotura"), F.lit(UNPROVEN[1]) if accept_broken else F.raise_error(F.concat(F.lit("the chain breaks in "), "log", F.lit(" at "), F.col("rotura").cast("string"))))
        .when(sealed, F.get_json_object("line", "$.origen"))
        .otherwise(UNPROVEN[0]),
    )
    ordered = marked.select("log", "place", "mark", "line").repartition("log").sortWithinPartitions("log", "place")
    return ordered.mapInPandas(_resealed(genesis), RESEALED)


def heads(lines: DataFrame) -> DataFrame:
    """(log, cabeza, lineas): the last seal, to be noted elsewhere, as a cut tail leaves a valid chain."""
    rows = lines.select("log", F.get_json_object("line", "$.n").cast("long").alias("n"), F.get_json_object("line", "$.sello").alias("sello"))
    return rows.groupBy("log").agg(F.max_by("sello", "n").alias("cabeza"), F.count("*").alias("lineas"))
