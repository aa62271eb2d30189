"""Controls with a subject of their own: the structure of agents, and the marking of generated content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ladders

#: Rules of the agents control and of generation (fixed values).
UNDECLARED, BLIND, UNLIMITED, UNCAPPED = "ACT-AG-EFECTO-SIN-DECLARAR", "ACT-AG-SERVIDOR-SIN-INVENTARIO", "ACT-AG-SIN-LIMITES", "ACT-AG-DELEGACION-SIN-TOPE"
WHOLE_STRUCTURE = "(la estructura entera)"
READ = ("tool", "delegation", "server")


def agent_findings(rows: DataFrame, tools: DataFrame) -> DataFrame:
    """(repo, regla_id, localizacion) from structure rows and tools, both with a repo.

    A tool that no place declares; a server that lists no tool; tools or delegations without any limit; delegations
    without a limit of steps. Where nothing was read there is nothing to find.
    """
    seen = rows.groupBy("repo").agg(F.bool_or(F.col("kind").isin(*READ)).alias("hay"), F.bool_or(F.col("kind") == "limit").alias("limites"), F.bool_or((F.col("kind") == "limit") & (F.col("name") == "pasos")).alias("pasos"))
    read = seen.where("hay")
    listed = tools.where("origin = 'mcp'").select("repo", F.split_part("name", F.lit("."), F.lit(1)).alias("name"))
    servers = rows.where("kind = 'server'").select("repo", "name").distinct()
    place = F.when(F.col("line") > 0, F.concat_ws(":", "path", "line")).otherwise(F.col("path"))
    undeclared = tools.where("effect = 'sin_declarar'").select("repo", F.lit(UNDECLARED).alias("regla_id"), F.concat("name", F.lit(" ("), "places", F.lit(")")).alias("localizacion"))
    blind = servers.join(listed, ["repo", "name"], "left_anti").select("repo", F.lit(BLIND).alias("regla_id"), F.col("name").alias("localizacion"))
    unlimited = read.where("not limites").select("repo", F.lit(UNLIMITED).alias("regla_id"), F.lit(WHOLE_STRUCTURE).alias("localizacion"))
    uncapped = rows.where("kind = 'delegation'").join(read.where("not pasos"), "repo", "left_semi").select("repo", F.lit(UNCAPPED).alias("regla_id"), place.alias("localizacion"))
    return undeclared.unionByName(blind).unionByName(unlimited).unionByName(uncapped)


def agent_outcomes(repos: DataFrame, rows: DataFrame, found: DataFrame) -> DataFrame:
    """(repo, ejecucion, suficiencia, hallazgos, resultado): a declared framework of which nothing could be read is undecided, no agent isn't applicable."""
    seen = rows.groupBy("repo").agg(F.bool_or(F.col("kind").isin(*READ)).alias("hay"), F.bool_or(F.col("kind") == "framework").alias("marco"))
    g = repos.select("repo").distinct().join(seen, "repo", "left").join(found.groupBy("repo").agg(F.count("*").alias("h")), "repo", "left")
    read, named = F.coalesce("hay", F.lit(False)), F.coalesce("marco", F.lit(False))
    run = F.when(read | named, "completada").otherwise("no_aplicable")
    n = F.coalesce("h", F.lit(0)).cast("long")
    enough = F.when(~read & named, "indeterminada").when(read & (n == 0), "insuficiente")
    return g.select("repo", run.alias("ejecucion"), enough.alias("suficiencia"), n.alias("hallazgos"), ladders.result(run, n, enough).alias("resultado"))


def marking_findings(artefacts: DataFrame) -> DataFrame:
    """Adds veredicto to artefacts (repo, path, container, marca, c2pa): presente, sin_verificar, no_reconocida, ausente; null for other containers.

    An unrecognised mark or none is a finding; a C2PA store that nobody checked decides nothing.
    """
    mark = F.col("marca")
    verdict = F.when(~F.coalesce(F.col("container").isin("png", "jpeg"), F.lit(False)), None).when(mark.isin("sintetico", "otro"), "presente").when(mark == "no_reconocido", "no_reconocida").when(F.col("c2pa").isNotNull(), "sin_verificar").otherwise("ausente")
    return artefacts.withColumn("veredicto", verdict)


def marking_outcomes(generators: DataFrame, artefacts: DataFrame) -> DataFrame:
    """(repo, ejecucion, suficiencia, hallazgos, resultado) from generators (repo, imagen, texto, bot: calls found; preguntas: open) and artefacts.

    Nothing that generates: not applicable. Findings decide; then what couldn't be verified, no marked image at all, open questions.
    """
    v = F.col("veredicto")
    marks = marking_findings(artefacts).groupBy("repo").agg(F.count_if(v.isin("no_reconocida", "ausente")).alias("h"), F.count_if(v == "sin_verificar").alias("d"), F.count_if(v == "presente").alias("ok"))
    g = generators.join(marks, "repo", "left")
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    run = F.when(some("imagen") | some("texto") | some("bot"), "completada").otherwise("no_aplicable")
    n = F.when(run == "completada", F.coalesce("h", F.lit(0))).otherwise(0).cast("long")
    enough = F.when((run == "no_aplicable") | (n > 0), None).when(some("d"), "indeterminada").when(~some("ok"), "indeterminada").when(some("preguntas"), "insuficiente").otherwise("suficiente")
    return g.select("repo", run.alias("ejecucion"), enough.alias("suficiencia"), n.alias("hallazgos"), ladders.result(run, n, enough).alias("resultado"))


#: Steps of a publication pipeline that are known; one erases metadata on purpose (fixed values).
STEPS = ("recomprimir_jpeg_85", "recomprimir_jpeg_60", "redimensionar_mitad", "recortar_10", "rotar_90", "a_jpeg", "a_png", "quitar_metadatos")
ERASES = "quitar_metadatos"


def durability(steps: Column) -> Column:
    """PIPE-BORRA, PIPE-FRAGIL, sin_decidir or null for the steps of a pipeline.

    Each step writes the image anew. Where metadata are carried over, a mark dies only in the step that erases them; where they
    aren't, in any. It dies even when carried over: PIPE-BORRA; only otherwise: PIPE-FRAGIL. An unknown step decides nothing.
    """
    unknown = F.size(F.array_except(steps, F.array(*[F.lit(s) for s in STEPS]))) > 0
    return F.when(F.coalesce(F.size(steps), F.lit(0)) <= 0, None).when(unknown, "sin_decidir").when(F.array_contains(steps, ERASES), "PIPE-BORRA").otherwise("PIPE-FRAGIL")
