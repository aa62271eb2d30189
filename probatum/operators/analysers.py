"""A plan from several analysers: each pack names the engine that runs it, and what all of them observe is merged.

The registry maps an engine's name to a function of (trees, rules) that gives two tables: evaluated rows as those of
packs.evaluate, one for each repository and rule, and (repo, paquete, ejecucion, suficiencia). Engines: generico (rules over
files and calls), agentes (the structure of agents), art50 (generation points, marking of artefacts, publication steps).
A pack that names another engine is an error, not a pack that finds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatum.functions.lineage import settled
from probatum.sources import agents

from . import controls, packs
from .rules import RuleSpec, suffixes

# Rules of the Art. 50 control.
IMAGE, TEXT, BOT = "ACT-50-GEN-IMG", "ACT-50-GEN-TXT", "ACT-50-BOT"
UNMARKED, UNREADABLE, ERASED, FRAGILE = "ACT-50-MARCA-AUSENTE", "ACT-50-MARCA-ILEGIBLE", "ACT-50-PIPE-BORRA", "ACT-50-PIPE-FRAGIL"


@dataclass(frozen=True)
class Trees:
    """files: repo, path, text, code, error. calls: repo, path, dotted (line, col). imports: repo, path, module.

    artefacts: repo, path, container, marca, c2pa of images that were supplied; pipelines: repo, pasos (steps of publication).
    """

    files: DataFrame
    calls: DataFrame
    imports: DataFrame
    artefacts: DataFrame | None = None
    pipelines: DataFrame | None = None


def _rows(repos: DataFrame, counted: DataFrame, rules: Sequence[RuleSpec], applies: Column) -> DataFrame:
    """Evaluated rows: repos (repo, further columns) times rules, with counted (repo, regla_id, hallazgos, senal)."""
    table = F.array(*[F.struct(F.lit(r.id).alias("regla_id"), F.lit(r.kind).alias("tipo"), F.lit(r.pack).alias("paquete"), F.lit(r.obligation).alias("obligacion"), F.lit(r.severity).alias("severidad")) for r in rules])
    rows = repos.select("*", F.inline(table)).join(counted, ["repo", "regla_id"], "left")
    here = applies & (F.col("tipo") != "aportado")
    none = F.lit(None).cast("string")
    return rows.select(
        "repo", "paquete", "obligacion", "regla_id", "tipo", "severidad", here.alias("aplicable"), F.when(here, F.coalesce("hallazgos", F.lit(0))).otherwise(0).cast("long").alias("hallazgos"), none.alias("localizacion"),
        F.when(here, F.col("senal")).alias("senal"), F.when(F.col("tipo") == "aportado", "falta_aporte").alias("limite"), none.alias("pregunta"), F.when(F.col("tipo") == "aportado", "aportado").otherwise("presencia").alias("fuerza"),
    )


def generic(trees: Trees, rules: Sequence[RuleSpec]) -> tuple[DataFrame, DataFrame]:
    evaluated = settled(packs.evaluate(trees.files, trees.calls, trees.imports, rules))  # a row for each repository and rule
    run = F.when(F.bool_or("aplicable"), "completada").otherwise("no_aplicable")
    return evaluated, evaluated.groupBy("repo", "paquete").agg(run.alias("ejecucion")).withColumn("suficiencia", F.lit(None).cast("string"))


def _own(outcomes: DataFrame, rules: Sequence[RuleSpec]) -> DataFrame:
    return outcomes.select("repo", F.explode(F.array(*[F.lit(p) for p in sorted({r.pack for r in rules})])).alias("paquete"), "ejecucion", "suficiencia")


def agent_structure(trees: Trees, rules: Sequence[RuleSpec]) -> tuple[DataFrame, DataFrame]:
    """Rules over what agents declare. Signals: tools with an effect, servers that list all their tools, limits, capped delegations."""
    return structure_rows(trees.files.select("repo").distinct(), settled(agents.structure(trees.files)), rules)


def structure_rows(repos: DataFrame, rows: DataFrame, rules: Sequence[RuleSpec]) -> tuple[DataFrame, DataFrame]:
    """The same from rows that were read already (repo, path, kind, name, origin, line, annotations)."""
    tools = settled(agents.tools(rows))
    found = settled(controls.agent_findings(rows, tools))
    n = found.groupBy("repo", "regla_id").agg(F.count("*").alias("hallazgos"))
    seen = rows.groupBy("repo").agg(
        F.bool_or(F.col("kind").isin(*controls.READ)).alias("hay"), F.countDistinct(F.when(F.col("kind") == "server", F.col("name"))).alias("servers"), F.count_if(F.col("kind") == "delegation").alias("delegations"),
        F.bool_or((F.col("kind") == "limit") & (F.col("name") == "pasos")).alias("steps"), F.array_sort(F.collect_set(F.when(F.col("kind") == "limit", F.col("name")))).alias("limits"),
    )  # three kinds of limits at most
    listed = tools.groupBy("repo").agg(F.count("*").alias("tools"), F.count_if(F.col("effect") == "declarado").alias("declared"))
    blind = n.where(F.col("regla_id") == controls.BLIND).select("repo", F.col("hallazgos").alias("blind"))
    facts = seen.join(listed, "repo", "left").join(blind, "repo", "left")
    says = {
        controls.UNDECLARED: F.when(F.col("declared") > 0, F.format_string("%d de %d herramientas declaran su efecto", "declared", "tools")),
        controls.BLIND: F.when((F.col("servers") > 0) & F.col("blind").isNull(), F.format_string("los %d servidores enumeran sus herramientas", "servers")),
        controls.UNLIMITED: F.when(F.size("limits") > 0, F.array_join("limits", ", ")),
        controls.UNCAPPED: F.when((F.col("delegations") > 0) & F.col("steps"), F.format_string("%d delegaciones con tope de pasos", "delegations")),
    }
    signals = F.array(*[F.struct(F.lit(r).alias("regla_id"), x.alias("senal")) for r, x in says.items()])
    counted = facts.where("hay").select("repo", F.inline(signals)).join(n, ["repo", "regla_id"], "full_outer")
    outcomes = controls.agent_outcomes(repos, rows, found)
    scope = repos.join(seen.select("repo", "hay"), "repo", "left")
    return _rows(scope, counted, rules, F.coalesce("hay", F.lit(False))), _own(outcomes, rules)


def generation_sites(calls: DataFrame, imports: DataFrame, rules: Sequence[RuleSpec]) -> DataFrame:
    """(repo, regla_id, path, further columns of calls) of each call that a rule's signature meets, in files that import what it asks for.

    An assistant's entry point counts only in a file that generates text.
    """
    spark = calls.sparkSession
    looks = [r for r in rules if r.signatures]
    signatures = spark.createDataFrame([(r.id, s, bool(r.requires_import)) for r in looks for s in r.signatures], "regla_id string, signature string, bound boolean")
    required = spark.createDataFrame([(r.id, m) for r in looks for m in r.requires_import], "regla_id string, module string")
    met = calls.withColumn("signature", F.explode(suffixes(F.col("dotted")))).join(F.broadcast(signatures), "signature").drop("signature").distinct()  # a catalogue
    allowed = imports.join(F.broadcast(required), "module").select("repo", "path", "regla_id").distinct()  # a catalogue
    sites = met.where("not bound").unionByName(met.where("bound").join(allowed, ["repo", "path", "regla_id"], "left_semi")).drop("bound")
    texts = sites.where(F.col("regla_id") == TEXT).select("repo", "path")
    return sites.where(F.col("regla_id") != BOT).unionByName(sites.where(F.col("regla_id") == BOT).join(texts, ["repo", "path"], "left_semi"))


def article50(trees: Trees, rules: Sequence[RuleSpec]) -> tuple[DataFrame, DataFrame]:
    """From calls to a verdict: where a repository generates, whether artefacts are marked, whether marks survive the declared steps.

    Generating is no finding: generation points are signals. Without generation points nothing applies. An unknown step decides nothing.
    """
    spark, repos = trees.files.sparkSession, trees.files.select("repo").distinct()
    artefacts = trees.artefacts if trees.artefacts is not None else spark.createDataFrame([], "repo string, path string, container string, marca string, c2pa string")
    pipelines = trees.pipelines if trees.pipelines is not None else spark.createDataFrame([], "repo string, pasos array<string>")
    n = generation_sites(trees.calls, trees.imports, rules).groupBy("repo").agg(*[F.count_if(F.col("regla_id") == r).alias(a) for r, a in ((IMAGE, "imagen"), (TEXT, "texto"), (BOT, "bot"))])
    verdict = F.col("veredicto")
    marks = controls.marking_findings(artefacts).groupBy("repo").agg(F.count_if(verdict == "presente").alias("ok"), F.count_if(verdict == "sin_verificar").alias("dudosos"), F.count_if(verdict == "ausente").alias("ausentes"), F.count_if(verdict == "no_reconocida").alias("ilegibles"))
    steps = pipelines.select("repo", controls.durability(F.col("pasos")).alias("cadena"))
    zero = ("imagen", "texto", "bot", "ok", "dudosos", "ausentes", "ilegibles")
    every = repos.join(n, "repo", "left").join(marks, "repo", "left").join(steps, "repo", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})
    every = every.withColumn("genera", (F.col("imagen") > 0) | (F.col("texto") > 0) | (F.col("bot") > 0)).withColumn("leidos", F.expr("ok + dudosos + ausentes + ilegibles"))
    every = settled(every)  # a row for each repository
    # Of a repository that generates images and supplied none, nothing is said about marks or steps.
    looked = F.col("genera") & ~((F.col("imagen") > 0) & (F.col("leidos") == 0))
    lost = lambda name: F.when(looked & F.col("cadena").eqNullSafe(F.lit(name)), F.col("ok")).otherwise(0)  # noqa: E731  each marked artefact takes the steps
    count = {UNMARKED: F.when(looked, F.col("ausentes")).otherwise(0), UNREADABLE: F.when(looked, F.col("ilegibles")).otherwise(0), ERASED: lost("PIPE-BORRA"), FRAGILE: lost("PIPE-FRAGIL")}
    signal = {IMAGE: ("imagen", "%d puntos de generacion de imagen"), TEXT: ("texto", "%d puntos de generacion de texto"), BOT: ("bot", "%d puntos de entrada de asistente")}
    rows = [F.struct(F.lit(r).alias("regla_id"), F.lit(0).cast("long").alias("hallazgos"), F.when(F.col(c) > 0, F.format_string(t, c)).alias("senal")) for r, (c, t) in signal.items()]
    rows += [F.struct(F.lit(r).alias("regla_id"), c.cast("long").alias("hallazgos"), (F.when(looked & (F.col("ok") > 0), F.format_string("%d artefactos con marcado leido", "ok")) if r == UNMARKED else F.lit(None).cast("string")).alias("senal")) for r, c in count.items()]
    counted = every.select("repo", F.inline(F.array(*rows)))
    findings = sum(count.values(), F.lit(0))
    unknown = F.col("cadena").eqNullSafe(F.lit("sin_decidir")) & (F.col("ok") > 0)
    run = F.when(F.col("genera"), "completada").otherwise("no_aplicable")
    enough = (
        F.when(~F.col("genera"), None).when(~looked | unknown, "indeterminada").when(findings > 0, None).when((F.col("dudosos") > 0) | (F.col("ok") == 0), "indeterminada")
        .when((F.col("texto") > 0) | (F.col("bot") > 0), "insuficiente").otherwise("suficiente")
    )
    outcomes = every.select("repo", run.alias("ejecucion"), enough.alias("suficiencia"))
    return _rows(every.select("repo", "genera"), counted, rules, F.col("genera")), _own(outcomes, rules)


ENGINES: dict[str, Callable[[Trees, Sequence[RuleSpec]], tuple[DataFrame, DataFrame]]] = {"generico": generic, "agentes": agent_structure, "art50": article50}


def run(trees: Trees, rules: Sequence[RuleSpec], engines: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Evaluated rows of all packs, each by its engine, and (repo, paquete, ejecucion, suficiencia)."""
    engines = engines or ENGINES
    if lost := sorted({r.engine for r in rules} - engines.keys()):
        raise ValueError(f"packs name engines that there aren't: {lost}")
    parts = [engines[e](trees, [r for r in rules if r.engine == e]) for e in engines if any(r.engine == e for r in rules)]
    return tuple(reduce(DataFrame.unionByName, [p[k] for p in parts]) for k in (0, 1))


def plan(trees: Trees, rules: Sequence[RuleSpec], verdicts: DataFrame, unreadable: DataFrame, engines: dict | None = None) -> DataFrame:
    """Lines of a plan (see packs.plan) from the packs of all engines: what several of them observed for one obligation is added up and judged anew."""
    evaluated, own = run(trees, rules, engines)
    return packs.plan(verdicts, evaluated, unreadable, own)
