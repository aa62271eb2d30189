"""Rule packs over repositories: all six kinds of rules, their findings, a pack's outcome and subject, and the plan.

files: repo, path, text, code (text stripped of prose, null for documentation), error. calls: repo, path, dotted.
imports: repo, path, module. Rules are a catalogue of fixed size: they are tested in one pass over the texts, and
calls meet signatures in one equi-join. A repository is a key, so any number of them is evaluated at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ladders
from .rules import ON_PATHS, STRENGTH, WHOLE_REPOSITORY, RuleSpec, any_match, in_scope, suffixes

CALLS, TEXTS = ("llamada", "llamada_sin_pareja"), ("contenido", "contenido_prohibido")
#: Limits that every execution states (fixed values).
LIMITS = ("código en lenguajes que este motor no lee", "llamadas construidas en ejecución o por getattr")
FALLBACK = "(ninguno casa {})"


def rule_problems(rules: Sequence[RuleSpec]) -> list[tuple[str, str]]:
    """(rule, what is wrong): unknown kinds, fields that a kind needs, ids that occur twice."""
    needs = {"llamada": ("signatures",), "llamada_sin_pareja": ("signatures", "pair"), "fichero": ("patterns",), "contenido": ("patterns",), "contenido_prohibido": ("patterns",), "aportado": ("question",)}
    own = [r for r in rules if r.engine == "generico"]
    out = [(r.id, "tipo") for r in own if r.kind not in needs]
    out += [(r.id, f) for r in own for f in needs.get(r.kind, ()) if not getattr(r, f)]
    ids = [r.id for r in rules]
    return out + [(i, "repetida") for i in sorted({i for i in ids if ids.count(i) > 1})]


def _source(r: RuleSpec) -> Column:
    return F.col("text") if r.documentation else F.col("code")


def file_facts(files: DataFrame, rules: Sequence[RuleSpec]) -> DataFrame:
    """(repo, regla_id, casan, primero, en_ambito, leidos) of rules over paths and texts; hits are columns, tested once."""
    looks = [r for r in rules if r.kind == "fichero" or r.kind in TEXTS]
    marks = []
    for i, r in enumerate(looks):
        scope = F.lit(True) if r.kind == "fichero" else _source(r).isNotNull() & in_scope(r)
        hit = any_match(F.col("path"), r.patterns, ON_PATHS) if r.kind == "fichero" else scope & any_match(_source(r), r.patterns)
        marks += [scope.alias(f"s{i}"), F.coalesce(hit, F.lit(False)).alias(f"h{i}")]
    marked = files.select("repo", "path", F.col("text").isNotNull().alias("is_text"), F.col("code").isNotNull().alias("is_code"), *marks)
    counts = [x for i in range(len(looks)) for x in (F.count_if(f"h{i}").alias(f"n{i}"), F.min(F.when(F.col(f"h{i}"), F.col("path"))).alias(f"p{i}"), F.count_if(f"s{i}").alias(f"e{i}"))]
    wide = marked.groupBy("repo").agg(F.count_if("is_text").alias("texts"), F.count_if("is_code").alias("codes"), *counts)
    rows = [F.struct(F.lit(r.id).alias("regla_id"), F.col(f"n{i}").alias("casan"), F.col(f"p{i}").alias("primero"), F.col(f"e{i}").alias("en_ambito"), F.col("texts" if r.documentation else "codes").alias("leidos")) for i, r in enumerate(looks)]
    return wide.select("repo", F.inline(F.array(*rows))) if rows else wide.select("repo", F.lit("").alias("regla_id"), *[F.lit(0).alias(c) for c in ("casan", "primero", "en_ambito", "leidos")]).limit(0)


def call_files(calls: DataFrame, imports: DataFrame, rules: Sequence[RuleSpec]) -> DataFrame:
    """(repo, path, regla_id, pareja) of files that call a rule's signatures, under its imports, or its pair's, under any."""
    spark, looks = calls.sparkSession, [r for r in rules if r.kind in CALLS]
    signatures = spark.createDataFrame([(r.id, s, False, bool(r.requires_import)) for r in looks for s in r.signatures] + [(r.id, s, True, False) for r in looks for s in r.pair], "regla_id string, signature string, pareja boolean, bound boolean")
    required = spark.createDataFrame([(r.id, m) for r in looks for m in r.requires_import], "regla_id string, module string")
    met = calls.select("repo", "path", F.explode(suffixes(F.col("dotted"))).alias("signature")).join(F.broadcast(signatures), "signature")  # a catalogue
    met = met.select("repo", "path", "regla_id", "pareja", "bound").distinct()
    allowed = imports.join(F.broadcast(required), "module").select("repo", "path", "regla_id")  # a catalogue
    bound = met.where("bound").join(allowed, ["repo", "path", "regla_id"], "left_semi")
    return met.where("not bound").unionByName(bound).select("repo", "path", "regla_id", "pareja")


def findings(files: DataFrame, calls: DataFrame, imports: DataFrame, rules: Sequence[RuleSpec]) -> DataFrame:
    """(repo, regla_id, localizacion) of findings that lie in a file: calls, calls without pair, forbidden content."""
    at = call_files(calls, imports, rules)
    alone = [r.id for r in rules if r.kind == "llamada_sin_pareja"]
    plain = at.where(~F.col("pareja") & ~F.col("regla_id").isin(alone))
    unpaired = at.where(~F.col("pareja") & F.col("regla_id").isin(alone)).join(at.where("pareja"), ["repo", "path", "regla_id"], "left_anti")
    bad = [r for r in rules if r.kind == "contenido_prohibido"]
    hits = F.array_compact(F.array(*[F.when(_source(r).isNotNull() & in_scope(r) & any_match(_source(r), r.patterns), F.lit(r.id)) for r in bad], F.lit(None).cast("string")))
    held = files.select("repo", "path", F.explode(hits).alias("regla_id"))
    return plain.unionByName(unpaired, allowMissingColumns=True).select("repo", "regla_id", "path").unionByName(held).withColumnRenamed("path", "localizacion")


def evaluate(files: DataFrame, calls: DataFrame, imports: DataFrame, rules: Sequence[RuleSpec]) -> DataFrame:
    """A row for each repository and rule: aplicable, hallazgos (how many), localizacion, senal, limite, pregunta, fuerza."""
    by_rule = lambda f: F.create_map(*[F.lit(x) for r in rules for x in (r.id, f(r))])
    table = F.array(*[F.struct(F.lit(r.id).alias("regla_id"), F.lit(r.kind).alias("tipo"), F.lit(r.pack).alias("paquete"), F.lit(r.obligation).alias("obligacion"), F.lit(r.severity).alias("severidad")) for r in rules])
    every = files.groupBy("repo").agg(F.count_if(F.col("path").endswith(".py") & F.col("error").isNull()).alias("python")).select("repo", "python", F.inline(table))
    at = call_files(calls, imports, rules)
    pairs = at.groupBy("repo", "path", "regla_id").agg(F.bool_or("pareja").alias("paired"), F.bool_or(~F.col("pareja")).alias("fires")).where("fires")
    called = pairs.groupBy("repo", "regla_id").agg(F.count("*").alias("sitios"), F.count_if(~F.col("paired")).alias("sin_pareja"))
    rows = every.join(file_facts(files, rules), ["repo", "regla_id"], "left").join(called, ["repo", "regla_id"], "left")
    n, sites, lone = (F.coalesce(c, F.lit(0)).cast("long") for c in ("casan", "sitios", "sin_pareja"))
    kind, guarded = F.col("tipo"), by_rule(lambda r: r.guarded and bool(r.only_in))[F.col("regla_id")]
    text = kind.isin(*TEXTS)
    no_file = text & guarded & (F.col("en_ambito") == 0)
    applies = (kind != "aportado") & ~no_file & ~((kind == "llamada_sin_pareja") & (sites == 0))
    count = F.when(~applies, 0).when(kind == "llamada", sites).when(kind == "llamada_sin_pareja", lone).when(kind == "contenido_prohibido", n).otherwise((n == 0).cast("long"))
    scope = by_rule(lambda r: r.only_in or WHOLE_REPOSITORY)[F.col("regla_id")]
    signal = (
        F.when(kind == "llamada", F.format_string("ninguna aparicion en %d ficheros Python", "python"))
        .when(kind == "llamada_sin_pareja", F.format_string("los %d sitios tienen su pareja en el mismo fichero", sites))
        .when(kind == "fichero", F.format_string("%d ficheros casan (%s)", n, F.col("primero")))
        .when(kind == "contenido_prohibido", F.format_string("ninguna aparicion en %d ficheros", F.coalesce("leidos", F.lit(0)).cast("long")))
        .otherwise(F.col("primero"))
    )
    return rows.select(
        "repo", "paquete", "obligacion", "regla_id", "tipo", "severidad", applies.alias("aplicable"), count.cast("long").alias("hallazgos"),
        F.when(applies & (count > 0) & kind.isin("fichero", "contenido"), F.when(kind == "fichero", F.lit(WHOLE_REPOSITORY)).otherwise(scope)).alias("localizacion"),
        F.when(applies & (count == 0), signal).alias("senal"),
        F.when(kind == "aportado", "falta_aporte").when(no_file, "fuera_del_alcance_de_la_regla").alias("limite"),
        by_rule(lambda r: r.question)[F.col("regla_id")].alias("pregunta"),
        F.create_map(*[F.lit(x) for kv in STRENGTH.items() for x in kv])[kind].alias("fuerza"),
    )


def outcomes(evaluated: DataFrame, unreadable: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """A row for each repository and pack: its execution, result and counts; unreadable: repo, ilegibles.

    Nothing applicable isn't the same as nothing found. Limits: those of the rules, the fixed ones, and one for unreadable files.
    own: repo, paquete, ejecucion, suficiencia, where an analyser says these itself; then suficiencia is a column, too.
    """
    g = evaluated.groupBy("repo", "paquete", "obligacion").agg(
        F.count("*").alias("reglas"), F.count_if("aplicable").alias("aplicables"), F.sum("hallazgos").alias("hallazgos"),
        F.count("senal").alias("senales"), F.count("pregunta").alias("preguntas"), F.count("limite").alias("l"),
        *[F.count_if(F.col("senal").isNotNull() & (F.col("fuerza") == f)).alias(f) for f in ("comportamiento", "presencia", "aportado")],
        F.array_sort(F.collect_set(F.when(F.col("senal").isNotNull(), F.col("regla_id")))).alias("controles_cubiertos"),
    )  # a pack's rules are a catalogue of fixed size
    g = g.join(unreadable, "repo", "left")
    execution = F.when(F.col("aplicables") == 0, "no_aplicable").otherwise("completada")
    limits = F.col("l") + len(LIMITS) + (F.coalesce("ilegibles", F.lit(0)) > 0).cast("int")
    enough = F.lit(None).cast("string")
    if own is not None:
        g = g.join(own.select("repo", "paquete", F.col("ejecucion").alias("dicha"), "suficiencia"), ["repo", "paquete"], "left")
        execution, enough = F.coalesce("dicha", execution), F.col("suficiencia")
    out = g.withColumn("ejecucion", execution).withColumn("limites", limits.cast("long")).withColumn("resultado", ladders.result(execution, F.col("hallazgos"), enough))
    return out.drop("l", "ilegibles", "dicha")


def plan(verdicts: DataFrame, evaluated: DataFrame, unreadable: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """A line for each repository and obligation: state, findings, open questions and the strongest signal.

    verdicts: repo, obligacion, nivel, situacion. Packs of one obligation are merged: what they observed is added up, and the result
    is projected anew. own: as for outcomes; of several packs the first by name that judges sufficiency counts, and a result that
    it leaves undecided asks for one more contribution.
    """
    packs = outcomes(evaluated, unreadable, own)
    said = F.col("suficiencia") if own is not None else F.lit(None).cast("string")
    merged = packs.groupBy("repo", "obligacion").agg(
        F.count("*").alias("paquetes"), F.sum("hallazgos").alias("hallazgos"), F.sum("preguntas").alias("preguntas"), F.bool_and(F.col("ejecucion") == "no_aplicable").alias("nada"),
        F.min(F.when(said.isNotNull(), F.struct("paquete", said.alias("s")))).alias("juicio"),
        *[F.sum(f).alias(f) for f in ("comportamiento", "presencia", "aportado")], F.array_sort(F.array_distinct(F.flatten(F.collect_list("controles_cubiertos")))).alias("controles_cubiertos"),
    )
    lines = verdicts.join(merged, ["repo", "obligacion"], "left")
    binds, none = F.col("situacion") == "ata", F.coalesce("paquetes", F.lit(0)) == 0
    result = ladders.result(F.when(F.col("nada"), "no_aplicable").otherwise("completada"), F.col("hallazgos"), F.col("juicio.s"))
    asked = F.col("preguntas") + F.coalesce((result == "indeterminado").cast("int"), F.lit(0))
    state = ladders.plan_line(F.col("situacion"), F.coalesce("paquetes", F.lit(0)), F.col("nivel") == "organizativa", result, F.col("preguntas"))
    open_ = F.when(F.col("situacion") == "indeterminada", 1).when(binds & none & (F.col("nivel") != "organizativa"), 1).when(binds & ~none, asked).otherwise(0)
    strongest = F.when(~binds, None).when(F.col("comportamiento") > 0, "comportamiento").when(F.col("presencia") > 0, "presencia").when(F.col("aportado") > 0, "aportado")
    covered = F.when(binds & ~none, F.col("controles_cubiertos")).otherwise(F.array().cast("array<string>"))
    return lines.select("repo", "obligacion", "situacion", state.alias("estado"), F.when(binds, F.coalesce("hallazgos", F.lit(0))).otherwise(0).cast("long").alias("hallazgos"), open_.cast("long").alias("preguntas"), strongest.alias("fuerza_maxima"), covered.alias("controles_cubiertos"))


def exit_codes(lines: DataFrame) -> DataFrame:
    """(repo, salida): 1 if a line has findings, else 3 if one is open, else 0."""
    open_ = F.col("estado").isin("sin_resolver", "a_preguntar", "solo_formulario")
    return lines.groupBy("repo").agg(F.when(F.sum("hallazgos") > 0, 1).when(F.bool_or(open_), 3).otherwise(0).alias("salida"))


def requirement_states(requirements: DataFrame, lines: DataFrame, hit: DataFrame, asked: DataFrame) -> DataFrame:
    """(repo, requisito, estado) from requirements (requisito, obligacion, cubierto_por), and the rules of (repo, obligacion) that hit or ask.

    Uncovered, a finding, an open question, checked, a form (F-...), not assessed: the first that holds.
    """
    gathered = lambda df, name: df.groupBy("repo", "obligacion").agg(F.collect_set("regla_id").alias(name))  # noqa: E731  a catalogue's rules
    rows = requirements.join(lines.select("repo", "obligacion", "controles_cubiertos"), "obligacion").join(gathered(hit, "con"), ["repo", "obligacion"], "left").join(gathered(asked, "pide"), ["repo", "obligacion"], "left")
    meets = lambda c: F.arrays_overlap("cubierto_por", F.coalesce(c, F.array().cast("array<string>")))
    state = (
        F.when(F.size("cubierto_por") == 0, "sin_cubrir").when(meets("con"), "con_hallazgos").when(meets("pide"), "a_preguntar").when(meets("controles_cubiertos"), "comprobado")
        .when(F.exists("cubierto_por", lambda x: x.startswith("F-")), "a_preguntar").otherwise("no_evaluado")
    )
    return rows.select("repo", "requisito", state.alias("estado"))


def subject_files(files: DataFrame, imports: DataFrame, rules: Sequence[RuleSpec]) -> DataFrame:
    """(repo, paquete, path) of what a pack's rules read; a file rule that matches nothing leaves a marker."""
    marks = []
    for r in rules:
        if r.kind in CALLS and not r.requires_import:
            marks.append(F.when(F.col("path").endswith(".py") & F.col("error").isNull(), F.lit(r.pack)))
        elif r.kind == "fichero":
            marks.append(F.when(any_match(F.col("path"), r.patterns, ON_PATHS), F.lit(r.pack)))
        elif r.kind in TEXTS:
            marks.append(F.when(_source(r).isNotNull() & in_scope(r), F.lit(r.pack)))
    read = files.select("repo", "path", F.explode(F.array_distinct(F.array_compact(F.array(*marks, F.lit(None).cast("string"))))).alias("paquete"))
    needs = files.sparkSession.createDataFrame([(r.pack, m) for r in rules if r.kind in CALLS for m in r.requires_import], "paquete string, module string")
    called = imports.join(F.broadcast(needs), "module").select("repo", "path", "paquete")  # a catalogue
    looks = [r for r in rules if r.kind == "fichero"]
    none = file_facts(files, looks).where("casan = 0").select("repo", F.format_string(FALLBACK.format("%s"), "regla_id").alias("path"), F.create_map(*[F.lit(x) for r in looks for x in (r.id, r.pack)])[F.col("regla_id")].alias("paquete")) if looks else None
    out = read.unionByName(called).distinct()
    return out.unionByName(none) if none is not None else out


BUCKETS = 64


def subject_digests(files: DataFrame, imports: DataFrame, rules: Sequence[RuleSpec]) -> DataFrame:
    """(repo, paquete, sujeto_digest, ficheros): moves with the content and names of what the pack reads, and with its version.

    Files are digested in order by share of the path's hash, then shares in order, so that no row holds a
    whole repository's names.
    """
    body = files.select("repo", "path", F.when(F.col("text").isNotNull(), F.sha2("text", 256)).otherwise("(ilegible)").alias("d"))
    rows = subject_files(files, imports, rules).join(body, ["repo", "path"], "left").withColumn("d", F.coalesce("d", F.lit("(ausente)")))
    shares = rows.groupBy("repo", "paquete", F.pmod(F.crc32("path"), F.lit(BUCKETS)).alias("b")).agg(F.array_sort(F.collect_list(F.struct("path", "d"))).alias("x"), F.count("*").alias("n"))
    shares = shares.select("repo", "paquete", "b", "n", F.sha2(F.array_join(F.transform("x", lambda f: F.concat(f["path"], F.lit(":"), f["d"])), "\n"), 256).alias("h"))
    versions = F.create_map(*[F.lit(x) for r in {r.pack: r for r in rules}.values() for x in (r.pack, r.version)])
    whole = shares.groupBy("repo", "paquete").agg(F.array_sort(F.collect_list(F.struct("b", "h"))).alias("x"), F.sum("n").alias("ficheros"))  # BUCKETS shares at most
    digest = F.sha2(F.concat_ws("\n", "paquete", versions[F.col("paquete")], F.array_join(F.transform("x", lambda s: F.concat(s["b"].cast("string"), F.lit(":"), s["h"])), "\n")), 256)
    return whole.select("repo", "paquete", digest.alias("sujeto_digest"), "ficheros")


def merged_limits(limits: DataFrame) -> DataFrame:
    """(obligacion, limites): limits of several packs (obligacion, orden, por_que, que), one for each (por_que, que), in their first order."""
    once = limits.groupBy("obligacion", "por_que", "que").agg(F.min("orden").alias("orden"))
    return once.groupBy("obligacion").agg(F.transform(F.array_sort(F.collect_list(F.struct("orden", "por_que", "que"))), lambda x: F.concat_ws(": ", x["por_que"], x["que"])).alias("limites"))


def pack_index(packs: DataFrame) -> DataFrame:
    """(obligacion, paquetes): the packs of each obligation, sorted; a catalogue."""
    return packs.groupBy("obligacion").agg(F.array_sort(F.collect_set("paquete")).alias("paquetes"))

