"""Rule evaluation over tables of files, call sites and imports.

files: path, text. calls: path, dotted. imports: path, module. Rules are data: lists of RuleSpec. All
patterns of a batch are tested in one pass over the texts; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHOLE_REPOSITORY = "(el repositorio entero)"
#: What a rule of each type can claim (fixed values).
STRENGTH = {"llamada": "comportamiento", "llamada_sin_pareja": "comportamiento", "fichero": "presencia", "contenido": "presencia", "contenido_prohibido": "presencia", "aportado": "aportado"}


@dataclass(frozen=True)
class RuleSpec:
    id: str
    kind: str
    severity: str = "alta"
    patterns: Sequence[str] = ()
    only_in: str | None = None
    signatures: Sequence[str] = ()
    pair: Sequence[str] = ()
    requires_import: Sequence[str] = field(default_factory=tuple)
    #: The package, and what it says of its rules.
    pack: str = ""
    version: str = "1"
    obligation: str = ""
    #: Content rules read code, or all text if documentation; guarded ones don't apply where only_in matches no file.
    documentation: bool = False
    guarded: bool = False
    question: str | None = None
    #: The analyser that runs the package.
    engine: str = "generico"


#: Patterns of rules mean what Python's re means by them: Unicode classes, boundaries and case, lines end at a line feed.
ON_PATHS, ON_TEXT = "(?Ud)", "(?Udm)"


def any_match(column: Column, patterns: Sequence[str], flags: str = ON_TEXT) -> Column:
    return reduce(lambda a, b: a | b, [column.rlike(flags + p) for p in patterns], F.lit(False))


def in_scope(rule: RuleSpec) -> Column:
    return F.col("path").rlike(ON_PATHS + rule.only_in) if rule.only_in else F.lit(True)


def content_rules(files: DataFrame, rules: Sequence[RuleSpec]) -> DataFrame:
    """(regla_id, tipo, severidad, casan, primero, fuera_de_ambito, estado) for file and content rules.

    One scan and one aggregation for all rules. `contenido` and `fichero` want a match: one gives a signal
    on the first path, none a finding; for `contenido_prohibido` each match is a finding. A rule whose scope
    holds no file does not apply. Other kinds need calls: see packs.evaluate.
    """
    if other := [r.id for r in rules if r.kind not in ("fichero", "contenido", "contenido_prohibido")]:
        raise ValueError(f"not rules over paths or texts: {other}")
    marks, aggs = [], []  # a pattern is tested once a file, and the marks are counted
    for i, r in enumerate(rules):
        scope = in_scope(r)
        hit = scope & (any_match(F.col("path"), r.patterns, ON_PATHS) if r.kind == "fichero" else any_match(F.col("text"), r.patterns))
        marks += [hit.alias(f"h{i}"), scope.alias(f"e{i}")]
        aggs += [F.count_if(f"h{i}").alias(f"n{i}"), F.min(F.when(F.col(f"h{i}"), F.col("path"))).alias(f"p{i}"), F.count_if(f"e{i}").alias(f"s{i}")]
    wide = files.select("path", *marks).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(r.id).alias("regla_id"), F.lit(r.kind).alias("tipo"), F.lit(r.severity).alias("severidad"), F.col(f"n{i}").alias("casan"), F.col(f"p{i}").alias("primero"), F.col(f"s{i}").alias("en_ambito")) for i, r in enumerate(rules)])
    out = wide.select(F.inline(rows))
    wanted = F.col("tipo") != "contenido_prohibido"
    state = F.when((F.col("tipo") != "fichero") & (F.col("en_ambito") == 0), "no_aplicable").when(wanted == (F.col("casan") > 0), "senal").otherwise("hallazgo")
    return out.withColumn("estado", state).withColumn("localizacion", F.when(F.col("casan") > 0, F.col("primero")).otherwise(WHOLE_REPOSITORY)).drop("primero")


def forbidden_findings(files: DataFrame, rule: RuleSpec) -> DataFrame:
    """One finding for each file that holds what the rule forbids."""
    return files.where(in_scope(rule) & any_match(F.col("text"), rule.patterns)).select(F.lit(rule.id).alias("regla_id"), F.lit(rule.severity).alias("severidad"), F.col("path").alias("localizacion"))


def suffixes(dotted: Column) -> Column:
    """All dotted suffixes of a path: a.b.c -> [a.b.c, b.c, c]."""
    parts = F.split(dotted, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def call_matches(calls: DataFrame, signatures: DataFrame, imports: DataFrame | None = None, required: DataFrame | None = None) -> DataFrame:
    """(path, signature, n): calls whose last parts equal a signature's, as an equi-join on exploded suffixes.

    required: (module) of which a file has to import one, looked up in imports (path, module).
    """
    exploded = calls.select("path", "dotted", F.explode(suffixes(F.col("dotted"))).alias("signature"))
    hits = exploded.join(signatures, "signature")
    if required is not None:
        hits = hits.join(imports.join(required, "module", "left_semi").select("path"), "path", "left_semi")
    return hits.groupBy("path", "signature").agg(F.count("*").alias("n"))


def call_scan(calls: DataFrame, signatures: DataFrame) -> DataFrame:
    """(path, line, col, dotted, signature) of every matching call."""
    exploded = calls.select("path", "line", "col", "dotted", F.explode(suffixes(F.col("dotted"))).alias("signature"))
    return exploded.join(signatures, "signature").select("path", "line", "col", "dotted", "signature")


def without_pair(triggers: DataFrame, pairs: DataFrame) -> DataFrame:
    """Files with a trigger and no pair in the same file."""
    return triggers.select("path").distinct().join(pairs.select("path").distinct(), "path", "left_anti")


def zero_filled(counted: DataFrame, column: str, values: Sequence[str], *by: str) -> DataFrame:
    """Counts for every value of a closed vocabulary, also those that don't occur."""
    aggs = [F.count_if(F.col(column) == v).alias(v) for v in values]
    wide = counted.groupBy(*by).agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(v).alias(column), F.col(v).alias("n")) for v in values])
    return wide.select(*by, F.inline(pairs))


def counted_levels(rows: DataFrame, column: str, values: Sequence[str], *levels: Sequence[str]) -> DataFrame:
    """(the levels' columns, nivel, column, n): counts of every value of a closed vocabulary at several levels, from one pass.

    A level is a list of columns, () the whole; nivel names its columns. Values that don't occur count 0, so levels can be compared; a null in a
    level's column is a group of its own, told from a column that the level doesn't have by nivel. An empty table gives no rows.
    """
    columns = list(dict.fromkeys(c for level in levels for c in level))
    named = F.create_map(*[x for level in levels for x in (F.lit(sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in level)).cast("long"), F.lit("+".join(level) or "total"))])
    wide = rows.groupingSets([[F.col(c) for c in level] for level in levels], *[F.col(c) for c in columns]).agg(F.grouping_id().cast("long").alias("_id"), *[F.count_if(F.col(column) == v).alias(f"_{i}") for i, v in enumerate(values)])
    pairs = F.array(*[F.struct(F.lit(v).alias(column), F.col(f"_{i}").alias("n")) for i, v in enumerate(values)])
    return wide.select(*columns, named[F.col("_id")].alias("nivel"), F.inline(pairs))


#: Hexadecimal digits of a path's hash by which a tree's files are dealt, level by level.
DEPTHS = (4, 2, 0)


def tree_digest(files: DataFrame, *by: str) -> DataFrame:
    """(by, sujeto_digest, ficheros, ilegibles): a digest of a tree of any size; it moves with names, with contents, and with what can't be read.

    files: by, path, text, error. Files are dealt into ranges of their path's hash; a range's digest is that of its files in order, a wider
    range's that of its ranges. No row holds more than a range: 1/65536 of a tree's files, then 256 digests.
    """
    body = F.when(F.col("error").isNotNull(), F.concat(F.lit("(ilegible) "), "error")).when(F.col("text").isNull(), "(no leido)").otherwise(F.sha2("text", 256))
    now = files.select(*by, F.sha2("path", 256).alias("at"), F.concat("path", F.lit(":"), body).alias("d"), F.lit(1).cast("long").alias("ficheros"), F.col("error").isNotNull().cast("long").alias("ilegibles"))
    for depth in DEPTHS:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "d"))), lambda x: x["d"]), "\n")
        now = now.groupBy(*by, F.substring("at", 1, depth).alias("to")).agg(F.sha2(joined, 256).alias("d"), F.sum("ficheros").alias("ficheros"), F.sum("ilegibles").alias("ilegibles"))
        now = now.select(*by, F.col("to").alias("at"), F.concat("to", F.lit(":"), "d").alias("d"), "ficheros", "ilegibles")
    return now.select(*by, F.substr("d", F.lit(2)).alias("sujeto_digest"), "ficheros", "ilegibles")


def subject_digest(files: DataFrame, *by: str) -> DataFrame:
    """A digest over the ordered (path, digest of text) of each subject: moves with content, not with order."""
    one = files.select(*by, "path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("d"))
    return one.groupBy(*by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "d"))), lambda x: F.concat(x["path"], F.lit(":"), x["d"])), "\n"), 256).alias("sujeto_digest"), F.count("*").alias("ficheros"))


def strongest(signals: DataFrame, by: str) -> DataFrame:
    """(by, mas_fuerte and a count of each strength): call, then presence, then supplied."""
    order = list(dict.fromkeys(STRENGTH.values()))
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("fuerza"))
    return signals.groupBy(by).agg(F.min_by("fuerza", rank).alias("mas_fuerte"), *[F.count_if(F.col("fuerza") == s).alias(s) for s in order])
