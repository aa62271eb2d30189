"""Repositories as tables: a listing, files with decoded text, Python call sites and imports."""

from __future__ import annotations

import ast
import io
import os
import tokenize

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is read as text, and what is never entered.
SUFFIXES = (".py", ".yml", ".yaml", ".toml", ".cfg", ".json", ".md", ".txt", ".ini")
DEPLOY_NAMES = ("dockerfile", "containerfile", "makefile", "procfile", "justfile", "vagrantfile")
SKIPPED = (".git", "__pycache__", ".venv", "node_modules")


def _listing(root: str) -> tuple[list[str], list[str]]:
    """(regular files, links that lead out) below root; skipped folders and linked ones are never entered."""
    top, inside, outside = os.path.realpath(root), [], []
    for folder, dirs, names in os.walk(root, followlinks=False):
        links = [d for d in dirs if os.path.islink(os.path.join(folder, d))]
        dirs[:] = sorted(d for d in dirs if d not in SKIPPED and d not in links)
        for x in [*names, *(d for d in links if d not in SKIPPED)]:
            full = os.path.join(folder, x)
            real = os.path.realpath(full)
            if os.path.islink(full) and real != top and not real.startswith(top.rstrip("/") + "/"):
                outside.append(os.path.relpath(full, root))
            elif os.path.isfile(full):
                inside.append(os.path.relpath(full, root))
    return sorted(inside), sorted(outside)


def _read(root: str):
    def run(frames):
        for f in frames:
            bodies = []
            for p in f["path"]:
                try:
                    with open(os.path.join(root, p), "rb") as g:
                        bodies.append(g.read())
                except OSError:
                    bodies.append(None)
            yield pd.DataFrame({"path": f["path"], "content": bodies})

    return run


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, readable, text, error) of each file below root; a missing root is an error, not an empty table.

    Names are listed on the driver, contents are read by tasks, and only those that are text. Links that lead out of root, and
    files that can't be read or aren't UTF-8, come back as rows with an error; nothing behind such a link is read. Linked folders
    within root are read where they stand, not once more behind the link.
    """
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    inside, outside = _listing(root)
    names = spark.createDataFrame([(p, True) for p in inside] + [(p, False) for p in outside], "path string, inside boolean")
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    wanted = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).isin(*SUFFIXES) | name.isin(*DEPLOY_NAMES)
    listed = names.withColumn("readable", F.col("inside") & wanted)
    parts = max(1, min(len(inside) // 200, 1000))
    read = listed.where("readable").repartition(parts).mapInPandas(_read(os.path.abspath(root)), "path string, content binary")
    ok = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.regexp_replace(F.col("content").cast("string"), "\r\n?", "\n")
    why = F.when(F.col("content").isNull(), "no se pudo leer").when(~ok, "no es UTF-8")
    found = read.select("path", F.lit(True).alias("readable"), F.when(ok, text).alias("text"), why.alias("error"))
    rest = listed.where("not readable").select("path", F.lit(False).alias("readable"), F.lit(None).cast("string").alias("text"), F.when(~F.col("inside"), "enlace fuera de la raiz").alias("error"))
    return found.unionByName(rest)


#: Code suffixes: those that are read as text, but for prose (fixed values).
PROSE = (".md", ".txt", ".rst")


def projections(scanned: DataFrame) -> DataFrame:
    """Adds code: text of code files, Python's without comments and docstrings; null for prose and deploy files, which have no suffix of code."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    is_code = suffix.isin(*SUFFIXES) & ~suffix.isin(*PROSE)
    return scanned.withColumn("code", F.when(is_code & (suffix == ".py"), strip_prose(F.col("text"))).when(is_code, F.col("text")))


def _dotted(node) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def _facts(source: str | None) -> tuple[list, list, str | None]:
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError) as e:
        return [], [], str(e)[:200]
    calls, imports = [], set()
    for n in ast.walk(tree):
        if isinstance(n, ast.Call) and (d := _dotted(n.func)):
            calls.append((n.lineno, n.col_offset, d))
        elif isinstance(n, ast.Import):
            imports.update(x for a in n.names for x in (a.name, a.name.split(".")[0]))
        elif isinstance(n, ast.ImportFrom) and n.module and not n.level:
            imports.update((n.module, n.module.split(".")[0]))
    return sorted(calls), sorted(imports), None


FACTS = "struct<calls: array<struct<line: int, col: int, dotted: string>>, imports: array<string>, error: string>"


def _python_facts(source: pd.Series) -> pd.DataFrame:
    got = [_facts(s) for s in source]
    return pd.DataFrame({"calls": [[{"line": a, "col": b, "dotted": c} for a, b, c in g[0]] for g in got], "imports": [g[1] for g in got], "error": [g[2] for g in got]})


def _code_only(source: str | None) -> str | None:
    if source is None:
        return None
    try:
        docs = {(n.body[0].lineno, n.body[0].col_offset) for n in ast.walk(ast.parse(source)) if isinstance(n, (ast.Module, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and n.body and isinstance(n.body[0], ast.Expr) and isinstance(n.body[0].value, ast.Constant) and isinstance(n.body[0].value.value, str)}
        kept = [t.string for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type != tokenize.COMMENT and not (t.type == tokenize.STRING and t.start in docs)]
    except (SyntaxError, tokenize.TokenError, ValueError):
        return source
    return " ".join(kept)


def _strip(source: pd.Series) -> pd.Series:
    return source.map(_code_only)


def strip_prose(source: Column) -> Column:
    """Python code without comments and docstrings; unchanged where it doesn't parse."""
    return F.pandas_udf(_strip, "string")(source)


def python_facts(source: Column) -> Column:
    """Dotted calls with line and column, imported modules, and why a source doesn't parse."""
    return F.pandas_udf(_python_facts, FACTS)(source)


def _with_facts(files: DataFrame) -> DataFrame:
    keys = [c for c in ("repo", "path") if c in files.columns]
    return files.where(F.col("path").endswith(".py") & F.col("text").isNotNull()).select(*keys, python_facts(F.col("text")).alias("f"))


def call_sites(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls: path, line, col, dotted), (imports: path, module) of Python files, under their repo, if any."""
    facts = _with_facts(files)
    keys = facts.columns[:-1]
    return facts.select(*keys, F.inline("f.calls")), facts.select(*keys, F.explode("f.imports").alias("module"))


def unparsed(files: DataFrame) -> DataFrame:
    """(path, error) of Python files that don't parse: they count as unreadable."""
    facts = _with_facts(files)
    return facts.where("f.error is not null").select(*facts.columns[:-1], F.col("f.error").alias("error"))


CALL = "line int, col int, dotted string"


@F.udtf(returnType=CALL)
class CallsOf:
    """The calls of a Python source as rows: SELECT path, c.* FROM files, LATERAL calls_of(text) c. None where it doesn't parse.

    A lateral join takes no UDTF of Arrow batches, so this one yields rows.
    """

    def eval(self, source: str):
        yield from _facts(source)[0]


def register(spark: SparkSession) -> None:
    """Make calls_of known to SQL."""
    spark.udtf.register("calls_of", CallsOf)
