"""Secrets, cell escaping, natural order of article numbers, Merkle leaves and canonical JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms of secrets (fixed values).
SECRETS = (
    r"gh[pousr]_[A-Za-z0-9]{16,}",
    r"github_pat_[A-Za-z0-9_]{20,}",
    r"glpat-[A-Za-z0-9_\-]{16,}",
    r"xox[baprs]-[A-Za-z0-9-]{10,}",
    r"sk-[A-Za-z0-9]{20,}",
    r"AKIA[0-9A-Z]{16}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"://[^/\s:]+:[^/\s@]+@",
)
REDACTED = "[secreto retirado]"
#: How each form begins: a text without any of these needs no further look.
BEGINNINGS = r"gh[pousr]_|github_pat_|glpat-|xox[baprs]-|sk-[A-Za-z0-9]|AKIA|-----BEGIN |://[^/\s:]+:"


def find_secrets(text: Column) -> Column:
    """First 12 characters of each secret, by pattern, then place."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1)) for p in SECRETS])
    shown = F.transform(found, lambda x: F.concat(F.substring(x, 1, 12), F.lit("...")))
    return F.when(text.rlike(BEGINNINGS), shown).when(text.isNotNull(), F.array().cast("array<string>"))


def redact_secrets(text: Column) -> Column:
    """The same patterns, replaced."""
    return F.when(text.rlike(BEGINNINGS), reduce(lambda t, p: F.regexp_replace(t, p, REDACTED), SECRETS, text)).otherwise(text)


def markdown_cell(text: Column, most: int = 1200) -> Column:
    cut = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(" ..."))).otherwise(text)
    return F.replace(F.replace(cut, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def article_key(article: Column) -> Column:
    """4 < 4A < 60 < 60A: number, then letters."""
    return F.struct(F.regexp_extract(article, r"^(\d+)", 1).cast("int").alias("numero"), F.regexp_extract(article, r"^\d+(.*)$", 1).alias("letra"))


def clause_key(clause: Column) -> Column:
    """4.2 < 4.10 < 10.1: the dotted numbers as integers."""
    return F.transform(F.split(clause, r"\."), lambda x: x.cast("int"))


def length_key(text: Column) -> Column:
    """Short before long, then by text."""
    return F.struct(F.length(text).alias("n"), text.alias("x"))


def ordered(values: Column, key) -> Column:
    """Values of an array in the order of a key; equal keys keep their order."""
    placed = F.transform(values, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(placed), lambda s: s["x"])


def canonical(*columns: str) -> Column:
    """JSON with sorted keys, nulls kept, and its content id."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def content_id(*columns: str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical(*columns), 256))


def merkle_leaf(data: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("00")), data.cast("binary")), 256)


def merkle_node(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(left), F.unhex(right)), 256)


def csp_sources(html: Column, tag: str) -> Column:
    """'sha256-...' of each inline block of a tag, in order, each once."""
    blocks = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    return F.array_distinct(F.transform(blocks, lambda b: F.concat(F.lit("'sha256-"), F.base64(F.unhex(F.sha2(b, 256))), F.lit("'"))))


def inline_hashes(html: Column, tag: str) -> Column:
    """Hexadecimal digests of the contents of a bare tag's blocks, in order, also of repeated ones."""
    return F.transform(F.regexp_extract_all(html, F.lit(f"<{tag}>([^<]*)</{tag}>"), F.lit(1)), lambda x: F.sha2(x, 256))


def united(a: Column, b: Column) -> Column:
    """The values of two arrays, each once, in order."""
    return F.array_sort(F.array_union(a, b))


def lacking(a: Column, b: Column) -> Column:
    """The values of an array that another doesn't have, each once, in order."""
    return F.array_sort(F.array_except(a, b))


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A text with {name} replaced by values; a null value becomes nothing."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1].cast("string"), F.lit(""))), values.items(), template)
