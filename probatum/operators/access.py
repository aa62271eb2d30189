"""Who may do what: a verb needs a role, roles include others, and a verb that isn't declared passes for nobody."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The role that each verb needs, and the roles that a role includes.
NEEDS = {
    "almacen verificar": "lectura",
    "noconformidad listar": "lectura",
    "revision": "lectura",
    "soa": "lectura",
    "anexo": "lectura",
    "preguntar": "lectura",
    "aplicabilidad": "lectura",
    "plan": "observacion",
    "comprobar": "observacion",
    "vigilar": "observacion",
    "empujon": "remediacion",
    "remediar": "remediacion",
}
INCLUDES = {"admin": ("lectura", "observacion", "remediacion"), "observacion": ("lectura",), "remediacion": ("lectura",)}
TENANT = "^[a-z0-9][a-z0-9-]{1,38}[a-z0-9]$"


def needed(verb: Column) -> Column:
    """The role a verb needs: by verb and action, else by the verb alone; null if neither is declared."""
    table = F.create_map(*[F.lit(x) for kv in NEEDS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, verb), F.try_element_at(table, F.split_part(verb, F.lit(" "), F.lit(1))))


def held(roles: Column) -> Column:
    """The roles with those that they include."""
    more = F.create_map(*[x for k, v in INCLUDES.items() for x in (F.lit(k), F.array(*[F.lit(r) for r in v]))])
    return F.array_distinct(F.concat(roles, F.flatten(F.transform(roles, lambda r: F.coalesce(F.try_element_at(more, r), F.array().cast("array<string>"))))))


def may(roles: Column, verb: Column) -> Column:
    return F.coalesce(F.array_contains(held(F.coalesce(roles, F.array().cast("array<string>"))), needed(verb)), F.lit(False))


def is_tenant(name: Column) -> Column:
    return F.coalesce(name.rlike(TENANT) & (F.length(name) == F.length(F.regexp_replace(name, "[\r\n]", ""))), F.lit(False))


def is_identifier(name: Column) -> Column:
    """What may become a file's name, part of an address and a ticket's key: refused otherwise, never cleaned."""
    return F.coalesce(name.rlike(r"\A[A-Za-z0-9][A-Za-z0-9._-]{0,63}\z"), F.lit(False))


def is_commit(sha: Column) -> Column:
    return F.coalesce(sha.rlike(r"\A[0-9a-f]{40}\z"), F.lit(False))
