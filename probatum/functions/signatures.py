"""HMAC-SHA256 in expressions, and what a signed event's headers prove.

A key's pads are made once for each key, as binary columns; an event then costs two hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64
_HEX = "0123456789ABCDEF"
#: Headers that are looked at, in order; of one, the secret itself is sent and not a signature (fixed values).
HEADERS = ("X-Hub-Signature-256", "X-Gitlab-Token", "X-Firma")
TOKEN, PREFIX = "X-Gitlab-Token", "sha256="


def _xored(key: Column, byte: int) -> Column:
    """A key of BLOCK bytes, each exclusively or'ed with one byte: the two hexadecimal digits are translated apart and put together again."""
    digits = F.hex(key)
    side = lambda at, x: F.translate(F.regexp_replace(digits, "(.)(.)", f"${at}"), _HEX, "".join(f"{i ^ x:X}" for i in range(16)))
    pairs = F.struct(side(1, byte >> 4).alias("a"), side(2, byte & 15).alias("b"))
    made = F.unhex(F.array_join(F.transform(F.array(pairs), lambda p: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(BLOCK)), lambda i: F.concat(F.substr(p["a"], i, F.lit(1)), F.substr(p["b"], i, F.lit(1)))), "")), ""))
    return F.when(key.isNotNull(), made)


def pads(key: Column) -> tuple[Column, Column]:
    """(inner, outer) pads of a binary key; a key longer than a block is hashed first."""
    short = F.when(F.octet_length(key) > BLOCK, F.unhex(F.sha2(key, 256))).otherwise(key)
    padded = F.rpad(short, BLOCK, F.unhex(F.lit("00")))
    return _xored(padded, 0x36), _xored(padded, 0x5C)


def signed(inner: Column, outer: Column, body: Column) -> Column:
    """The lowercase hexadecimal signature of a binary body under a key's pads."""
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body), 256))), 256)


def hmac_sha256(key: Column, body: Column) -> Column:
    return signed(*pads(key), body)


def verified(events: DataFrame, secrets: DataFrame) -> DataFrame:
    """events (cliente, cuerpo binary, cabeceras map) with firma: valida, no_valida, sin_firma or sin_secreto, and which header said so.

    A client without a secret is a third state, neither valid nor refused. The first header that isn't blank decides; a client that
    has a secret and sends no signature is refused as sin_firma. secrets: cliente, secreto, one for each client.
    """
    inner, outer = pads(F.col("secreto").cast("binary"))
    keys = secrets.where("secreto <> ''").select(F.col("cliente").alias("_c"), F.col("secreto").alias("_s"), inner.alias("_i"), outer.alias("_o"))
    rows = events.join(keys, F.col("cliente") == F.col("_c"), "left")
    sent = F.filter(F.array(*[F.struct(F.lit(h).alias("h"), F.trim(F.try_element_at("cabeceras", F.lit(h))).alias("v")) for h in HEADERS]), lambda x: F.coalesce(x["v"], F.lit("")) != "")
    first = F.get(sent, F.lit(0))
    bare = F.when(F.startswith(first["v"], F.lit(PREFIX)), F.substr(first["v"], F.lit(len(PREFIX) + 1))).otherwise(first["v"])
    right = F.when(first["h"] == TOKEN, bare == F.col("_s")).otherwise(bare == signed(F.col("_i"), F.col("_o"), F.col("cuerpo")))
    verdict = F.when(F.col("_s").isNull(), "sin_secreto").when(F.size(sent) == 0, "sin_firma").when(right, "valida").otherwise("no_valida")
    return rows.withColumn("firma", verdict).withColumn("cabecera", F.when(verdict.isin("valida", "no_valida"), first["h"])).drop("_c", "_s", "_i", "_o")
