"""People's answers from two kinds of JSON documents: lists written by hand, and sealed declarations.

Every answer carries how far it can be trusted. A document that can't be believed gives no answers but one row that
says why: missing fields, two lists that disagree, a root that its records don't give, fields no signature covers.
Signatures are checked by a function the caller passes, as keys and their library live outside Spark.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .logs import canonical_json

# What an answer must have, and what a seal may have.
BY_HAND = ("pregunta", "valor", "quien", "cargo", "cuando")
SEALED = ("valor", "quien", "cargo")
SEAL = ("esquema", "emitido_en", "raiz", "registros", "firma", "clave_publica")

ANSWER = "path string, pregunta string, valor string, quien string, cargo string, cuando string, justificacion string, confianza string, problema string"
FIELDS = [c.split()[0] for c in ANSWER.split(", ")]


def root_of(records: list) -> str:
    """Merkle root over the canonical JSON of records; an odd last node goes up as it is."""
    level = [hashlib.sha256(b"\x00" + canonical_json(r).encode()).digest() for r in records] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\x01" + a + b).digest() for a, b in zip(level[::2], level[1::2])]  # noqa: B905
        level = pairs + level[len(pairs) * 2 :]
    return "sha256:" + level[0].hex()


def _when(text: object) -> str:
    return datetime.fromisoformat(str(text)).isoformat()


def _declared(doc: dict, expected_key: str | None, verify: Callable[[dict], bool] | None) -> tuple[list, str]:
    """(records, trust) of a declaration, or ValueError."""
    seal = doc.get("sello")
    if not seal:
        return doc.get("registros") or [], "sin_firma"
    records = seal.get("registros") or []
    if "registros" in doc and doc["registros"] != records:
        raise ValueError("two lists of records that disagree")
    if extra := sorted(set(seal) - set(SEAL)):
        raise ValueError(f"the seal holds fields that nothing covers: {', '.join(extra)}")
    if root_of(records) != seal.get("raiz"):
        raise ValueError("the records don't give the root")
    if not seal.get("firma"):
        return records, "sin_firma"
    if verify is None or not verify(seal):
        raise ValueError("the signature can't be verified")
    if expected_key is None:
        return records, "firmada"
    if expected_key != seal.get("clave_publica"):
        raise ValueError("signed with another key than the expected one")
    return records, "identidad_verificada"


def answers_of(path: str, body: str, expected_key: str | None = None, verify: Callable[[dict], bool] | None = None) -> list[tuple]:
    try:
        doc = json.loads(body)
        if not isinstance(doc, dict) or not {"respuestas", "sello", "registros"} & set(doc):
            raise ValueError("neither respuestas nor registros")
        out = []
        if "respuestas" in doc:
            for i, r in enumerate(doc["respuestas"]):
                if lost := [f for f in BY_HAND if f not in r]:
                    raise ValueError(f"answer {i} lacks {lost[0]}")
                out.append((r["pregunta"], r, r["cuando"], "sin_firma"))
        else:
            records, trust = _declared(doc, expected_key, verify)
            for i, r in enumerate(records):
                content = r.get("contenido") or {}
                if lost := [f for f in SEALED if f not in content]:
                    raise ValueError(f"record {i} lacks {lost[0]}")
                out.append((r["control_id"], content, r["observado_en"], trust))
        return [(path, q, canonical_json(c["valor"]), c["quien"], c["cargo"], _when(t), c.get("justificacion"), trust, None) for q, c, t, trust in out]
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        return [(path, *[None] * 7, str(e) or type(e).__name__)]


def answers(documents: DataFrame, expected_key: str | None = None, verify: Callable[[dict], bool] | None = None) -> DataFrame:
    """Answers of documents (path, body): one row each, valor as JSON; problema says why a document gives none."""

    def run(frames):
        for f in frames:
            rows = [r for p, b in zip(f["path"], f["body"], strict=True) for r in answers_of(p, b, expected_key, verify)]
            yield pd.DataFrame(rows, columns=FIELDS, dtype=object)

    return documents.select("path", F.coalesce("body", F.lit("")).alias("body")).mapInPandas(run, ANSWER)


def read_answers(spark: SparkSession, path: str, expected_key: str | None = None, verify: Callable[[dict], bool] | None = None) -> DataFrame:
    return answers(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body")), expected_key, verify)
