"""Push decisions with state: per location and branch, the commit last looked at and the inert chain since."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame

from probatum.sources.pushes import CHAIN_CAP

OUTPUT = "location string, ref string, n long, sha string, decision string, chain int"
STATE = "observed string, chain string"


def step(observed: str | None, chain: list[str], sha: str | None, before: str | None, inert: bool) -> tuple[str, str | None, list[str]]:
    """(decision, commit looked at, chain) after one push. A redelivery decides what the first delivery did."""
    if not sha or observed is None:
        return "reobservar", sha or observed, []
    if sha == observed or sha in chain:
        return "revalidar", observed, chain
    head = chain[-1] if chain else observed
    if len(chain) < CHAIN_CAP and inert and before == head:
        return "ignorar", observed, [*chain, sha]
    return "reobservar", sha, []


def _decide(key, pdfs, state):
    observed, chain = (state.get[0], json.loads(state.get[1])) if state.exists else (None, [])
    for pdf in pdfs:
        rows = []
        for r in pdf.sort_values("n").itertuples():
            decision, observed, chain = step(observed, chain, r.sha, r.before, bool(r.inert))
            rows.append((*key, r.n, r.sha, decision, len(chain)))
        yield pd.DataFrame(rows, columns=["location", "ref", "n", "sha", "decision", "chain"])
    state.update((observed, json.dumps(chain)))


def decisions(pushes: DataFrame) -> DataFrame:
    """A stream of (location, ref, n, sha, before, inert) to decisions."""
    return pushes.groupBy("location", "ref").applyInPandasWithState(_decide, OUTPUT, STATE, "append", "NoTimeout")


def decisions_batch(pushes: DataFrame) -> DataFrame:
    """The same fold over a table; one location's branch is one group, as each push depends on the one before."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        observed, chain, rows = None, [], []
        for r in pdf.sort_values("n").itertuples():
            decision, observed, chain = step(observed, chain, r.sha, r.before, bool(r.inert))
            rows.append((r.location, r.ref, r.n, r.sha, decision, len(chain)))
        return pd.DataFrame(rows, columns=["location", "ref", "n", "sha", "decision", "chain"])

    return pushes.groupBy("location", "ref").applyInPandas(run, OUTPUT)
