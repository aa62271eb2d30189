"""A token bucket for each key, as Structured Streaming state or over a table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

PER_MINUTE, BURST = 120.0, 40.0  # fixed values
OUTPUT = "key string, n long, ts timestamp, allowed boolean"
STATE = "tokens double, last_us long"


def take(tokens: float, last_us: int, now_us: int, per_minute: float, burst: float) -> tuple[bool, float, int]:
    """(allowed, tokens left, time of the refill). A clock that goes back refills nothing."""
    if now_us > last_us:
        tokens, last_us = min(burst, tokens + (now_us - last_us) * per_minute / 60e6), now_us
    return (True, tokens - 1, last_us) if tokens >= 1 else (False, tokens, last_us)


def _run(key: str, pdf: pd.DataFrame, tokens: float, last, per_minute: float, burst: float):
    rows = []
    for r in pdf.sort_values(["ts", "n"]).itertuples():
        us = r.ts.value // 1000
        allowed, tokens, last = take(tokens, us if last is None else last, us, per_minute, burst)
        rows.append((key, r.n, r.ts, allowed))
    return pd.DataFrame(rows, columns=["key", "n", "ts", "allowed"]), tokens, last


def throttle(requests: DataFrame, per_minute: float = PER_MINUTE, burst: float = BURST) -> DataFrame:
    """A stream of requests (key, n, ts) with allowed."""

    def step(key, pdfs, state):
        tokens, last = state.get if state.exists else (burst, None)
        for pdf in pdfs:
            out, tokens, last = _run(key[0], pdf, tokens, last, per_minute, burst)
            yield out
        if last is not None:
            state.update((tokens, last))

    return requests.groupBy("key").applyInPandasWithState(step, OUTPUT, STATE, "append", "NoTimeout")


def throttle_batch(requests: DataFrame, per_minute: float = PER_MINUTE, burst: float = BURST) -> DataFrame:
    """The same over a table: one key's requests are one group, as each depends on the one before."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _run(pdf["key"].iloc[0], pdf, burst, None, per_minute, burst)[0]

    return requests.select("key", "n", "ts").groupBy("key").applyInPandas(run, OUTPUT)
