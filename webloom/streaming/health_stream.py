"""Streaming forms (an extension): health over a stream of outcomes, and the circuit breaker as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webloom.operators.health import Breaker

_STATE = "domain string, seq long, blocked boolean, state string"


def windowed_stats(outcomes: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, domain, requests, failures) over event time `at` (timestamp), late rows up to `late` counted."""
    return outcomes.withWatermark("at", late).groupBy(F.window("at", window), "domain").agg(F.count("*").alias("requests"), F.count_if(~F.col("success")).alias("failures"))


def breaker_stream(attempts: DataFrame, limit: int = 5, timeout: float = 60.0) -> DataFrame:
    """The breaker over a stream of attempts (seq, ts in seconds, domain, success), in order of seq within each batch;
    a domain's circuit is its state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        circuit = Breaker(limit, timeout, *state.get) if state.exists else Breaker(limit, timeout)
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        out = []
        for seq, ts, success in rows[["seq", "ts", "success"]].itertuples(index=False):
            blocked = circuit.blocks(ts)
            if not blocked:
                circuit.record(bool(success), ts)
            out.append((key[0], seq, blocked, circuit.state))
        state.update((circuit.state, circuit.failures, circuit.opened))
        yield pd.DataFrame(out, columns=["domain", "seq", "blocked", "state"])

    keyed = attempts.select("domain", "seq", "ts", "success").groupBy("domain")
    return keyed.applyInPandasWithState(step, _STATE, "state string, failures int, opened double", "append", GroupStateTimeout.NoTimeout)
