"""Health of request outcomes: statistics, sliding failure rate, failure runs, circuit breaker and retries.

Outcomes are rows (seq, ts, domain, success, status, elapsed_ms, bytes_read), ordered by seq.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.session import numbered

#: Statuses worth another try (fixed values).
RETRYABLE = (429, 500, 502, 503, 504)
#: Consecutive failures of a domain from which each count raises an alert.
RUN_ALERT = 3
#: Consecutive outcomes that one task of a sliding window takes.
CELL = 100_000


def domain_stats(outcomes: DataFrame) -> DataFrame:
    """(domain, requests, failures, total_elapsed_ms, total_bytes): sums over successes only."""
    ok = F.col("success")
    return outcomes.groupBy("domain").agg(F.count("*").alias("requests"), F.count_if(~ok).alias("failures"), F.coalesce(F.sum(F.when(ok, F.col("elapsed_ms"))), F.lit(0)).cast("long").alias("total_elapsed_ms"), F.coalesce(F.sum(F.when(ok, F.col("bytes_read"))), F.lit(0)).cast("long").alias("total_bytes"))


def status_counts(outcomes: DataFrame) -> DataFrame:
    """(domain, status, n); null statuses do not count."""
    return outcomes.where(F.col("status").isNotNull()).groupBy("domain", "status").agg(F.count("*").alias("n"))


def status_map(outcomes: DataFrame) -> DataFrame:
    """(domain, counts map<int, long>)."""
    return status_counts(outcomes).groupBy("domain").agg(F.map_from_entries(F.collect_list(F.struct("status", "n"))).alias("counts"))


def failure_window(outcomes: DataFrame, size: int = 20, cell: int = CELL) -> DataFrame:
    """(seq, n, failures): of each outcome and the size - 1 before it, over all domains.

    The window is global, but looks back only size - 1 rows.  Rows are dealt by ranges of seq, whatever its gaps, and
    numbered within and across ranges; each range also gets the last size - 1 rows before it.  So no task holds all
    outcomes.  Rows of one seq count in an order of their own.
    """
    cell = max(cell, size)
    cells = numbered(outcomes.select("seq", "success"), "seq", "success", name="row").withColumn("cell", F.floor(F.col("row") / F.lit(cell)))
    ahead = cells.where(F.col("row") % cell >= cell - size + 1).withColumns({"cell": F.col("cell") + 1, "own": F.lit(False)})
    w = Window.partitionBy("cell").orderBy("row").rowsBetween(1 - size, 0)
    both = cells.withColumn("own", F.lit(True)).unionByName(ahead)
    return both.select("seq", "own", F.count("*").over(w).alias("n"), F.sum((~F.col("success")).cast("long")).over(w).alias("failures")).where("own").drop("own")


def failure_runs(outcomes: DataFrame) -> DataFrame:
    """(domain, seq, run): failures in a row up to each failed outcome."""
    w = Window.partitionBy("domain").orderBy("seq")
    island = outcomes.withColumn("island", F.sum(F.col("success").cast("int")).over(w))
    own = Window.partitionBy("domain", "island").orderBy("seq")
    return island.withColumn("run", F.sum((~F.col("success")).cast("long")).over(own)).where("NOT success").select("domain", "seq", "run")


def alerts(outcomes: DataFrame, threshold: float = 0.5, size: int = 20) -> DataFrame:
    """(seq, message): each message at its first outcome."""
    rate = F.col("failures") / F.col("n")
    high = failure_window(outcomes, size).where((F.col("n") >= size) & (rate >= threshold))
    # two decimals, the exact half to even, as a percentage is printed
    percent = F.bround(100 * F.col("failures").cast("decimal(20,10)") / F.col("n"), 0).cast("int")
    high = high.select("seq", F.concat(F.lit("High failure rate "), percent.cast("string"), F.lit(f"% in the last {size} requests")).alias("message"))
    runs = failure_runs(outcomes).where(F.col("run") >= RUN_ALERT).select("seq", F.concat(F.lit("Domain "), "domain", F.lit(" has "), F.col("run").cast("string"), F.lit(" consecutive failures")).alias("message"))
    return high.unionByName(runs).groupBy("message").agg(F.min("seq").alias("seq")).select("seq", "message")


def snapshot(outcomes: DataFrame, threshold: float = 0.5, size: int = 20) -> DataFrame:
    """One row: totals, failure_rate (4 places; 0 without requests), domains_crawled, n_alerts, status."""
    totals = outcomes.agg(F.count("*").alias("total_requests"), F.count_if(~F.col("success")).alias("total_failures"), F.count_distinct("domain").alias("domains_crawled"))
    raised = alerts(outcomes, threshold, size).agg(F.count("*").alias("n_alerts"))
    both = totals.join(F.broadcast(raised))  # one row each
    rate = F.coalesce(F.try_divide("total_failures", "total_requests"), F.lit(0.0))
    healthy = (rate < threshold) & (F.col("n_alerts") == 0)
    return both.select("total_requests", "total_failures", F.bround(rate, 4).alias("failure_rate"), "domains_crawled", "n_alerts", F.when(healthy, "healthy").otherwise("degraded").alias("status"))


def details(outcomes: DataFrame, threshold: float = 0.5, size: int = 20, most: int = 1000) -> dict:
    """The snapshot as a dictionary, with its first `most` alerts in order and each of the first `most` domains' counts."""
    one = snapshot(outcomes, threshold, size).first().asDict()
    raised = alerts(outcomes, threshold, size).orderBy("seq", "message").limit(most).collect()
    last = failure_runs(outcomes).groupBy("domain").agg(F.max(F.struct("seq", "run")).alias("r"))
    ended = outcomes.groupBy("domain").agg(F.max("seq").alias("last"))
    runs = last.join(ended, "domain").select("domain", F.when(F.col("r.seq") == F.col("last"), F.col("r.run")).otherwise(0).alias("run"))
    domains = domain_stats(outcomes).join(runs, "domain", "left").orderBy("domain").limit(most).collect()
    return {
        **{k: one[k] for k in ("total_requests", "total_failures", "failure_rate", "domains_crawled")},
        "healthy": one["status"] == "healthy",
        "alerts": [r.message for r in raised],
        "domain_stats": {r.domain: {"requests": r.requests, "failures": r.failures, "consecutive_failures": r.run or 0} for r in domains},
    }


# --- circuit breaker ---


@dataclass
class Breaker:
    """One domain's circuit: after `limit` failures in a row it opens; `timeout` seconds later the next check half-opens
    it; a success closes it, and a failure while half-open opens it again.  Failures while open do not move its clock."""

    limit: int = 5
    timeout: float = 60.0
    state: str = "closed"
    failures: int = 0
    opened: float = 0.0

    def blocks(self, now: float) -> bool:
        if self.state == "open" and now - self.opened >= self.timeout:
            self.state = "half_open"
        return self.state == "open"

    def record(self, success: bool, now: float) -> None:
        if success:
            self.failures, self.state = 0, "closed"
            return
        self.failures += 1
        if self.failures >= self.limit:
            if self.state != "open":
                self.opened = now
            self.state = "open"


def breaker_states(attempts: DataFrame, limit: int = 5, timeout: float = 60.0) -> DataFrame:
    """(domain, seq, blocked, state): each attempt (seq, ts in seconds, domain, success) is checked first; a blocked one
    has no outcome.  A domain's attempts are sequential by nature; they stream through in order, in bounded memory."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        domain, circuit = None, Breaker(limit, timeout)
        for rows in batches:
            out = []
            for d, seq, ts, success in rows[["domain", "seq", "ts", "success"]].itertuples(index=False):
                if d != domain:
                    domain, circuit = d, Breaker(limit, timeout)
                blocked = circuit.blocks(ts)
                if not blocked:
                    circuit.record(bool(success), ts)
                out.append((d, seq, blocked, circuit.state))
            yield pd.DataFrame(out, columns=["domain", "seq", "blocked", "state"])

    dealt = attempts.select("domain", "seq", "ts", "success").repartition("domain").sortWithinPartitions("domain", "seq")
    return dealt.mapInPandas(fold, "domain string, seq long, blocked boolean, state string")


# --- retries ---


def should_retry(attempt: Column, status: Column, failed: Column, max_retries: int = 3) -> Column:
    """Another try: within the limit, and a retryable status or an error without one."""
    return (attempt <= max_retries) & F.when(status.isNotNull(), status.isin(*RETRYABLE)).otherwise(F.coalesce(failed, F.lit(False)))


def backoff(attempt: Column, status: Column, base: float = 1.0, most: float = 60.0, limited: float = 5.0, jitter: bool = True) -> Column:
    """Seconds before a try: doubled each time, from a longer base where the rate is limited."""
    first = F.when(F.coalesce(status == 429, F.lit(False)), F.lit(limited)).otherwise(F.lit(base))
    delay = F.least(first * F.pow(F.lit(2.0), attempt - 1), F.lit(most))
    return delay * (0.5 + F.rand() * 0.5) if jitter else delay


@dataclass(frozen=True)
class Linear:
    """A traversal's own retries: any error, a wait that grows by one step an attempt."""

    retries: int = 1
    step: float = 0.5

    def again(self, attempt: int, status: int | None) -> bool:
        return attempt <= self.retries

    def wait(self, attempt: int, status: int | None) -> float:
        return self.step * attempt


@dataclass(frozen=True)
class Adaptive:
    """`should_retry` and `backoff` for one request at a time."""

    retries: int = 3
    base: float = 1.0
    most: float = 60.0
    limited: float = 5.0
    jitter: bool = True

    def again(self, attempt: int, status: int | None) -> bool:
        return attempt <= self.retries and (status is None or status in RETRYABLE)

    def wait(self, attempt: int, status: int | None) -> float:
        delay = min(self.most, (self.limited if status == 429 else self.base) * 2 ** (attempt - 1))
        return delay * random.uniform(0.5, 1.0) if self.jitter else delay


def linear_backoff(attempt: Column, step: float = 0.5) -> Column:
    return attempt * F.lit(step)
