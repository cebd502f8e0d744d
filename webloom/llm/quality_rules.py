"""Quality rules: a learned decision list.

Sequential covering learns, from labelled documents, an ordered list of conjunctions of thresholds on text statistics.
Each rule grows on two thirds of the labelled rows, taking the threshold with the best information gain until it covers
no good document, and is pruned on the last third; a rule that is not precise enough there ends the list.  The list
becomes one ordered conditional expression over columns of statistics.  All labelled rows teach: their features stay in
Spark, and each step is one pass that counts them by slots of values, between which thresholds lie.

Defined results: a null text has no words; a text without words has zero for every statistic; rows with null or
without labels teach nothing, and without any rule the method keeps everything; of thresholds with equal gains the first
in the order of features, then the lowest, is taken; repeated rows are judged each; a text of any length is counted whole;
empty tables give empty results; columns of other names pass through untouched, since the statistics sit in one struct
whose name the caller picks (a name that is taken is refused).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import by_slice, byte_values, flat, mix, prefix, sized, small_batches, spans_hash, stage, windows_hash, word_spans

SLICE = 2 << 20
#: Values of a feature whose leading bits, so many of the mantissa, are equal share a slot; cuts lie between slots.
MANTISSA = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_upper", "n_digits", "n_lines", "n_stops", "n_distinct")
STATS_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
_SYMBOL, _UPPER, _DIGIT, _STOP = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[list(range(65, 91))] = True
_DIGIT[list(range(48, 58))] = True
_STOP[list(b".!?")] = True


def _by_doc(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(sums[at])


def _pair(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(h ^ mix(doc.astype(np.uint64) + np.uint64(1)))


def _repeats(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element whether its (doc, h) comes again or before, and whether it came before."""
    key = _pair(doc, h)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    again[order[1:]] |= same
    later[order[1:]] = same
    again[order[:-1]] |= same
    return again, later


def statistics(data: np.ndarray, at: np.ndarray, window: int = 8) -> dict[str, np.ndarray]:
    """The counts of each document, over whole texts."""
    starts, ends, words = word_spans(data, at)
    n_docs = len(at) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(words))
    lead = (data & 0xC0) != 0x80
    sums = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
    bytes_hash = prefix(byte_values(data))
    h = spans_hash(bytes_hash, starts, ends)
    out = {"n_words": np.diff(words), "n_chars": np.diff(sums[at]), "n_symbols": _by_doc(_SYMBOL[data], at), "n_upper": _by_doc(_UPPER[data], at), "n_digits": _by_doc(_DIGIT[data], at), "n_stops": _by_doc(_STOP[data], at)}
    out["word_chars"] = np.bincount(doc, sums[ends] - sums[starts], n_docs).astype(np.int64)
    # lines: from a document's start or after a line end, up to a line end or the document's end
    ended = np.flatnonzero(data == 10)
    full = np.diff(at) > 0
    begin = np.sort(np.concatenate([at[:-1][full], ended[~np.isin(ended + 1, at)] + 1]))
    line_doc = np.searchsorted(at, begin, "right") - 1
    stop = np.minimum(np.append(ended, len(data))[np.searchsorted(ended, begin)], at[line_doc + 1])
    with_word = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop, line_doc = begin[with_word], stop[with_word], line_doc[with_word]
    _, later = _repeats(line_doc, spans_hash(bytes_hash, begin, stop))
    out["n_lines"] = np.bincount(line_doc, minlength=n_docs)
    out["n_dup_lines"] = np.bincount(line_doc, later, n_docs).astype(np.int64)
    _, known = _repeats(doc, h)
    out["n_distinct"] = np.bincount(doc, ~known, n_docs).astype(np.int64)
    covered = np.zeros(len(h) + 1, np.int64)
    if len(h) >= window:
        whole = np.flatnonzero(doc[: len(h) - window + 1] == doc[window - 1 :])
        again, _ = _repeats(doc[whole], windows_hash(h, window)[whole])
        np.add.at(covered, whole[again], 1)
        np.add.at(covered, whole[again] + window, -1)
    out["n_repeat_words"] = np.bincount(doc, np.cumsum(covered)[:-1] > 0, n_docs).astype(np.int64)
    return out


def with_statistics(docs: DataFrame, text_col: str = "text", name: str = "stats") -> DataFrame:
    """`docs` with its columns and a struct column of counts."""
    if name in docs.columns:
        raise ValueError(f"the table has a column {name}; pick another name for the statistics")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = statistics(*flat(batch.column(text_col)))
        stats = pa.StructArray.from_arrays([pa.array(found[c].astype(np.int64)) for c in COUNTS], list(COUNTS))
        return pa.RecordBatch.from_arrays([*batch.columns, stats], [*batch.schema.names, name])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return by_slice(batches, text_col, SLICE, one)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(count, T.StructType([*docs.schema.fields, T.StructField(name, STATS_TYPE)]))


#: The features of rules: name and SQL over the struct s; zero where there is nothing to divide by.
FEATURES = {
    "words": "s.n_words",
    "word_length": "s.word_chars / greatest(s.n_words, 1)",
    "symbols_per_word": "s.n_symbols / greatest(s.n_words, 1)",
    "upper_share": "s.n_upper / greatest(s.n_chars, 1)",
    "digit_share": "s.n_digits / greatest(s.n_chars, 1)",
    "dup_line_share": "s.n_dup_lines / greatest(s.n_lines, 1)",
    "repeat_share": "s.n_repeat_words / greatest(s.n_words, 1)",
    "stops_per_word": "s.n_stops / greatest(s.n_words, 1)",
    "distinct_share": "s.n_distinct / greatest(s.n_words, 1)",
    "words_per_line": "s.n_words / greatest(s.n_lines, 1)",
}


def feature(name: str, stats: str) -> Column:
    return F.expr(FEATURES[name].replace("s.", f"`{stats}`.")).cast("double")


@dataclass(frozen=True)
class Test:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.at_least else x[self.feature] <= self.threshold

    def column(self, stats: str) -> Column:
        value = feature(self.feature, stats)
        return value >= F.lit(self.threshold) if self.at_least else value <= F.lit(self.threshold)


@dataclass(frozen=True)
class Learned:
    """Tests that all hold for a document to be rejected, with the precision on the rows that pruned it."""

    tests: tuple[Test, ...]
    precision: float

    def __str__(self) -> str:
        return " and ".join(f"{t.feature} {'>=' if t.at_least else '<='} {t.threshold:.4g}" for t in self.tests) + f" -> reject ({self.precision:.3f})"


def _covers(tests, x: dict[str, np.ndarray]) -> np.ndarray:
    held = np.ones(len(next(iter(x.values()))), bool)
    for t in tests:
        held &= t.holds(x)
    return held


@dataclass(frozen=True)
class Tally:
    """Of the rows that grow a rule, for each feature the bad and all rows and the least and largest value of each slot of
    values, in order; of the rows that prune it, the bad and all ones for which the first 0, 1, ... tests hold."""

    slots: dict[str, np.ndarray]
    judged: np.ndarray

    @property
    def bad(self) -> int:
        return int(next(iter(self.slots.values()))[:, 0].sum())

    @property
    def good(self) -> int:
        return int(next(iter(self.slots.values()))[:, 1].sum()) - self.bad


def tally(rows: DataFrame, rules: list[Learned], tests: list[Test]) -> Tally:
    """One pass over all rows (columns of FEATURES, bad, prune) that no rule covers yet; tasks return sums by slot."""
    names = list(FEATURES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = {f: batch.column(f).to_numpy() + 0.0 for f in names}
            bad, prune = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bad", "prune"))
            left = np.ones(len(bad), bool)
            for rule in rules:
                left &= ~_covers(rule.tests, x)
            parts = []
            for n in range(len(tests) + 1):
                held = left & prune & _covers(tests[:n], x)
                parts.append(([-1], [n], [(bad & held).sum()], [held.sum()], [0.0], [0.0]))
            own = left & ~prune & _covers(tests, x)
            for k, f in enumerate(names):
                order = np.argsort(x[f][own], kind="stable")
                v, mark = x[f][own][order], bad[own][order]
                slot = (v.view(np.uint64) >> np.uint64(52 - MANTISSA)).astype(np.int64)  # of no negative values, so in order
                first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(v) else np.zeros(0, np.int64)
                n = np.diff(np.append(first, len(v)))
                p = np.diff(np.append(0, np.cumsum(mark))[np.append(first, len(v))])
                parts.append((np.full(len(first), k), slot[first], p, n, v[first], v[first + n - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.asarray(c, t) for c in column])) for column, t in zip(zip(*parts, strict=True), [np.int64] * 4 + [float] * 2, strict=True)], ["feature", "slot", "p", "n", "lo", "hi"])

    sums = rows.mapInArrow(count, "feature long, slot long, p long, n long, lo double, hi double").groupBy("feature", "slot")
    seen = sums.agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toPandas().sort_values(["feature", "slot"])
    part = lambda k: seen[seen["feature"] == k][["p", "n", "lo", "hi"]].to_numpy(float)
    return Tally({f: part(k) for k, f in enumerate(names)}, part(-1)[:, :2].astype(np.int64))


def _cut(seen: Tally, cuts: int) -> Test | None:
    """The test with the best information gain, if any has one."""
    p0, n0 = seen.bad, seen.good
    base, best = math.log2(p0 / (p0 + n0)), (0.0, None)
    for name, slots in seen.slots.items():
        up, below = np.cumsum(slots[:, 0]), np.cumsum(slots[:, 1])
        edge = np.arange(len(slots) - 1)  # a cut between two slots
        if len(edge) > cuts:
            edge = edge[np.linspace(0, len(edge) - 1, cuts).astype(int)]
        for at_least in (False, True):
            p = up[edge] if not at_least else p0 - up[edge]
            total = below[edge] if not at_least else below[-1] - below[edge]
            with np.errstate(divide="ignore"):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / total) - base), 0)
            if len(gain) and gain.max() > best[0] + 1e-9:
                k = edge[int(gain.argmax())]
                best = (float(gain.max()), Test(name, at_least, float((slots[k, 3] + slots[k + 1, 2]) / 2)))
    return best[1]


def learn(rows: DataFrame, precision: float = 0.9, least: int = 3, cuts: int = 400, most_tests: int = 5, most_rules: int = 24) -> list[Learned]:
    """Ordered rules that reject.  `prune` marks the rows kept for pruning."""
    rules: list[Learned] = []
    while len(rules) < most_rules:
        tests, seen = [], tally(rows, rules, [])
        if seen.bad < least:
            break
        while len(tests) < most_tests and seen.good:
            test = _cut(seen, cuts)
            if test is None:
                break
            tests.append(test)
            seen = tally(rows, rules, tests)
        if not tests:
            break

        def worth(n: int, judged: np.ndarray = seen.judged) -> tuple[float, int, float]:
            p, total = judged[n].tolist()
            return (2 * p - total) / total if total else -1.0, p, p / total if total else 0.0

        n = max(range(1, len(tests) + 1), key=lambda n: (worth(n)[0], n and worth(n)[1], -n))
        _, p, exact = worth(n)
        if p < 1 or exact < precision:
            break
        rules.append(Learned(tuple(tests[:n]), exact))
    return rules


def rejected(rules: list[Learned], stats: str = "stats") -> Column:
    """The ordered conditional expression: true where some rule fires."""
    if not rules:
        return F.lit(False)
    column = None
    for rule in rules:
        test = None
        for t in rule.tests:
            test = t.column(stats) if test is None else test & t.column(stats)
        column = F.when(test, True) if column is None else column.when(test, True)
    return column.otherwise(False)


def base_failed(stats: str = "stats") -> Column:
    s = F.col(stats)
    return (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> list[Learned]:
    """Learns from all labelled rows, whose features stay in Spark: the driver gets sums by slots of values."""
    taught = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    rows = with_statistics(own).select("id", *[feature(f, "stats").alias(f) for f in FEATURES]).join(sized(taught, taught.count(), 16), "id")

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prune = mix(batch.column("id").cast(pa.int64()).to_numpy().astype(np.uint64)) % np.uint64(3) == 0
            bad = batch.column("label").to_numpy() == 0
            yield pa.RecordBatch.from_arrays([*(batch.column(f) for f in FEATURES), pa.array(bad), pa.array(prune)], [*FEATURES, "bad", "prune"])

    kind = T.StructType([*(T.StructField(f, T.DoubleType()) for f in FEATURES), T.StructField("bad", T.BooleanType()), T.StructField("prune", T.BooleanType())])
    return learn(stage(rows.mapInArrow(dealt, kind), "labelled"), **options)
