"""What `monitor_evidence` writes and hands to workers: texts once, and few rows at a time."""

import os

import pytest

from webloom.operators import monitor
from webloom.plans import queries
from webloom.session import kept

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_evidence_writes_texts_once(spark, monkeypatch):
    batch, written = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    spark.conf.unset(batch)

    def noted(df, name):
        written.append(df.columns)
        return kept(df, name)

    for module in (queries, monitor):
        monkeypatch.setattr(module, "kept", noted, raising=False)
    assert queries.monitor_evidence(spark, DATA).count() > 0
    assert sum("text" in columns for columns in written) == 1
    assert int(spark.conf.get(batch)) <= 1_000


def test_states_read_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = spark.createDataFrame([("a", k, "u", "n", str(k // 2), None) for k in range(10)], "id string, run long, url string, normalization string, sha256 string, error string")
    states = monitor.states(rows.mapInPandas(look, rows.schema)).orderBy("run").collect()
    assert [r.state for r in states] == ["baseline"] + ["unchanged", "changed"] * 4 + ["unchanged"]
    assert seen.value == 10
