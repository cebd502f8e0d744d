import json
import os

from webloom.operators import health
from webloom.streaming.health_stream import breaker_stream, windowed_stats

SCHEMA = "seq long, ts double, domain string, success boolean, at timestamp"


def streamed(spark, df, name, tmp_path, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_streams_agree_with_batch(spark, tmp_path):
    rows = [{"seq": k, "ts": float(k), "domain": "ab"[k % 2], "success": k % 7 == 0, "at": f"2024-01-01T00:{k:02d}:00Z"} for k in range(40)]
    source = tmp_path / "in"
    source.mkdir()
    for part in range(4):
        file = source / f"{part}.json"
        file.write_text("\n".join(json.dumps(r) for r in rows[part * 10 : part * 10 + 10]))
        os.utime(file, (1_700_000_000 + part, 1_700_000_000 + part))  # files are read in this order
    read = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    batch = spark.read.schema(SCHEMA).json(str(source))
    want = sorted(map(tuple, health.breaker_states(batch, 2, 6.0).collect()))
    assert sorted(map(tuple, streamed(spark, breaker_stream(read(), 2, 6.0), "breaker", tmp_path).collect())) == want
    assert {r[3] for r in want} >= {"open", "closed"}
    stats = streamed(spark, windowed_stats(read()), "stats", tmp_path, "complete").collect()
    assert sum(r.requests for r in stats) == 40 and sum(r.failures for r in stats) == sum(not r["success"] for r in rows)
