"""The sharding query stores the slot map that places its rows."""

from pathlib import Path
from urllib.parse import urlparse

from webloom.llm import sharding
from webloom.llm.common import shared_dir
from webloom.llm.queries import op7_sharding


def test_query_places_rows_by_a_stored_map(spark):
    folder = Path(urlparse(shared_dir(spark)).path)
    before = set(folder.glob("slot-map-*"))
    rows = op7_sharding(spark, "/root/testdata/sf0.001").select("virtual_slot", "shard").distinct().collect()
    stored = set(folder.glob("slot-map-*")) - before
    assert len(stored) == 1
    m = sharding.load_map(spark, f"file://{stored.pop()}")
    assert rows and all(m.shard_of[r.virtual_slot] == r.shard for r in rows)
    assert sharding.grow(m).n_shards == m.n_shards + 1
