"""The monitor's store: version folders of Parquet, and a pointer that one atomic rename flips.

A run's snapshots, contents and report appear together or not at all.  A lock file made exclusively turns a second
writer away at once.  The store is small (a row per source) and local to the driver, like the reports.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from webloom.schemas import CONTENT, SNAPSHOT

SCHEMA = 1


def write_atomic(path: str | Path, text: str) -> None:
    """The whole text or, after a failure, what was there before."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


class Store:
    def __init__(self, spark: SparkSession, path: str | Path) -> None:
        self.spark, self.path = spark, Path(path)
        self.path.mkdir(parents=True, exist_ok=True)
        mark = self.path / "_schema_version"
        if not mark.exists():
            write_atomic(mark, str(SCHEMA))
        if mark.read_text().strip() != str(SCHEMA):
            raise ValueError("the monitor store has another schema version")

    def _current(self) -> dict:
        pointer = self.path / "_CURRENT"
        return json.loads(pointer.read_text()) if pointer.exists() else {"version": None, "contents": [], "runs": []}

    def snapshots(self) -> DataFrame:
        version = self._current()["version"]
        return self.spark.read.schema(SNAPSHOT).parquet(f"{self.path}/{version}/snapshots") if version else self.spark.createDataFrame([], SNAPSHOT)

    def contents(self) -> DataFrame:
        parts = [f"{self.path}/{v}/contents" for v in self._current()["contents"]]
        return self.spark.read.schema(CONTENT).parquet(*parts) if parts else self.spark.createDataFrame([], CONTENT)

    @contextmanager
    def locked(self) -> Iterator[None]:
        lock = self.path / "_LOCK"
        try:
            os.close(os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError as error:
            raise RuntimeError("another run holds the monitor store") from error
        try:
            yield
        finally:
            lock.unlink(missing_ok=True)

    def commit(self, snapshots: DataFrame, contents: DataFrame, report: dict) -> None:
        """Everything is written first; the rename of the pointer is the commit."""
        now, version = self._current(), f"v-{uuid.uuid4().hex}"
        if any(r == report["run_id"] for r in now["runs"]):
            raise ValueError("the run is stored already")
        snapshots.write.parquet(f"{self.path}/{version}/snapshots")
        contents.join(self.contents().select("sha256"), "sha256", "left_anti").write.parquet(f"{self.path}/{version}/contents")
        write_atomic(self.path / "runs" / f"{report['run_id']}.json", json.dumps(report, indent=2, sort_keys=True))
        write_atomic(self.path / "_CURRENT", json.dumps({"version": version, "contents": [*now["contents"], version], "runs": [*now["runs"], report["run_id"]]}))

    def run(self, run_id: str | None = None) -> dict:
        """A stored report: by id, or the latest by order of commit."""
        runs = self._current()["runs"]
        if not runs or run_id not in (None, "latest") and run_id not in runs:
            raise ValueError("there is no such run")
        return json.loads((self.path / "runs" / f"{runs[-1] if run_id in (None, 'latest') else run_id}.json").read_text())
