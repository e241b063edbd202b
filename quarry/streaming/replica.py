"""A table that follows a changelog under control: source, start, stop, reset and status."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.sources.storage import VersionedTable
from quarry.streaming.changes import Filters, lag_seconds, start_applying


class ReplicaError(RuntimeError):
    pass


class Replica:
    """Applies a folder of changelog files to a table, exactly once.

    ``place``: a shared folder for the source's options and the stream's progress. The executed set is kept with
    the table, so a replica that is reset, or given a copy of the same log, applies no transaction again.
    """

    def __init__(self, spark: SparkSession, place: str, table: VersionedTable, schema: StructType, keys: list[str]):
        self.spark, self.place, self.table, self.schema, self.keys = spark, place.rstrip("/"), table, schema, list(keys)
        self.query = None

    def options(self) -> dict:
        path = f"{self.place}/source.json"
        return json.loads(self.table.files.read(path)) if self.table.files.exists(path) else {}

    def running(self) -> bool:
        return self.query is not None and self.query.isActive

    def _idle(self, what: str) -> None:
        if self.running():
            raise ReplicaError(f"{what}: the replica is running")

    def change_source(self, folder: str, auto_position: bool = True, filters: Filters | None = None) -> None:
        """Where to read from. The position always follows from the executed set, which can't be turned off. Progress
        through another folder is forgotten."""
        self._idle("change source")
        if not auto_position:
            raise ReplicaError("the position follows from the executed set")
        old = self.options()
        if old and old["folder"] != folder:
            self.reset()
        self.table.files.delete(f"{self.place}/source.json")
        self.table.files.create(f"{self.place}/source.json", json.dumps({"folder": folder, "filters": vars(filters) if filters else None}))

    def start(self, every: str | None = None) -> None:
        """Begin to apply: what is there now, or what comes too, looking ``every`` so often ("10 seconds"). A replica that
        runs goes on."""
        if self.running():
            return
        own = self.options()
        if not own:
            raise ReplicaError("no source")
        filters = Filters(**{k: tuple(v) for k, v in own["filters"].items()}) if own["filters"] else None
        self.query = start_applying(self.spark, own["folder"], self.schema, self.table, self.keys, f"{self.place}/progress", filters, every=every)

    def wait(self, seconds: float | None = None) -> bool:
        """Until a replica without ``every`` has read all; what stopped it is raised."""
        return self.query.awaitTermination(seconds) if seconds else self.query.awaitTermination() is None

    def stop(self) -> None:
        if self.running():
            self.query.stop()

    def reset(self, everything: bool = False) -> None:
        """Forget how far the log was read; ``everything``: the source too. Refused while it runs."""
        self._idle("reset")
        self.table.files.delete(f"{self.place}/progress")
        if everything:
            self.table.files.delete(f"{self.place}/source.json")
        v = self.table.version()
        m = self.table.meta(v)
        if m.get("batch", -1) >= 0:  # batches are numbered from 0 again
            self.table.publish(m["folder"], v, edits=m.get("edits", []), batch=-1)

    def status(self, last_event: str | None = None) -> DataFrame:
        """One row: state, source, version, batch, executed (transactions), error, and seconds_behind the time
        ``last_event`` of the last change applied; 0 when idle."""
        m = self.table.meta()
        folders = [f"{self.table.path}/{f}" for f in m.get("executed", [])]
        executed = self.spark.read.parquet(*folders).select("gtid").distinct().count() if folders else 0
        error = self.query.exception() if self.query is not None else None
        state = "running" if self.running() else "error" if error else "stopped"
        row = (state, self.options().get("folder"), self.table.version(), m.get("batch", -1), executed, str(error) if error else None, last_event, state != "running")
        out = self.spark.createDataFrame([row], "state string, source string, version long, batch long, executed long, error string, at string, idle boolean")
        return lag_seconds(out.withColumn("last_event", F.col("at").cast("timestamp")), F.current_timestamp()).drop("at", "last_event", "idle")
