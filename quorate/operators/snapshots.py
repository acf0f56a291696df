"""The evaluations log as versions: a snapshot of the state, the deltas since, and a manifest that names both.

Files are written first and are nobody's until a manifest names them. Manifests are numbered; who creates the next number
has published it, and whoever else saw the same last one has not, and tries again on top of it. So appending and compaction
exclude nobody, each commit is seen whole or not at all, and a reader keeps the version it began with.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.operators.state import CLEARS, STATUSES, TOUCHES, parts
from quorate.sources.shared import create_once, file_system, read_text

COLUMNS = ("note", "justification", "version", "extraction")


class VersionedLog:
    def __init__(self, spark: SparkSession, path: str, key: list[str], seq: str) -> None:
        """seq: the column that orders events, unique within a key."""
        self.spark, self.path, self.key, self.seq = spark, path, key, seq

    def versions(self) -> list[int]:
        fs, path = file_system(self.spark, f"{self.path}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """What a version consists of, the last one if none is named: snapshot (a folder or None), deltas, since when."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "snapshot": None, "deltas": []}
        return json.loads(read_text(self.spark, f"{self.path}/manifests/{version:012}"))

    def _publish(self, seen: dict, snapshot: str | None, deltas: list[str]) -> bool:
        next_ = {"version": seen["version"] + 1, "snapshot": snapshot, "deltas": deltas, "at": time.time()}
        return create_once(self.spark, f"{self.path}/manifests/{next_['version']:012}", json.dumps(next_))

    def append(self, events: DataFrame) -> int:
        """Commits events (key..., seq, status, and any of COLUMNS) as one delta; gives the version that has them."""
        name = f"data/delta-{uuid.uuid4().hex}"
        events.write.parquet(f"{self.path}/{name}")
        while True:
            seen = self.manifest()
            if self._publish(seen, seen["snapshot"], [*seen["deltas"], name]):
                return seen["version"] + 1

    def _folded(self, manifest: dict) -> DataFrame | None:
        """key, and for each column the last (seq, value) that any event has given it: such structs are merged by max, so
        that a snapshot and the deltas after it fold to what all events would."""
        read = lambda names: self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/{n}" for n in names])
        old = read([manifest["snapshot"]]) if manifest["snapshot"] else None
        if not manifest["deltas"]:
            return old
        log = read(manifest["deltas"])
        columns = [c for c in COLUMNS if c in log.columns]
        status = F.max(F.when(F.col("status").isin(*STATUSES), F.struct(F.col(self.seq).alias("s"), F.col("status").alias("v")))).alias("status")
        new = log.groupBy(*self.key).agg(status, *parts(F.col(self.seq), "status", columns, TOUCHES, CLEARS))
        if old is None:
            return new
        both = old.unionByName(new, allowMissingColumns=True)
        return both.groupBy(*self.key).agg(*[F.max(c).alias(c) for c in both.columns if c not in self.key])

    def state(self, version: int | None = None) -> DataFrame:
        """(key, status and those of COLUMNS that events have) as of a version."""
        folded = self._folded(self.manifest(version))
        if folded is None:
            raise ValueError("nothing has been committed")
        return folded.select(*self.key, *[F.col(c)["v"].alias(c) for c in folded.columns if c not in self.key])

    def compact(self) -> int:
        """Writes the present state as a snapshot, which takes the place of the deltas it is made of; those that others have
        committed meanwhile stay. Gives the version, or that which there is where another compaction was quicker."""
        base = self.manifest()
        if not base["deltas"]:
            return base["version"]
        name = f"data/snapshot-{uuid.uuid4().hex}"
        self._folded(base).write.parquet(f"{self.path}/{name}")
        while True:
            seen = self.manifest()
            if seen["snapshot"] != base["snapshot"]:
                return seen["version"]
            if self._publish(seen, name, [d for d in seen["deltas"] if d not in base["deltas"]]):
                return seen["version"] + 1

    def vacuum(self, keep: int = 2, older_s: float = 86_400) -> list[str]:
        """Deletes what none of the last `keep` versions names and what is older than older_s (younger files may be of a
        commit that is not published yet); gives the names."""
        versions = self.versions()
        kept = [self.manifest(v) for v in versions[-keep:]]
        used = {n for m in kept for n in [*m["deltas"], m["snapshot"]] if n}
        fs, data = file_system(self.spark, f"{self.path}/data")
        gone = []
        for s in fs.listStatus(data) if fs.exists(data) else []:
            name = f"data/{s.getPath().getName()}"
            if name not in used and s.getModificationTime() / 1000 < time.time() - older_s:
                fs.delete(s.getPath(), True)
                gone.append(name)
        for v in versions[:-keep]:
            fs.delete(file_system(self.spark, f"{self.path}/manifests/{v:012}")[1], False)
        return sorted(gone)
