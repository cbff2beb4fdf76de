"""Sharding by size-tiered compaction: small immutable shards, merged into target-sized files under a versioned manifest.

Method: an arrival is appended as it comes, as small shards that never change. Shards are sorted into tiers by size, each tier FANOUT
times the one below. Where a tier holds at least FANOUT shards, runs of its shards of similar size are merged, each run into one
file of at most the target size; files of the target size are left alone. Every append and every compaction
commits a new version of the manifest, the list of shards that make up the table, by writing what it adds and removes under a temporary name and renaming it to its
version's name, which fails if another writer took that version. An append then tries the next one; a merge does so if its shards are all still there, and plans anew if not.

Readers see one version, whole, and can go on reading it while others commit: the last KEEP versions and all that were superseded less than RETENTION seconds ago stay with their files.
A vacuum writes the oldest version that stays out in full, deletes those before it and the files that only they name, and, after ORPHANS seconds, files that no version names, which
failed or beaten writers leave.

A merge reads a run's shards in one task and writes one file: nothing is shuffled, and runs are merged side by side, MERGES in a job and JOBS jobs at once. Row
counts are compared before a commit. All data passes through DataFrame operations only. The driver holds file names and sizes, a line for each shard: the target
size should grow with the table (1 GiB for 100 TB are 100,000 lines).

Defined results: rows are kept whatever they hold, nulls, copies and clashing column names included; an arrival without rows adds a
version and no shard; a table without versions reads as empty.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET_BYTES = 64 << 20
FANOUT = 4
LEAST_BYTES = 1 << 20
#: Merges in one job, and jobs at once.
MERGES, JOBS = 64, 4
#: Versions that stay at least, and seconds that a version stays after the next one. Files that no version names stay longer than any write takes.
KEEP, RETENTION, ORPHANS = 2, 3600, 7 * 86_400
#: Versions that a writer tries to take in turn.
TRIES = 50


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class ShardedTable:
    """A table of immutable shards at a shared path."""

    def __init__(self, spark: SparkSession, path: str, schema, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, least_bytes: int = LEAST_BYTES):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.target, self.fanout, self.least = target_bytes, fanout, least_bytes
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    # -- manifest -------------------------------------------------------------------------------------------------------------

    def _listed(self, name: str) -> list:
        at = self._at(name)
        return list(self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._listed("manifest")]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _json(self, name: str) -> dict:
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _draft(self, content: dict):
        """A file under a temporary name, written and closed."""
        draft = self._at(f"manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        return draft

    def manifest(self, version: int | None = None) -> dict:
        """{version, shards: [{path, bytes, rows}]} of a version, the latest by default: the last one written in full and what was added and removed since."""
        if version is None:
            version = max(self.versions(), default=0)
        changes, at, shards = [], version, {}
        while at:
            if self._fs.exists(self._at(f"manifest/{at:08d}.full")):
                shards = {s["path"]: s for s in self._json(f"manifest/{at:08d}.full")["shards"]}
                break
            changes.append(self._json(f"manifest/{at:08d}.json"))
            at -= 1
        for c in reversed(changes):
            for path in c["removed"]:
                shards.pop(path, None)
            shards.update((s["path"], s) for s in c["added"])
        return {"version": version, "shards": list(shards.values())}

    def commit(self, base: int, shards: list[dict]) -> int:
        """Make these shards version base + 1: all or nothing, once only."""
        version, before = base + 1, {s["path"] for s in self.manifest(base)["shards"]}
        now = {s["path"] for s in shards}
        draft = self._draft({"version": version, "added": [s for s in shards if s["path"] not in before], "removed": sorted(before - now)})
        gateway = self.spark.sparkContext._gateway
        no_options = gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf).rename(draft, self._at(f"manifest/{version:08d}.json"), no_options)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e) or "exists" in str(e):
                raise Conflict(f"version {version} is taken") from e
            raise
        return version

    # -- data -----------------------------------------------------------------------------------------------------------------

    def _write(self, df: DataFrame, kind: str) -> list[dict]:
        """Write df's partitions as new files; their names, sizes and row counts."""
        name = f"data/{kind}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        files = {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._at(name)) if s.getPath().getName().startswith("part-")}
        counts = self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}").groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count("*").alias("n"))
        rows = {r["f"]: r["n"] for r in counts.collect()} if files else {}  # a row for each new shard
        return [{"path": f"{name}/{f}", "bytes": files[f], "rows": rows[f]} for f in sorted(files) if rows.get(f)]

    def append(self, df: DataFrame) -> int:
        """Add an arrival as shards of its own, after whatever other writers commit meanwhile."""
        new = self._write(df.select(*self.schema.names), "arrival")
        for _ in range(TRIES):
            now = self.manifest()
            try:
                return self.commit(now["version"], now["shards"] + new)
            except Conflict:
                continue
        raise Conflict("other writers took every version")

    def read(self, version: int | None = None) -> DataFrame:
        shards = self.manifest(version)["shards"]
        if not shards:
            return self.spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema))
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{s['path']}" for s in shards))

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.least, self.fanout)) + 1) if size >= self.least else 0

    def plan(self, shards: list[dict], final: bool = False) -> list[list[dict]]:
        """Runs to merge: neighbours by size within a tier that holds enough shards, each run up to the target size.

        final merges smaller tiers as well, for a table that nothing more will arrive at.
        """
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if 2 * s["bytes"] <= self.target:
                tiers.setdefault(0 if final else self.tier(s["bytes"]), []).append(s)
        runs = []
        for _, group in sorted(tiers.items()):
            if len(group) < (2 if final else self.fanout):
                continue
            run, size = [], 0
            for s in sorted(group, key=lambda s: (s["bytes"], s["path"])):
                if run and size + s["bytes"] > self.target:
                    runs.append(run)
                    run, size = [], 0
                run.append(s)
                size += s["bytes"]
            runs.append(run)
        return [r for r in runs if len(r) > 1]

    def _merge(self, runs: list[list[dict]]) -> list[dict]:
        """One new file for each run."""
        some = [self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{s['path']}" for s in run)).coalesce(1) for run in runs]
        return self._write(reduce(DataFrame.unionAll, some), "merge")

    def compact(self, final: bool = False) -> int:
        """Merge until no tier is due; every round commits a version. Returns the latest version."""
        for _ in range(TRIES):
            now = self.manifest()
            runs = self.plan(now["shards"], final)
            if not runs:
                return now["version"]
            jobs = [runs[at : at + MERGES] for at in range(0, len(runs), MERGES)]
            with ThreadPoolExecutor(JOBS) as pool:
                made = [s for some in pool.map(inheritable_thread_target(self.spark)(self._merge), jobs) for s in some]
            merged = {s["path"] for run in runs for s in run}
            if sum(s["rows"] for run in runs for s in run) != sum(s["rows"] for s in made):
                raise RuntimeError("a merge has lost rows")
            self._replace(merged, made)
            self.vacuum()
        raise Conflict("other writers took every version")

    def _replace(self, merged: set[str], made: list[dict]) -> None:
        """Commit the shards made in place of the merged ones, unless another writer has merged some of them: then they are left to the vacuum."""
        for _ in range(TRIES):
            now = self.manifest()
            if not merged <= {s["path"] for s in now["shards"]}:
                return
            try:
                self.commit(now["version"], [s for s in now["shards"] if s["path"] not in merged] + made)
                return
            except Conflict:
                continue

    def vacuum(self, keep: int = KEEP, seconds: float = RETENTION, orphans: float = ORPHANS) -> None:
        """Delete versions before the last ones that were superseded so many seconds ago, the files that only they name, and much older files that no version names."""
        now = time.time() * 1000
        written = {s.getPath().getName(): s.getModificationTime() for s in self._listed("manifest")}
        versions = self.versions()
        follows = dict(zip(versions, versions[1:], strict=False))
        kept = [v for i, v in enumerate(versions) if i >= len(versions) - keep or written[f"{follows[v]:08d}.json"] > now - 1000 * seconds]
        if not kept:
            return
        first = self.manifest(kept[0])
        named = {s["path"] for s in first["shards"]} | {s["path"] for v in kept[1:] for s in self._json(f"manifest/{v:08d}.json")["added"]}
        past = [n for n in written if n[:8].isdigit() and int(n[:8]) < kept[0]]
        if past:
            if not self._fs.exists(full := self._at(f"manifest/{kept[0]:08d}.full")):
                self._fs.rename(self._draft(first), full)
            if not self._fs.exists(full):
                raise RuntimeError("a version could not be written out in full")
            told = [self._json(f"manifest/{n}") for n in past]
            for path in sorted({s["path"] for c in told for s in c.get("shards", c.get("added"))} - named):
                self._fs.delete(self._at(path), False)
            for name in past:
                self._fs.delete(self._at(f"manifest/{name}"), False)
        for name, at in written.items():
            if name.startswith(".") and at <= now - 1000 * orphans:
                self._fs.delete(self._at(f"manifest/{name}"), False)
        for folder in self._listed("data"):
            inside = f"data/{folder.getPath().getName()}"
            for f in self._listed(inside):
                if f.isFile() and f"{inside}/{f.getPath().getName()}" not in named and f.getModificationTime() <= now - 1000 * orphans:
                    self._fs.delete(f.getPath(), False)


def arrivals(df: DataFrame, id_col: str, count: int) -> list[DataFrame]:
    """df in that many parts of about equal size by ranges of ids, as if they came one after the other; rows without an id come first."""
    cuts = df.agg(F.percentile_approx(id_col, [i / count for i in range(1, count)] or [1.0])).first()[0] or []
    cuts = sorted(set(cuts[: count - 1]))
    out, low = [], None
    for high in [*cuts, None]:
        inside = F.lit(True) if low is None else F.col(id_col) > low
        inside = inside if high is None else inside & (F.col(id_col) <= high)
        out.append(df.filter(inside | F.col(id_col).isNull() if low is None else inside))
        low = high
    return out
