"""Versioned state in a shared folder: tables by scope, generations, immutable cluster snapshots.

Every write goes to a new folder, and a manifest under the next number is written once after it; the
manifest of the highest number counts, so readers see a whole version or the one before, and a crash at
any point leaves the version before. Of two writers that start from one version the second is refused
(``Conflict``) and may try again. What a newer version no longer names stays for the retention time, for
readers that hold it. Parquet has no merge: what changes is rewritten by scope (project, algorithm), which
are partitions.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinmesh.errors import Conflict, Invalid, NotFound
from twinmesh.functions import hashing
from twinmesh.operators import reads
from twinmesh.operators.components import components
from twinmesh.schema import CLUSTERS, EDGES
from twinmesh.session import Scratch

RETENTION_S = 3600.0
#: Older manifests kept beside the newest.
KEPT_MANIFESTS = 5


class Store:
    """Files below one folder, by Hadoop's file systems, so any shared storage will do."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], float] = time.time) -> None:
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, folder: str) -> list[int]:
        p = self._path(f"{self.root}/{folder}")
        names = [f.getPath().getName() for f in self._fs.listStatus(p)] if self._fs.exists(p) else []
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def newest(self, folder: str) -> tuple[int, dict | None]:
        """The number and content of the newest manifest of a folder; 0 and None if there is none."""
        for n in reversed(self._numbers(folder)):
            stream = self._fs.open(self._path(f"{self.root}/{folder}/manifest-{n}.json"))
            try:
                return n, json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
        return 0, None

    def publish(self, folder: str, after: int, value: dict) -> int:
        """Writes the manifest that follows number ``after``, once; a conflict if another has been written."""
        final, new = self._path(f"{self.root}/{folder}/manifest-{after + 1}.json"), self._path(f"{self.root}/{folder}/.{uuid.uuid4().hex}")
        self._fs.mkdirs(final.getParent())
        stream = self._fs.create(new)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        if self._fs.exists(final) or not self._fs.rename(new, final):
            self._fs.delete(new, False)
            raise Conflict(f"{folder} was changed by another writer")
        for n in self._numbers(folder)[: -KEPT_MANIFESTS - 1]:
            self._fs.delete(self._path(f"{self.root}/{folder}/manifest-{n}.json"), False)
        return after + 1

    def folders(self, name: str) -> list[str]:
        """Names of the folders below a folder."""
        p = self._path(f"{self.root}/{name}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(p) if f.isDirectory()) if self._fs.exists(p) else []

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def sweep(self, m: dict, before: float) -> None:
        """Deletes what was retired earlier than ``before``."""
        for r in m["retired"]:
            if r["at"] < before:
                self.delete(r["path"])
        m["retired"] = [r for r in m["retired"] if r["at"] >= before]


class EdgeState:
    """Edges by scope with a generation each, and cluster snapshots by (scope, threshold, generation).

    ``cap`` refuses cluster listings, and degrades statistics, of scopes with more qualifying edges; by default there is none."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], float] = time.time, retention_s: float = RETENTION_S, cap: int | None = None) -> None:
        self.spark, self.store, self.clock, self.retention_s, self.cap = spark, Store(spark, root, clock), clock, retention_s, cap

    def _scope(self, project_id: str, algorithm_id: int) -> str:
        return f"edges/{project_id}/{algorithm_id}"

    def _manifest(self, project_id: str, algorithm_id: int) -> tuple[int, dict]:
        n, m = self.store.newest(self._scope(project_id, algorithm_id))
        return n, m or {"generation": 0, "edges": None, "snapshots": [], "retired": []}

    def generation(self, project_id: str, algorithm_id: int) -> int:
        """0 for a scope that was never written."""
        return self._manifest(project_id, algorithm_id)[1]["generation"]

    def edges(self, project_id: str, algorithm_id: int) -> DataFrame:
        at = self._manifest(project_id, algorithm_id)[1]["edges"]
        return self.spark.read.schema(EDGES).parquet(f"{self.store.root}/{at}") if at else self.spark.createDataFrame([], EDGES)

    def replace(self, project_id: str, algorithm_id: int, edges: DataFrame) -> int:
        """Writes a scope's edges as a new version, advances its generation (even when nothing
        changed) and sweeps old snapshots. Other scopes' rows in ``edges`` are ignored."""
        n, m = self._manifest(project_id, algorithm_id)
        name = f"{self._scope(project_id, algorithm_id)}/edges-{uuid.uuid4().hex}"
        rows = reads.in_scope(edges, project_id, algorithm_id).select([F.col(f.name).cast(f.dataType) for f in EDGES.fields])
        rows.write.parquet(f"{self.store.root}/{name}")
        if m["edges"]:
            m["retired"].append({"path": m["edges"], "at": self.clock()})
        m["edges"], m["generation"] = name, m["generation"] + 1
        self._retire(m)
        self.store.publish(self._scope(project_id, algorithm_id), n, m)
        self.store.sweep(m, self.clock() - self.retention_s)
        return m["generation"]

    def _retire(self, m: dict) -> None:
        """Snapshots computed longer ago than the retention are given up, never one of the current
        generation."""
        old = [s for s in m["snapshots"] if s["generation"] != m["generation"] and s["computed_at"] < self.clock() - self.retention_s]
        m["snapshots"] = [s for s in m["snapshots"] if s not in old]
        m["retired"] += [{"path": s["path"], "at": self.clock()} for s in old]

    def vacuum(self, project_id: str, algorithm_id: int) -> None:
        n, m = self._manifest(project_id, algorithm_id)
        self._retire(m)
        self.store.sweep(m, self.clock() - self.retention_s)
        self.store.publish(self._scope(project_id, algorithm_id), n, m)

    def drop(self, project_id: str) -> None:
        """Deletes all scopes of a project."""
        self.store.delete(f"edges/{project_id}")

    def algorithms(self, project_id: str) -> list[int]:
        """Algorithms of a project that have edges."""
        return sorted(int(a) for a in self.store.folders(f"edges/{project_id}"))

    def clusters(self, project_id: str, algorithm_id: int, threshold: float, generation: int | None = None) -> tuple[DataFrame, int]:
        """Members with their mean and their cluster's greatest similarity, and the generation they are of.

        A pinned generation must still be there. Otherwise the snapshot of the current generation
        is read, or computed and kept; similarities are in it, so a pinned read never changes. A snapshot that
        another reader kept meanwhile is used instead of the one computed here."""
        n, m = self._manifest(project_id, algorithm_id)
        t = hashing.round_threshold(threshold)
        want = m["generation"] if generation is None else generation
        for s in m["snapshots"]:
            if s["generation"] == want and s["threshold"] == t:
                return self.spark.read.schema(CLUSTERS).parquet(f"{self.store.root}/{s['path']}"), want
        if generation is not None and generation != m["generation"]:
            raise NotFound(f"generation {generation} is no longer available")
        edges = reads.at_least(self.edges(project_id, algorithm_id), t)
        if self.cap is not None and edges.where("asset_id < other_asset_id").count() > self.cap:
            raise Invalid(f"more than {self.cap} edges at this threshold")
        members = components(edges, reads.SCOPE, Scratch(self.spark, "snapshot"))
        best = reads.cluster_summary(members, edges, t).select(*reads.SCOPE, "cluster_id", "max_similarity")
        rows = reads.cluster_members(members, edges, t).join(best, [*reads.SCOPE, "cluster_id"]).select([F.col(f.name).cast(f.dataType) for f in CLUSTERS.fields])
        name = f"{self._scope(project_id, algorithm_id)}/clusters-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.store.root}/{name}")
        m["snapshots"].append({"generation": want, "threshold": t, "path": name, "computed_at": self.clock()})
        try:
            self.store.publish(self._scope(project_id, algorithm_id), n, m)
        except Conflict:
            self.store.delete(name)
            return self.clusters(project_id, algorithm_id, threshold, generation)
        return self.spark.read.schema(CLUSTERS).parquet(f"{self.store.root}/{name}"), want

    def stats(self, project_id: str, algorithm_id: int, threshold: float) -> dict | None:
        """Clusters, edges and assets with a duplicate; None (degraded) beyond the cap, where one is set."""
        try:
            members, _ = self.clusters(project_id, algorithm_id, threshold)
        except Invalid:
            return None
        n = members.agg(F.countDistinct("cluster_id").alias("clusters"), F.count(F.lit(1)).alias("assets")).first()
        e = reads.canonical(reads.at_least(self.edges(project_id, algorithm_id), hashing.round_threshold(threshold))).count()
        return {"cluster_count": n.clusters, "edge_count": e, "assets_with_duplicate_count": n.assets}
