"""Streaming ingest, an extension: micro-batches of hashing answers go through the registry's ingest."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from twinmesh.plans.registry import Registry


def ingest_stream(registry: Registry, project_id: str, answers: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Runs ``registry.ingest`` for every micro-batch of a stream (identity_id, identity_path, recipe,
    hashes). A batch that is delivered again leaves the same state: its hashes are unchanged then."""

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            # of several answers for one place, the one with most hashes counts, then the greatest list: whatever their order
            best = F.max_by("hashes", F.struct(F.size("hashes"), "hashes")).alias("hashes")
            registry.ingest(project_id, df.groupBy("identity_id", "identity_path", "recipe").agg(best), dt.datetime.now(dt.timezone.utc))

    return answers.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
