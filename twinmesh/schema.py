"""Tables of the registry and the values their enumerations take."""

from __future__ import annotations

from pyspark.sql import types as T

EXACT, HAMMING, COSINE = "exact", "hamming", "cosine"
COMPARISONS = (EXACT, HAMMING, COSINE)
SCOPES = ("read", "write", "*")
CREATED, UPDATED, UNCHANGED = "created", "updated", "unchanged"

_S, _I, _B, _D, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType()


def _table(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], len(f) == 2 or f[2]) for f in fields])


PROJECTS = _table(("project_id", _S), ("slug", _S), ("name", _S), ("recipes", T.ArrayType(_S)), ("hamming_threshold", T.DecimalType(5, 2)))
ALGORITHMS = _table(("algorithm_id", _I), ("recipe", _S), ("comparison", _S), ("bits", _I))
ASSETS = _table(("asset_id", _S), ("project_id", _S), ("identity_id", _S), ("identity_path", _S), ("created_at", _TS), ("updated_at", _TS))
HASHES = _table(("project_id", _S), ("algorithm_id", _I), ("asset_id", _S), ("sequence_index", _I), ("hash", _S))
EDGES = _table(("project_id", _S), ("algorithm_id", _I), ("asset_id", _S), ("other_asset_id", _S), ("distance", _I), ("similarity", _D), ("computed_at", _TS))
CLUSTERS = _table(("project_id", _S), ("algorithm_id", _I), ("asset_id", _S), ("cluster_id", _S), ("avg_similarity", _D), ("max_similarity", _D))
API_CLIENTS = _table(("client_id", _S), ("project_id", _S), ("name", _S), ("key_hash", _S), ("scopes", T.ArrayType(_S)), ("revoked_at", _TS), ("created_at", _TS))
