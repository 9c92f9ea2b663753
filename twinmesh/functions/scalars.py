"""Small column expressions of the registry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def patched(raw: Column, previous: Column) -> Column:
    """A field of an identity patch: null keeps, an empty string clears, anything else replaces."""
    return F.when(raw.isNull(), previous).when(raw == "", F.lit(None)).otherwise(raw)


def comma_list(col: Column) -> Column:
    """A comma-separated list: parts trimmed, empty parts dropped."""
    return F.filter(F.transform(F.split(col, ","), lambda x: F.trim(x)), lambda x: x != "")


def deduped(col: Column) -> Column:
    """A list without repeats, in first-seen order."""
    return F.array_distinct(col)


def identity(prefix: str = "") -> Column:
    """The identity as struct<id, path>; both fields are always there."""
    return F.struct(F.col(f"{prefix}identity_id").alias("id"), F.col(f"{prefix}identity_path").alias("path"))


def identity_text(id_: Column, path: Column) -> Column:
    """id=..., path=... with the parts that are set."""
    return F.concat_ws(", ", F.concat(F.lit("id="), id_), F.concat(F.lit("path="), path))


def mime_hint(path: Column) -> Column:
    """The extension of a path in lower case; null where there is none."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext != "", ext)


def asset_key(project: Column, key: Column) -> Column:
    """A deterministic uuid-shaped id from project and identity."""
    h = F.md5(F.concat_ws("\u0001", project, key))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))


def path_term(col: Column, term: str) -> Column:
    """A path search term: * is any text, everything else stands for itself; letter case is ignored,
    and a term without * must equal the whole path."""
    pattern = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
    return col.ilike(pattern)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole with two decimals, half up; 0 where whole is 0."""
    return F.when(whole > 0, F.floor(part * F.lit(10000.0) / whole + F.lit(0.5)) / F.lit(100.0)).otherwise(F.lit(0.0))
