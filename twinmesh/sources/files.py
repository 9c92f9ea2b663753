"""Files as a source of assets: recursive scans, recipes, and pages as JSON."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinmesh.errors import AlgorithmContract, Invalid
from twinmesh.functions import scalars
from twinmesh.functions.parsing import PageInfo

#: Recipes that are computed here, from the columns ``content`` (binary) and ``text``: an array of hashes each.
RECIPES: dict[str, tuple[str, Callable[[], Column]]] = {
    "binary.sha256": ("exact", lambda: F.array(F.sha2("content", 256))),
    "text.line_sha256": ("exact", lambda: F.transform(F.filter(F.split(F.col("content").cast("string"), "\n"), lambda x: F.trim(x) != ""), lambda x: F.sha2(x, 256))),
}


def register_recipe(name: str, comparison: str, hashes: Callable[[], Column]) -> None:
    """Adds a recipe: an expression of an array of hashes. The same name with another comparison is an
    error."""
    if name in RECIPES and RECIPES[name][0] != comparison:
        raise AlgorithmContract(f"recipe {name} is registered as {RECIPES[name][0]}")
    RECIPES[name] = (comparison, hashes)


def glob_pattern(glob: str) -> str:
    """A regular expression of a glob: * and ? stay within a folder, ** goes through any number of them."""
    out = ""
    for part in re.split(r"(\*\*/|\*\*|\*|\?)", glob):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or re.escape(part)
    return f"^{out}$"


def scan(spark: SparkSession, path: str, include: str | list[str] | None = None, prefix: str = "") -> DataFrame:
    """(identity_path, content, mime_hint, error) of the files below a folder, or of one file. ``include`` are globs of the
    path below the folder, of which one must match (a glob without a folder is one of the file name). Hidden files
    aren't read; files without an extension come with an error and don't stop the scan."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    absolute = F.regexp_replace(F.col("path"), "^file:/+", "/")
    files = reader.load(path)
    globs = [include] if isinstance(include, str) else include or []
    if globs:
        below = F.regexp_replace(absolute, "^" + re.escape(re.sub("^file:/+", "/", path).rstrip("/")) + "/?", "")
        files = files.where(reduce(or_, [below.rlike(glob_pattern(g if "/" in g else f"**/{g}")) for g in globs]))
    files = files.select(F.concat(F.lit(prefix), absolute).alias("identity_path"), "content")
    hint = scalars.mime_hint(F.col("identity_path"))
    return files.withColumn("mime_hint", hint).withColumn("error", F.when(hint.isNull(), F.lit("no extension to derive a type from")))


def hashed(files: DataFrame, recipes: list[str]) -> DataFrame:
    """(identity_path, recipe, hashes) of files without an error, one row per recipe."""
    unknown = [r for r in recipes if r not in RECIPES]
    if unknown:
        raise Invalid(f"unknown recipes: {', '.join(unknown)}")
    pairs = F.array(*[F.struct(F.lit(r).alias("recipe"), RECIPES[r][1]().alias("hashes")) for r in recipes])
    return files.where("error is null").select("identity_path", F.explode(pairs).alias("r")).select("identity_path", "r.recipe", "r.hashes")


def failures(files: DataFrame) -> DataFrame:
    """(identity_path, error) of the files that can't be hashed."""
    return files.where("error is not null").select("identity_path", "error")


def text_table(rows: DataFrame, columns: list[str]) -> str:
    """A page as text, columns padded to their widest value; nulls are blank."""
    lines = [columns, *[["" if r[c] is None else str(r[c]) for c in columns] for r in rows.select(*columns).collect()]]
    widths = [max(len(x[i]) for x in lines) for i in range(len(columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(line, widths)).rstrip() for line in lines)


def page_json(rows: DataFrame, info: PageInfo, camel: bool = False) -> dict:
    """A page envelope, its own keys in snake_case or camelCase; the page's rows, at most 100, are collected."""
    envelope = _envelope(rows, info)
    return {re.sub(r"_(\w)", lambda m: m[1].upper(), k): v for k, v in envelope.items()} if camel else envelope


def _envelope(rows: DataFrame, info: PageInfo) -> dict:
    return {
        "data": [r.asDict(recursive=True) for r in rows.collect()],
        "total_count": info.total_count, "current_count": info.current_count, "current_page": info.current_page, "page_size": info.page_size,
        "page_count": info.page_count, "has_next_page": info.has_next_page, "has_previous_page": info.has_previous_page,
    }
