"""Checking new batches against everything accepted before, without reading the history again.

A hash of L bits is the set of its L elements (position, bit), of which two hashes at distance d
share L - d. Its one-permutation minwise signature has one bin per position, so the bin's minimum is
the position's bit; the bins are taken in a fixed pseudorandom order and cut into bands, and a band
key is the hash of (project, recipe, band, bits). With d_max + 1 bands, two hashes at distance
d_max or less agree in one band at least (pigeonhole), so probing equal keys loses nothing. An exact
recipe has one band, the whole hash.

The index is a folder under a name: one segment per accepted batch, with its members, its band keys
(key, signature words; one row per distinct hash and band) in folders by a prefix of the key, and the pairs
of signatures that it matched when it came. A segment has as many key folders as its rows need, and a probe reads,
of every segment, only the folders that its keys fall in: a batch costs its own keys times the size of a
folder, and not the history. Rows whose key a probe has go on; where the probes' keys are few enough to be
broadcast (PROBES), nothing of the history is shuffled. A segment counts once its manifest is there, which is
written last, so a batch that was cut off is accepted again.

Copies of a hash are one signature, so a hash that a third of all rows share is probed once. A band
key that very many signatures share is refined: within it the other bits are cut into d_max + 1
sub-bands of which, again, one must agree; and what such a sub-band still shares is dealt into slices that each
probe visits. So no pair is lost, no bucket is compared all with all, and no task gets an unbounded key.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import random
import sys
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinmesh.session import Scratch, shared_folder, ship

#: Rows of a key folder, and folders of a segment at most (their rows grow beyond: 65,536 of some
#: millions of rows at a hundred terabytes).
FOLDER_ROWS, MOST_FOLDERS = 65_536, 65_536
#: Probe keys that are broadcast at most (8 bytes each); beyond, both sides are shuffled by key.
PROBES = 2_000_000
#: Band keys of more signatures than this are refined by sub-bands; a sub-band's slices and the slices of a
#: class of members have about as many rows.
WIDE_KEY = 1_000
#: Batches of one load that are probed at the same time.
AT_ONCE = 2
WORDS = ["w0", "w1", "w2", "w3"]
BITS = 256
SIGNATURE = ["algorithm_id", "project", *WORDS]
OTHER = [f"o_{w}" for w in WORDS]
MEMBER = "algorithm_id int, project_id string, asset_id string, created_at timestamp, project bigint, w0 bigint, w1 bigint, w2 bigint, w3 bigint"
KEY = "key bigint, band int, algorithm_id int, project bigint, w0 bigint, w1 bigint, w2 bigint, w3 bigint"
FOUND = "algorithm_id int, project bigint, w0 bigint, w1 bigint, w2 bigint, w3 bigint, o_w0 bigint, o_w1 bigint, o_w2 bigint, o_w3 bigint"


def hash_words(hash_: Column) -> list[Column]:
    """The four 64-bit words of 64 hexadecimal digits."""
    return [F.conv(F.substring(hash_, 1 + 16 * i, 16), 16, -10).cast("bigint").alias(w) for i, w in enumerate(WORDS)]


def _cuts(seed: int, bands: int, positions: list[int] | None = None) -> list[list[int]]:
    order = list(positions if positions is not None else range(BITS))
    random.Random(seed).shuffle(order)
    return [sorted(order[len(order) * i // bands : len(order) * (i + 1) // bands]) for i in range(bands)]


def _masks(positions: list[int]) -> list[int]:
    """For each word, the mask of the positions as a signed 64-bit integer."""
    out = []
    for w in range(4):
        m = sum(1 << (63 - p % 64) for p in positions if p // 64 == w)
        out.append(m - (1 << 64) if m >= 1 << 63 else m)
    return out


def _band(number: int, positions: list[int]) -> Column:
    """(band, key) of one band of a Hamming signature."""
    bits = [F.col(w).bitwiseAND(F.lit(m)) for w, m in zip(WORDS, _masks(positions)) if m]
    return F.struct(F.lit(number).alias("band"), F.xxhash64("algorithm_id", "project", F.lit(number), *bits).alias("key"))


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


class HistoryIndex:
    """Members, band keys and matches of everything accepted so far, under ``name`` in the shared folder.

    ``exact`` and ``near`` are algorithm ids; two hashes of a near one match within d_max bits. An index that is
    opened again under its name goes on with the batches that it has."""

    def __init__(self, spark: SparkSession, name: str, exact: int, near: int, d_max: int, seed: int = 7) -> None:
        ship(spark)
        self.spark, self.exact, self.near, self.d_max = spark, exact, near, d_max
        self.root = f"{shared_folder(spark)}/history-{name}"
        self.scratch = Scratch(spark, "history")
        self.cuts = _cuts(seed, d_max + 1)
        self.subcuts = [_cuts(seed + 1 + i, d_max + 1, [p for p in range(BITS) if p not in set(cut)]) for i, cut in enumerate(self.cuts)]
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.segments = self._load()

    # --- segments

    def _load(self) -> dict[int, dict]:
        folder = self._path(f"{self.root}/manifests")
        out = {}
        for f in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            if f.getPath().getName().endswith(".json"):
                stream = self._fs.open(f.getPath())
                try:
                    m = json.loads(bytes(stream.readAllBytes()).decode())
                finally:
                    stream.close()
                out[m["batch"]] = m
        return dict(sorted(out.items()))

    def _publish(self, manifest: dict) -> None:
        """Manifests are written once: of two writers of a batch the first one counts."""
        final, new = (self._path(f"{self.root}/manifests/{n}") for n in (f"{manifest['batch']:09d}.json", f".{uuid.uuid4().hex}"))
        self._fs.mkdirs(final.getParent())
        stream = self._fs.create(new)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        if self._fs.exists(final) or not self._fs.rename(new, final):
            self._fs.delete(new, False)
        self.segments = self._load()

    def _read(self, path: str, schema: str, folders: list[int] | None = None) -> DataFrame:
        reader = self.spark.read.schema(schema)
        if folders is None:
            return reader.parquet(path)
        return reader.option("basePath", path).parquet(*[f"{path}/folder={f}" for f in folders])

    def members(self, since: int | None = None) -> DataFrame:
        """All members, or those of the batches from ``since`` on (rows repeat where a batch repeats them)."""
        parts = [self._read(m["members"], MEMBER) for b, m in self.segments.items() if m["rows"] and (since is None or b >= since)]
        return _union(parts) if parts else self.spark.createDataFrame([], MEMBER)

    def found(self, since: int = 0) -> DataFrame:
        """Pairs of signatures (algorithm_id, project, w0..w3, o_w0..o_w3): those of each batch from ``since``
        on with those that were there when it came, itself included."""
        parts = [self._read(m["found"], FOUND) for b, m in self.segments.items() if b >= since and m["found"]]
        return _union(parts).distinct() if parts else self.spark.createDataFrame([], FOUND)

    def accept(self, batch: int, members: DataFrame, match: bool = True) -> None:
        """Accepts one batch, see ``accept_all``."""
        self.accept_all([batch], members.withColumn("batch", F.lit(batch)), batch if match else batch + 1)

    def accept_all(self, batches: list[int], members: DataFrame, match_from: int) -> None:
        """Accepts batches of members (batch, algorithm_id, project_id, asset_id, created_at, project, w0..w3), one after
        the other: finds the signatures of the batch and of earlier ones that are equal or near to each of its
        signatures (not before ``match_from``, for a first load), and adds it to the index. A batch that is there
        already is left as it is. Of earlier batches only the key folders that this one's keys fall in are read.
        Members and keys of the given batches are written together."""
        batches = sorted(b for b in batches if b not in self.segments)
        if not batches:
            return
        path = f"{self.root}/{uuid.uuid4().hex}"
        columns = [f.split()[0] for f in MEMBER.split(", ")]
        members.where(F.col("batch").isin(batches)).select("batch", *columns).write.partitionBy("batch").parquet(f"{path}/members")
        members = self.spark.read.schema(f"{MEMBER}, batch int").parquet(f"{path}/members")
        rows = {r["batch"]: r["count"] for r in members.groupBy("batch").count().collect()}  # one for each batch
        bits = {b: self._bits(rows.get(b, 0) * (self.d_max + 1)) for b in batches}
        folder = F.lit(0)
        for b in batches:
            folder = F.when(F.col("batch") == b, self._folder(bits[b])).otherwise(folder)
        keys = self.band_keys(members.select("batch", *SIGNATURE).distinct(), "batch").withColumn("folder", folder)
        keys.repartition("batch", "folder").sortWithinPartitions("batch", "folder", "key").write.partitionBy("batch", "folder").parquet(f"{path}/keys")
        new = {b: {"batch": b, "rows": rows.get(b, 0), "bits": bits[b], "members": f"{path}/members/batch={b}", "keys": f"{path}/keys/batch={b}", "found": None} for b in batches}
        known = {**self.segments, **new}

        def probe(b: int) -> None:
            if b >= match_from and new[b]["rows"]:
                self.matches(self._read(new[b]["keys"], KEY), {k: known[k] for k in sorted(known) if k <= b}).write.parquet(f"{path}/found-{b}")
                new[b]["found"] = f"{path}/found-{b}"

        # a batch reads the segments up to its own, which are all written: the probes of several may run at once
        with ThreadPoolExecutor(AT_ONCE) as pool:
            list(pool.map(probe, batches))
        for b in batches:
            self._publish(new[b])

    def _bits(self, rows: int) -> int:
        bits = 0
        while rows > FOLDER_ROWS << bits and 1 << bits < MOST_FOLDERS:
            bits += 1
        return bits

    def _folder(self, bits: int) -> Column:
        """The folder of a key: the first bits of its unsigned value."""
        return F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)

    def band_keys(self, signatures: DataFrame, *also: str) -> DataFrame:
        """One row per signature and band: (key, band, signature columns)."""
        near = signatures.where(F.col("algorithm_id") == self.near).withColumn("b", F.explode(F.array(*[_band(i, c) for i, c in enumerate(self.cuts)])))
        exact = signatures.where(F.col("algorithm_id") == self.exact).withColumn("b", F.struct(F.lit(-1).alias("band"), F.xxhash64(*SIGNATURE).alias("key")))
        return near.unionByName(exact).select("b.key", "b.band", *SIGNATURE, *also)

    # --- probes

    def hits(self, probes: DataFrame, segments: dict[int, dict]) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
        """The stored key rows whose key a probe has, and per segment the folders read and those there are."""
        keys, most = probes.select("key"), max((m["bits"] for m in segments.values()), default=0)
        at = {r.f: r["count"] for r in keys.select(self._folder(most).alias("f")).groupBy("f").count().collect()}  # at most MOST_FOLDERS numbers
        few = sum(at.values()) <= PROBES
        parts, read = [], {}
        for b, m in segments.items():
            if not m["rows"]:
                continue
            there = {int(f.getPath().getName().split("=")[1]) for f in self._fs.listStatus(self._path(m["keys"])) if "=" in f.getPath().getName()}
            wanted = sorted(there & {f >> (most - m["bits"]) for f in at})
            read[b] = (len(wanted), len(there))
            if wanted:
                parts.append(self._read(m["keys"], KEY, wanted).select(*[f.split()[0] for f in KEY.split(", ")]))
        stored = _union(parts) if parts else self.spark.createDataFrame([], KEY)
        return stored.join(F.broadcast(keys) if few else keys.distinct(), "key", "left_semi"), read

    def _near(self) -> Column:
        d = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"o_{w}"))) for w in WORDS[1:]), F.bit_count(F.col("w0").bitwiseXOR(F.col("o_w0"))))
        return ((F.col("algorithm_id") == self.exact) & (d == 0)) | ((F.col("algorithm_id") == self.near) & (d <= self.d_max))

    def _refine(self, rows: DataFrame) -> DataFrame:
        """Rows of wide band keys, with the key refined by each sub-band."""
        parts = F.lit(None)
        for i, subs in enumerate(self.subcuts):
            keys = F.array(*[F.xxhash64("key", F.lit(j), *[F.col(w).bitwiseAND(F.lit(m)) for w, m in zip(WORDS, _masks(s)) if m]) for j, s in enumerate(subs)])
            parts = F.when(F.col("band") == i, keys).otherwise(parts)
        return rows.withColumn("key", F.explode(parts))

    def matches(self, probes: DataFrame, segments: dict[int, dict]) -> DataFrame:
        """Pairs of signatures of which the first is one of those whose band keys are the probes and the second anywhere
        in the segments, equal or near; a signature matches itself."""
        stored = self.scratch.store(self.hits(probes, segments)[0], "hits")
        count = lambda x: x.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WIDE_KEY)
        wide = count(stored.where("band >= 0")).select("key")
        other = lambda x, *also: x.select("key", *also, F.col("algorithm_id").alias("o_alg"), F.col("project").alias("o_project"), *[F.col(w).alias(f"o_{w}") for w in WORDS])
        if wide.isEmpty():
            pairs = probes.join(other(stored), "key")
        else:
            wide = self.scratch.store(wide, "wide")
            pairs = probes.join(wide, "key", "left_anti").join(other(stored.join(wide, "key", "left_anti")), "key")
            fine = self.scratch.store(self._refine(stored.join(wide, "key", "left_semi")), "fine")
            slices = count(fine).select("key", F.ceil(F.col("n") / WIDE_KEY).cast("int").alias("slices"))
            sliced = lambda x: x.join(slices, "key", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
            mine = sliced(self._refine(probes.join(wide, "key", "left_semi"))).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
            theirs = other(sliced(fine).withColumn("slice", F.pmod(F.xxhash64(*WORDS), F.col("slices")).cast("int")), "slice")
            pairs = pairs.unionByName(mine.join(theirs, ["key", "slice"]).select(pairs.columns))
        same = (F.col("algorithm_id") == F.col("o_alg")) & (F.col("project") == F.col("o_project"))
        return pairs.where(same & self._near()).select(*SIGNATURE, *OTHER).distinct()

    def pairs(self, since: int) -> DataFrame:
        """Pairs of members (algorithm_id, project_id, asset_id, created_at, o_asset, o_created) of
        the same project, the first of a batch from ``since`` on, the second of any; each pair of assets is
        there once for each of its hashes that match. A signature of very many members is dealt into slices."""
        own = self.members(since)
        theirs = self.members().select("algorithm_id", "project", F.col("project_id").alias("o_project_id"), F.col("asset_id").alias("o_asset"), F.col("created_at").alias("o_created"), *[F.col(w).alias(f"o_{w}") for w in WORDS])
        at = ["algorithm_id", "project", *OTHER]
        slices = theirs.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WIDE_KEY).select(*at, F.ceil(F.col("n") / WIDE_KEY).cast("int").alias("slices"))
        mine = own.join(self.found(since), SIGNATURE)
        if slices.isEmpty():
            both = mine.join(theirs, at)
        else:
            slices = self.scratch.store(slices, "slices")
            sliced = lambda x: x.join(slices, at, "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
            mine = sliced(mine).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
            both = mine.join(sliced(theirs).withColumn("slice", F.pmod(F.xxhash64("o_asset"), F.col("slices")).cast("int")).drop("slices"), [*at, "slice"])
        return both.where("project_id = o_project_id and asset_id <> o_asset").select("algorithm_id", "project_id", "asset_id", "created_at", "o_asset", "o_created")


def fingerprint(spark: SparkSession, paths: list[str], *also: object) -> str:
    """A name for what this module derives from the files below the paths: changes when one of them, or the
    module, does."""
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    facts = [repr(also), inspect.getsource(sys.modules[__name__])]
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        files = path.getFileSystem(conf).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            facts.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(facts)).encode()).hexdigest()[:32]


def members_of(hashes: DataFrame, exact: int, near: int) -> DataFrame:
    """Distinct (algorithm_id, project_id, asset_id, created_at, project, w0..w3) of the usable hashes
    of both recipes. created_at is the asset's latest in that recipe over all its rows, usable or
    not; project is a 64-bit hash of project_id. Rows with null ids have no usable hash."""
    from twinmesh.sources.tables import plain_hash

    rows = hashes.where(F.col("algorithm_id").isin(exact, near) & F.col("asset_id").isNotNull() & F.col("project_id").isNotNull())
    rows = rows.select("algorithm_id", "project_id", "asset_id", "created_at", plain_hash().alias("h"))
    # both sides combine before their shuffle, and no list is built, whatever an asset holds
    of = ["algorithm_id", "project_id", "asset_id"]
    made = rows.groupBy(*of).agg(F.max("created_at").alias("created_at"))
    usable = rows.where(F.col("h").rlike("^[0-9a-f]{64}$")).select(*of, "h").distinct()
    return usable.join(made, of).select(*of, "created_at", F.xxhash64("project_id").alias("project"), *hash_words(F.col("h")))


def unrecorded(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Of pairs (algorithm_id, asset_id, created_at, o_asset, o_created), those for which no usable
    edge in either direction was computed at or after the later created_at; smaller asset first."""
    from twinmesh.sources.tables import usable_edge

    lo, hi = F.least("asset_id", "o_asset"), F.greatest("asset_id", "o_asset")
    pairs = pairs.groupBy("algorithm_id", lo.alias("asset_id"), hi.alias("other_asset_id")).agg(F.max(F.greatest("created_at", "o_created")).alias("later"))
    known = edges.where(usable_edge()).select("algorithm_id", F.least("asset_id", "other_asset_id").alias("asset_id"), F.greatest("asset_id", "other_asset_id").alias("other_asset_id"), "computed_at")
    known = known.groupBy("algorithm_id", "asset_id", "other_asset_id").agg(F.max("computed_at").alias("computed_at"))
    left = pairs.join(known, ["algorithm_id", "asset_id", "other_asset_id"], "left")
    return left.where(F.col("computed_at").isNull() | (F.col("computed_at") < F.col("later"))).select("algorithm_id", "asset_id", "other_asset_id")
