"""The registry as a Python object: what a service or a notebook would call.

Projects, algorithms and API clients are small and live in the driver; assets, hashes and edges are
DataFrames. All of it is kept below the registry's folder: assets, hashes and the catalogue as one version
under a numbered manifest, edges and clusters by scope (``plans.state``). A new process opens what is there.

Exact recipes keep their classes: a scope's edges are the links of each member to its class's smallest
asset, n - 1 rows for n copies, which have the same clusters; matches and rankings are read from the
hashes.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
import secrets
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinmesh.errors import AlgorithmContract, AlreadyExists, Forbidden, Invalid, NotFound, Unauthorized, UnsupportedRecipe
from twinmesh.functions import parsing, scalars
from twinmesh.operators import exact, hamming, mutations, reads
from twinmesh.plans.state import EdgeState, Store
from twinmesh.schema import ASSETS, COSINE, EXACT, HAMMING, HASHES
from twinmesh.session import Scratch


#: Assets of one recomputation whose hashes are broadcast against the scope's; more are a rebuild.
INCREMENTAL = 5_000


@dataclass(frozen=True)
class Project:
    project_id: str
    slug: str
    name: str
    recipes: tuple[str, ...]
    hamming_threshold: float | None = None
    rate_limit_per_minute: int | None = None


@dataclass(frozen=True)
class Algorithm:
    algorithm_id: int
    recipe: str
    comparison: str
    bits: int | None = None


@dataclass(frozen=True)
class ApiClient:
    client_id: str
    project_id: str
    name: str
    key_hash: str
    scopes: tuple[str, ...]
    created_at: dt.datetime
    revoked_at: dt.datetime | None = None


@dataclass
class Catalogue:
    """Projects, algorithms and API clients, with their rules."""

    projects: dict[str, Project] = field(default_factory=dict)
    algorithms: dict[str, Algorithm] = field(default_factory=dict)
    clients: dict[str, ApiClient] = field(default_factory=dict)

    def create_project(self, slug: str, name: str, recipes: list[str], hamming_threshold: float | None = None, rate_limit_per_minute: int | None = None, project_id: str | None = None) -> Project:
        if any(p.slug == slug for p in self.projects.values()):
            raise AlreadyExists(f"project {slug} already exists")
        p = Project(project_id or str(uuid.uuid4()), slug, name, tuple(parsing.valid_recipes(recipes)), parsing.valid_threshold(hamming_threshold), parsing.valid_rate_limit(rate_limit_per_minute))
        self.projects[p.project_id] = p
        return p

    def update_project(self, project_id: str, **changes: object) -> Project:
        """Changes recipes, hamming_threshold, rate_limit_per_minute or name; edges aren't rewritten."""
        p = self.project(project_id)
        if "recipes" in changes:
            changes["recipes"] = tuple(parsing.valid_recipes(list(changes["recipes"])))
        parsing.valid_threshold(changes.get("hamming_threshold"))
        parsing.valid_rate_limit(changes.get("rate_limit_per_minute"))
        self.projects[project_id] = replace(p, **changes)
        return self.projects[project_id]

    def delete_project(self, project_id: str) -> None:
        self.projects.pop(project_id, None)
        self.clients = {k: c for k, c in self.clients.items() if c.project_id != project_id}

    def project(self, project_id: str) -> Project:
        if project_id not in self.projects:
            raise NotFound(f"no project {project_id}")
        return self.projects[project_id]

    def by_slug(self, slug: str) -> Project:
        for p in self.projects.values():
            if p.slug == slug:
                return p
        raise NotFound(f"no project {slug}")

    def list_projects(self) -> list[Project]:
        return sorted(self.projects.values(), key=lambda p: p.slug)

    def algorithm(self, recipe: str, comparison: str, bits: int | None = None) -> Algorithm:
        """The algorithm of a recipe, added where it is new; another comparison is a contract error."""
        known = self.algorithms.get(recipe)
        if known is None:
            known = self.algorithms[recipe] = Algorithm(max((a.algorithm_id for a in self.algorithms.values()), default=0) + 1, recipe, comparison, bits)
        elif known.comparison != comparison:
            raise AlgorithmContract(f"{recipe} is stored as {known.comparison}, not {comparison}")
        return known

    def create_client(self, project_id: str, name: str, scopes: list[str], now: dt.datetime) -> tuple[ApiClient, str]:
        """A client and its key, of which only the hash is kept; a name is free again once revoked."""
        self.project(project_id)
        for s in scopes:
            parsing.has_scope([], s)
        if any(c.project_id == project_id and c.name == name and c.revoked_at is None for c in self.clients.values()):
            raise AlreadyExists(f"client {name} already exists")
        key = secrets.token_hex(32)
        c = ApiClient(str(uuid.uuid4()), project_id, name, hashlib.sha256(key.encode()).hexdigest(), tuple(dict.fromkeys(scopes)), now)
        self.clients[c.client_id] = c
        return c, key

    def revoke_client(self, client_id: str, now: dt.datetime) -> None:
        c = self.clients.get(client_id)
        if c is None or c.revoked_at is not None:
            raise NotFound(f"no active client {client_id}")
        self.clients[client_id] = replace(c, revoked_at=now)

    def authenticate(self, key: str, scope: str) -> Project:
        h = hashlib.sha256(key.encode()).hexdigest()
        for c in self.clients.values():
            if c.key_hash == h and c.revoked_at is None:
                if not parsing.has_scope(list(c.scopes), scope):
                    raise Forbidden(f"scope {scope} isn't granted")
                return self.project(c.project_id)
        raise Unauthorized("unknown key")

    def to_json(self) -> dict:
        return {k: [asdict(x) for x in getattr(self, k).values()] for k in ("projects", "algorithms", "clients")}

    @classmethod
    def of_json(cls, value: dict) -> Catalogue:
        when = lambda x: x and dt.datetime.fromisoformat(x)
        projects = [Project(**{**p, "recipes": tuple(p["recipes"])}) for p in value["projects"]]
        algorithms = [Algorithm(**a) for a in value["algorithms"]]
        clients = [ApiClient(**{**c, "scopes": tuple(c["scopes"]), "created_at": when(c["created_at"]), "revoked_at": when(c["revoked_at"])}) for c in value["clients"]]
        return cls({p.project_id: p for p in projects}, {a.recipe: a for a in algorithms}, {c.client_id: c for c in clients})

    def list_clients(self, project_id: str) -> list[ApiClient]:
        return sorted((c for c in self.clients.values() if c.project_id == project_id), key=lambda c: c.created_at)


class Registry:
    """Assets, hashes and versioned edges of all projects, kept below ``root``. A catalogue that is given takes the
    place of the stored one."""

    def __init__(self, spark: SparkSession, root: str, catalogue: Catalogue | None = None, default_threshold: float = 85.0, **state: object) -> None:
        self.spark, self.default_threshold = spark, default_threshold
        self.state = EdgeState(spark, root, **state)
        self.store: Store = self.state.store
        self.version, stored = self.store.newest("registry")
        self._stored = stored or {"assets": None, "hashes": None, "catalogue": Catalogue().to_json(), "retired": []}
        self.catalogue = catalogue or Catalogue.of_json(self._stored["catalogue"])
        self.assets, self.hashes = self._table("assets", ASSETS), self._table("hashes", HASHES)

    def _table(self, name: str, schema) -> DataFrame:
        at = self._stored[name]
        return self.spark.read.schema(schema).parquet(f"{self.store.root}/{at}") if at else self.spark.createDataFrame([], schema)

    def save(self, assets: DataFrame | None = None, hashes: DataFrame | None = None) -> None:
        """Publishes a new version: the catalogue as it is, and the tables that are given."""
        m = {**self._stored, "catalogue": json.loads(json.dumps(self.catalogue.to_json(), default=lambda x: x.isoformat())), "retired": list(self._stored["retired"])}
        for name, df, schema in (("assets", assets, ASSETS), ("hashes", hashes, HASHES)):
            if df is not None:
                path = f"registry/{name}-{uuid.uuid4().hex}"
                df.select([F.col(f.name).cast(f.dataType) for f in schema.fields]).write.parquet(f"{self.store.root}/{path}")
                if m[name]:
                    m["retired"].append({"path": m[name], "at": self.state.clock()})
                m[name] = path
        self.version = self.store.publish("registry", self.version, m)
        self.store.sweep(m, self.state.clock() - self.state.retention_s)
        self._stored = m
        self.assets, self.hashes = self._table("assets", ASSETS), self._table("hashes", HASHES)

    def scope(self, project_id: str, recipe: str, threshold: str | None = None) -> tuple[Project, Algorithm, float, bool]:
        """Project, algorithm, effective threshold, and whether a given threshold has no effect (exact
        recipes): the recipe must be configured in the project and have been hashed."""
        p = self.catalogue.project(project_id)
        if recipe not in p.recipes:
            raise Invalid(f"recipe {recipe} isn't configured")
        a = self.catalogue.algorithms.get(recipe)
        if a is None:
            raise Invalid(f"recipe {recipe} was never hashed")
        fallback = p.hamming_threshold if p.hamming_threshold is not None else self.default_threshold
        return p, a, parsing.percentage(threshold, fallback), a.comparison == EXACT and threshold is not None

    # --- changes

    def ingest(self, project_id: str, answers: DataFrame, now: dt.datetime) -> DataFrame:
        """Adds or updates assets with their hashes: rows (identity_id, identity_path, recipe,
        hashes), one per identity and recipe, of recipes that the catalogue has. Returns (asset_id, identity_id,
        identity_path, recipe, status). Only scopes with a change are recomputed, once each.

        A batch with an identity conflict is refused as a whole, before anything is written."""
        scratch = Scratch(self.spark, "ingest")
        known = [(a.recipe, a.algorithm_id) for a in self.catalogue.algorithms.values()]
        missing = answers.select("recipe").distinct().join(F.broadcast(self.spark.createDataFrame(known, "recipe string, algorithm_id int")), "recipe", "left_anti").first()
        if missing is not None:
            raise AlgorithmContract(f"unknown recipe {missing.recipe}")
        batch = answers.select(F.lit(project_id).alias("project_id"), "identity_id", "identity_path").distinct()
        plan = mutations.patch_identities(self.assets, batch)
        plan = scratch.store(plan.withColumn("_new", scalars.asset_key(F.col("project_id"), F.concat_ws("\u0002", F.coalesce("identity_id", F.lit("")), F.coalesce("identity_path", F.lit(""))))).withColumn("asset_id", F.coalesce("asset_id", "_new")).drop("_new"))
        bad = plan.where("status = 'conflict'").first()
        if bad is not None:
            raise AlreadyExists(f"conflicting identity: id={bad.identity_id}, path={bad.identity_path}")
        new_assets = plan.join(self.assets.select("asset_id", F.col("created_at").alias("_c")), "asset_id", "left").select("asset_id", "project_id", "identity_id", "identity_path", F.coalesce("_c", F.lit(now)).alias("created_at"), F.lit(now).alias("updated_at"))
        # an answer finds its asset by the patched identity: by id, else by path
        by_id = plan.where("identity_id is not null").select("asset_id", "identity_id")
        by_path = plan.where("identity_path is not null").select("asset_id", "identity_path")
        rows = answers.select("identity_id", "identity_path", "recipe", "hashes")
        with_id = rows.where("identity_id is not null and identity_id <> ''").join(by_id, "identity_id").select("asset_id", "recipe", "hashes")
        without = rows.where("identity_id is null or identity_id = ''").join(by_path, "identity_path").select("asset_id", "recipe", "hashes")
        algorithms = F.broadcast(self.spark.createDataFrame(known, "recipe string, algorithm_id int"))
        answered = scratch.store(with_id.unionByName(without).join(algorithms, "recipe").withColumn("project_id", F.lit(project_id)))
        statuses = scratch.store(mutations.hash_statuses(self.hashes, answered).join(algorithms, "algorithm_id"))
        changed = statuses.where("status <> 'unchanged'")
        touched = answered.join(changed.select("asset_id", "algorithm_id"), ["asset_id", "algorithm_id"], "left_semi")
        self.save(mutations.upsert(self.assets, new_assets, ["asset_id"]), mutations.replace_hashes(self.hashes, touched.select("project_id", "algorithm_id", "asset_id", "hashes")))
        for r in changed.groupBy("algorithm_id").count().collect():
            self.recompute_assets(project_id, r.algorithm_id, changed.where(F.col("algorithm_id") == r.algorithm_id).select("asset_id"), r["count"])
        return statuses.join(self.assets.select("asset_id", "identity_id", "identity_path"), "asset_id").select("asset_id", "identity_id", "identity_path", "recipe", "status")

    def _algorithm(self, algorithm_id: int) -> Algorithm:
        a = next((x for x in self.catalogue.algorithms.values() if x.algorithm_id == algorithm_id), None)
        if a is None:
            raise NotFound(f"no algorithm {algorithm_id}")
        if a.comparison == COSINE:
            raise UnsupportedRecipe(f"{a.recipe}: cosine edges aren't kept in the registry")
        return a

    def _threshold(self, project_id: str) -> float:
        p = self.catalogue.project(project_id)
        return p.hamming_threshold if p.hamming_threshold is not None else self.default_threshold

    def recompute(self, project_id: str, algorithm_id: int) -> int:
        """Rebuilds the edges of a scope at the project's threshold by one distributed join; returns
        the new generation. An exact scope is rebuilt from its classes, with one link a member."""
        a = self._algorithm(algorithm_id)
        h = reads.in_scope(self.hashes, project_id, algorithm_id)
        if a.comparison == EXACT:
            edges = exact.star_edges(h)
        else:
            edges = hamming.asset_edges(h, hamming.class_edges(h, a.bits or 64, self._threshold(project_id), Scratch(self.spark, "recompute")))
        return self.state.replace(project_id, algorithm_id, edges.withColumn("computed_at", F.current_timestamp()))

    def recompute_assets(self, project_id: str, algorithm_id: int, assets: DataFrame, n: int | None = None) -> int:
        """Rebuilds the edges of some assets (asset_id): their hashes are compared with all of the scope, and the
        other edges stay. More than INCREMENTAL assets, and exact scopes, whose classes cost one pass, are rebuilt
        as a whole."""
        a = self._algorithm(algorithm_id)
        ids = assets.select("asset_id").distinct()
        if a.comparison == EXACT or (ids.count() if n is None else n) > INCREMENTAL:
            return self.recompute(project_id, algorithm_id)
        h = reads.in_scope(self.hashes, project_id, algorithm_id)
        found = hamming.edges_of(h, ids, a.bits or 64, self._threshold(project_id)).withColumn("computed_at", F.current_timestamp())
        kept = mutations.delete_asset_edges(self.state.edges(project_id, algorithm_id), ids.select(F.lit(algorithm_id).alias("algorithm_id"), "asset_id"))
        return self.state.replace(project_id, algorithm_id, kept.unionByName(found.select(kept.columns)))

    def recompute_project(self, project_id: str, recipe: str | None = None) -> dict[str, int]:
        """Rebuilds all scopes of a project that have hashes, or one recipe's: the new generation of each."""
        self.catalogue.project(project_id)
        have = {r.algorithm_id for r in self.hashes.where(F.col("project_id") == project_id).select("algorithm_id").distinct().collect()}
        wanted = [a for a in self.catalogue.algorithms.values() if a.algorithm_id in have and a.comparison != COSINE and recipe in (None, a.recipe)]
        return {a.recipe: self.recompute(project_id, a.algorithm_id) for a in wanted}

    def delete_project(self, project_id: str) -> None:
        """Deletes a project with its clients, assets, hashes, edges and snapshots; one that isn't there is no error."""
        self.catalogue.delete_project(project_id)
        keep = lambda df: df.where(~F.coalesce(F.col("project_id") == project_id, F.lit(False)))
        self.save(keep(self.assets), keep(self.hashes))
        self.state.drop(project_id)

    def delete_asset(self, project_id: str, id_: str | None = None, path: str | None = None) -> None:
        """Deletes an asset with its hashes and edges; one that isn't there is no error."""
        scratch = Scratch(self.spark, "delete")
        gone = scratch.store(reads.identity_filter(self.assets.where(F.col("project_id") == project_id), id_, path).select("asset_id"))
        touched = [r.algorithm_id for r in self.hashes.join(gone, "asset_id", "left_semi").select("algorithm_id").distinct().collect()]
        none = self.state.edges(project_id, -1)
        assets, hashes, _ = mutations.delete_assets(gone, self.assets, self.hashes, none)
        self.save(assets, hashes)
        for algorithm in touched:
            if self._algorithm(algorithm).comparison == EXACT:  # the class may have hung on the deleted asset
                self.recompute(project_id, algorithm)
                continue
            ids = gone.select(F.lit(algorithm).alias("algorithm_id"), "asset_id")
            self.state.replace(project_id, algorithm, mutations.delete_asset_edges(self.state.edges(project_id, algorithm), ids))

    # --- reads

    def asset(self, project_id: str, id_: str | None = None, path: str | None = None):
        row = reads.identity_filter(self.assets.where(F.col("project_id") == project_id), id_, path).first()
        if row is None:
            raise NotFound("no such asset")
        return row

    def matches(self, project_id: str, recipe: str, id_: str | None = None, path: str | None = None, threshold: str | None = None, page: str | None = None, page_size: str | None = None):
        _, a, t, _ = self.scope(project_id, recipe, threshold)
        asset = self.asset(project_id, id_, path)
        edges = self._edges_of(project_id, a, self.spark.createDataFrame([(asset.asset_id,)], "asset_id string"))
        rows = reads.matches(edges, self.assets, asset.asset_id, t)
        return reads.paged(rows.select(scalars.identity("other_").alias("identity"), "distance", "similarity", "other_asset_id"), reads.match_order(), *parsing.page_of(page, page_size))

    def _edges_of(self, project_id: str, a: Algorithm, assets: DataFrame) -> DataFrame:
        """Directional edges from the given assets (asset_id); of exact recipes they come from the hashes."""
        if a.comparison != EXACT:
            return self.state.edges(project_id, a.algorithm_id)
        h = reads.in_scope(self.hashes, project_id, a.algorithm_id)
        return exact.matches_of(h, assets.select(F.lit(project_id).alias("project_id"), F.lit(a.algorithm_id).alias("algorithm_id"), "asset_id"))

    def ranking(self, project_id: str, recipe: str, threshold: str | None = None, match_limit: str | None = None, id_: str | None = None, path: str | None = None, page: str | None = None, page_size: str | None = None):
        _, a, t, _ = self.scope(project_id, recipe, threshold)
        limit = parsing.positive_int(match_limit, 2**31 - 1, "match_limit")
        if a.comparison == EXACT:
            counted = exact.match_counts(reads.in_scope(self.hashes, project_id, a.algorithm_id))
            ranked = counted.join(reads.named(self.assets.where(reads.search_filter(id_, path))), "asset_id")
        else:
            ranked = reads.ranking(self.state.edges(project_id, a.algorithm_id), self.assets, t, id_=id_, path_term=path)
        rows, info = reads.paged(ranked, reads.ranking_order(), *parsing.page_of(page, page_size))
        rows = Scratch(self.spark, "page").store(rows)
        return reads.with_matches(rows, self._edges_of(project_id, a, rows), self.assets, t, limit).orderBy(*reads.ranking_order()), info

    def clusters(self, project_id: str, recipe: str, threshold: str | None = None, generation: int | None = None, id_: str | None = None, path: str | None = None, page: str | None = None, page_size: str | None = None):
        """A page of (cluster_id, max_similarity, assets), its numbers, and the generation."""
        _, a, t, _ = self.scope(project_id, recipe, threshold)
        members, g = self.state.clusters(project_id, a.algorithm_id, t, generation)
        summary = members.groupBy("cluster_id").agg(F.max("max_similarity").alias("max_similarity"))
        if id_ is not None or path is not None:
            hits = reads.matching_clusters(members, self.assets, id_, path)
            summary = summary.join(hits.select("cluster_id"), "cluster_id", "left_semi")
        rows, info = reads.paged(summary, reads.cluster_order(), *parsing.page_of(page, page_size))
        of = members.join(rows, ["cluster_id", "max_similarity"]).join(reads.named(self.assets), "asset_id")
        one = F.struct("asset_id", scalars.identity().alias("identity"), F.col("avg_similarity").alias("avg_similarity_to_cluster"))
        lists = of.groupBy("cluster_id", "max_similarity").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x.dropFields("asset_id")).alias("assets"))
        return lists.orderBy(*reads.cluster_order()), info, g

    def hash_rows(self, project_id: str, recipe: str, id_: str | None = None, path: str | None = None) -> DataFrame:
        """The hash rows of an asset in one recipe, in sequence."""
        a = self.catalogue.algorithms.get(recipe)
        if a is None:
            raise NotFound(f"no algorithm for {recipe}")
        return reads.hashes_of(self.hashes, self.asset(project_id, id_, path).asset_id, a.algorithm_id)

    def healthy(self) -> dict[str, bool]:
        """Whether Spark runs a task and the registry's folder can be listed."""
        out = {}
        for name, probe in (("spark", lambda: self.spark.range(1).count() == 1), ("storage", lambda: self.store.folders("registry") is not None)):
            try:
                out[name] = bool(probe())
            except Exception:  # noqa: BLE001
                out[name] = False
        return out

    def recipes(self, project_id: str, id_: str | None = None, path: str | None = None) -> list[str]:
        asset = self.asset(project_id, id_, path)
        names = {a.algorithm_id: a.recipe for a in self.catalogue.algorithms.values()}
        rows = self.hashes.where(F.col("asset_id") == asset.asset_id).select("algorithm_id").distinct().collect()
        return sorted(names[r.algorithm_id] for r in rows)

    def stats(self, project_id: str, now: dt.datetime) -> dict:
        """Assets, assets and duplicates per configured recipe, and activity."""
        p = self.catalogue.project(project_id)
        mine = self.assets.where(F.col("project_id") == project_id)
        since = lambda days: F.count_if(F.col("created_at") >= F.lit(now - dt.timedelta(days=days)))
        act = mine.agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last"), since(7).alias("d7"), since(30).alias("d30")).first()
        counts = {r.algorithm_id: r.n for r in self.hashes.where(F.col("project_id") == project_id).select("algorithm_id", "asset_id").distinct().groupBy("algorithm_id").agg(F.count(F.lit(1)).alias("n")).collect()}
        per = []
        for recipe in p.recipes:
            a = self.catalogue.algorithms.get(recipe)
            n, s = (counts.get(a.algorithm_id, 0), None) if a else (0, {})
            zero = {"cluster_count": 0, "edge_count": 0, "assets_with_duplicate_count": 0}
            if a is None:
                s = zero
            elif a.comparison == EXACT:
                row = exact.stats(reads.in_scope(self.hashes, project_id, a.algorithm_id)).first()
                s = {k: row[k] for k in zero} if row else zero
            elif a.comparison == HAMMING:
                s = self.state.stats(project_id, a.algorithm_id, p.hamming_threshold if p.hamming_threshold is not None else self.default_threshold)
            degraded = s is None
            s = s or dict.fromkeys(zero)
            pct = None if degraded else (math.floor(s["assets_with_duplicate_count"] * 10000 / n + 0.5) / 100 if n else 0)
            per.append({"recipe": recipe, "asset_count": n, **s, "assets_with_duplicate_pct": pct, "degraded": degraded})
        return {"project": {"slug": p.slug, "name": p.name}, "total_assets": act.n, "duplicates_per_recipe": per, "last_asset_added_at": act.last, "assets_added_last_7d": act.d7, "assets_added_last_30d": act.d30}

