"""Building and refreshing the index: stages with an input hash and a status."""

from __future__ import annotations

import hashlib
import json
import time
from contextlib import nullcontext
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import schema, telemetry
from ..functions.text import set_digest, symbol_text
from ..functions.vectors import HashedTrigrams, encode
from ..operators import cluster, diff, edges, enrich, extract
from ..operators.search import Searcher
from ..sources import repo, scip
from ..sources.store import TableStore

#: Groups in order; the stages of a group do not depend on each other.
PLAN = (("parse",), ("index", "docgen"), ("embed",), ("cluster",), ("label",), ("embed_concepts",))


@dataclass
class Options:
    repo: str = ""
    exclude_paths: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    encoder: object = field(default_factory=HashedTrigrams)
    backend: enrich.Backend | None = None
    docgen: bool = False
    workers: int = 1
    scip: dict[str, str] = field(default_factory=dict)  # language -> index file
    target_size: int = cluster.TARGET_SIZE
    noise_strategy: str = "singleton"  # stored with the concepts; every symbol belongs to a cluster
    grouped_imports: bool = False  # Go imports in parentheses give edges too
    label_batch: int = 200  # concepts labelled between two commits


class Index:
    """An index in a table store."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, TableStore(spark, root)

    # stages

    def parse(self, o: Options) -> dict:
        store = self.store
        scanned = repo.scan_repo(self.spark, o.repo, o.exclude_paths, o.exclude_patterns)
        old_files, old_symbols = store.read("files"), store.read("symbols")
        stay = diff.still_there(old_files, scanned, repo.list_repo(self.spark, o.repo, o.exclude_paths, o.exclude_patterns))
        now = scanned.select(*old_files.columns).unionByName(stay)
        changes = diff.file_changes(old_files, now)
        counts = {r.action: r["count"] for r in changes.groupBy("action").count().collect()}
        processed = counts.get(diff.INSERT, 0) + counts.get(diff.REPLACE, 0)
        if processed or counts.get(diff.DELETE, 0):
            renewed = scanned.join(changes.filter(F.col("action").isin(diff.INSERT, diff.REPLACE)).select("path"), "path", "left_semi")
            symbols = store.write("symbols", diff.merge_symbols(old_symbols, extract.extract_symbols(renewed), changes))
            store.write("files", now)
            for table, key in (("symbol_embeddings", "symbol_id"), ("concept_members", "symbol_id")):
                store.write(table, diff.surviving(store.read(table), key, symbols))
            store.write("references", diff.surviving_edges(store.read("references"), symbols))
        return {"processed": processed, "unchanged": counts.get(diff.KEEP, 0), "deleted": counts.get(diff.DELETE, 0)}

    def index(self, o: Options) -> dict:
        symbols = self.store.read("symbols")
        if symbols.isEmpty():
            raise RuntimeError("nothing to index: run parse first")
        files = repo.scan_repo(self.spark, o.repo, o.exclude_paths, o.exclude_patterns) if o.repo else None
        imports = extract.extract_imports(files, o.grouped_imports) if files is not None else None
        indexes = {}
        for lang, path in o.scip.items():
            if o.repo and not repo.has_build_file(self.spark, o.repo, lang):
                telemetry.warning("no build file: imports are used, not the index", language=lang)
            else:
                indexes[lang] = scip.read_occurrences(self.spark, path)
        return {"edges": self.store.write("references", edges.resolve(symbols, imports, indexes)).count()}

    def docgen(self, o: Options) -> dict:
        if o.backend is None or not o.repo:
            return {"written": 0}
        symbols, files = self.store.read("symbols"), repo.scan_repo(self.spark, o.repo, o.exclude_paths, o.exclude_patterns)
        before = symbols.filter("docstring is null").count()
        return {"written": before - self.store.write("symbols", enrich.write_docstrings(symbols, files, o.backend, o.workers)).filter("docstring is null").count()}

    def embed(self, o: Options) -> dict:
        symbols, old = self.store.read("symbols"), self.store.read("symbol_embeddings")
        kept = diff.reusable_embeddings(old, symbols, o.encoder.name)
        new = diff.to_embed(symbols, kept)
        text = symbol_text(F.col("qualified_name"), F.col("name"), F.col("signature"), F.col("docstring"))
        fresh = encode(new.withColumn("text", text), "text", o.encoder).select("symbol_id", "content_hash", F.lit(o.encoder.name).alias("model"), "embedding")
        table = self.store.write("symbol_embeddings", kept.unionByName(fresh))
        self.store.put_config({"embed_model": o.encoder.name})
        return {"embedded": table.count()}

    def cluster(self, o: Options) -> dict:
        symbols, embeddings, old = self.store.read("symbols"), self.store.read("symbol_embeddings"), self.store.read("concepts")
        if embeddings.isEmpty():
            raise RuntimeError("nothing to cluster: run embed first")
        embedded = embeddings.join(symbols.select("symbol_id", "path"), "symbol_id").select("symbol_id", "path", "embedding")
        had = not old.isEmpty()
        labels = cluster.assign(embedded, old if had else None, o.target_size)
        concepts, members = cluster.build_concepts(labels, embedded, symbols, old if had else None)
        fresh = self.store.write("_members", members)
        concepts = self.store.write("concepts", concepts)
        self.store.write("concept_members", fresh)
        self.store.write("concept_embeddings", self.spark.createDataFrame([], schema.CONCEPT_EMBEDDINGS))
        self.store.put_config({"cluster_target_size": o.target_size, "cluster_min_size": o.target_size, "noise_strategy": o.noise_strategy})
        return concepts.agg(*cluster.counters()).first().asDict()

    def label(self, o: Options) -> dict:
        if o.backend is None:
            raise ValueError("labels need a backend")
        """In batches, each committed on its own: a failure costs the replies of one batch."""
        read = self.store.read
        steps = -(-read("concepts").filter("name is null").count() // o.label_batch)
        for i in range(steps):
            chosen = F.pmod(F.xxhash64("concept_id", F.lit(3)), F.lit(steps)) == i
            self.store.write("concepts", enrich.label_concepts(read("concepts"), read("concept_members"), read("symbols"), o.backend, o.workers, chosen))
        return {"unlabeled": read("concepts").filter("name is null").count()}

    def embed_concepts(self, o: Options) -> dict:
        concepts, old = self.store.read("concepts"), self.store.read("concept_embeddings")
        kept = diff.surviving(old, "concept_id", concepts, "concept_id")
        new = concepts.filter(F.col("description").isNotNull()).join(kept.select("concept_id"), "concept_id", "left_anti")
        fresh = encode(new, "description", o.encoder).select("concept_id", "embedding")
        return {"embedded": self.store.write("concept_embeddings", kept.unionByName(fresh)).count()}

    # orchestration

    def input_hash(self, o: Options) -> str:
        """Of the files' contents, which are summed up where they lie, and the parameters."""
        files = self.store.read("files").agg(set_digest(F.col("content_hash"))).first()[0]
        params = {"exclude_paths": sorted(o.exclude_paths), "exclude_regex": sorted(o.exclude_patterns)}
        return hashlib.sha256(json.dumps({"files": files, "params": params}, sort_keys=True).encode()).hexdigest()

    def _mark(self, stage: str, status: str, input_hash: str, params: dict) -> None:
        old = self.store.read("pipeline_runs").filter(F.col("stage") != stage)
        row = [(stage, status, int(time.time()) if status in ("done", "failed") else None, input_hash, json.dumps(params, default=str))]
        self.store.write("pipeline_runs", old.unionByName(self.spark.createDataFrame(row, schema.PIPELINE_RUNS)).coalesce(1))

    def run_stage(self, stage: str, o: Options, input_hash: str | None = None) -> str:
        """Runs a stage unless it is done for the same inputs; parse always runs."""
        key = input_hash or self.input_hash(o)
        done = self.store.read("pipeline_runs").filter((F.col("stage") == stage) & (F.col("status") == "done") & (F.col("input_hash") == key))
        if stage != "parse" and not done.isEmpty():
            telemetry.info("stage cached", stage=stage)
            return "cached"
        self._mark(stage, "running", key, {})
        try:
            with nullcontext() if stage == "label" else self.store.transaction():
                result = getattr(self, stage)(o)
        except ImportError as e:
            self._mark(stage, "skipped", key, {"reason": str(e)})
            return "skipped"
        except Exception:
            self._mark(stage, "failed", key, {})
            raise
        self._mark(stage, "done", self.input_hash(o) if stage == "parse" else key, result)
        telemetry.info("stage done", stage=stage, **result)
        return "done"

    def run(self, o: Options, stages: list[str] | None = None, force: bool = False) -> dict[str, str]:
        """All stages of the plan (docgen only on request; label only with a backend), group by group."""
        if force:
            self.store.write("pipeline_runs", self.spark.createDataFrame([], schema.PIPELINE_RUNS))
        out: dict[str, str] = {}
        for group in PLAN:
            wanted = [s for s in group if (s in stages if stages else (s != "docgen" or o.docgen) and (s != "label" or o.backend is not None))]
            key = self.input_hash(o)
            for stage in wanted:
                out[stage] = self.run_stage(stage, o, key)
        return out

    def searcher(self, encoder=None) -> Searcher:
        r = self.store.read
        return Searcher(r("concepts"), r("concept_embeddings"), r("concept_members"), r("symbols"), r("references"), encoder or HashedTrigrams())
