"""Queries over concepts: vector top-k, expansion to files and symbols, steering."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import concept_label, last_part
from ..functions.vectors import cosine
from . import enrich


def top_concepts(embeddings: DataFrame, query: list[float], k: int) -> DataFrame:
    """concept_id, score, place: the k most similar concepts, ties to the smaller id.

    One pass over the vectors; the limit is kept in each partition before the merge."""
    asked = F.lit([float(x) for x in query])
    scored = embeddings.select("concept_id", cosine(F.col("embedding"), asked).alias("score"))
    best = scored.orderBy(F.desc("score"), "concept_id").limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "concept_id")))


def expand(best: DataFrame, concepts: DataFrame, members: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """concept_id, rank, concept, role, score, files, why_relevant, sibling_implementations
    of ranked concepts, all concepts in one plan."""
    best = F.broadcast(best.select("concept_id", "score", "place"))  # at most k rows
    own = members.join(best.select("concept_id"), "concept_id").join(symbols, "symbol_id")
    name = F.coalesce("qualified_name", F.lit(""))
    item = F.struct("start_line", "symbol_id", F.when(name == "", "").otherwise(last_part(name)).alias("name"), name.alias("qualified_name"), "end_line")
    shown = lambda s: F.struct(s["name"].alias("name"), s["qualified_name"].alias("qualified_name"), s["start_line"].alias("start_line"), s["end_line"].alias("end_line"))
    by_file = own.groupBy("concept_id", "path").agg(F.transform(F.array_sort(F.collect_list(item)), shown).alias("symbols"))
    files = by_file.groupBy("concept_id").agg(F.array_sort(F.collect_list(F.struct("path", "symbols"))).alias("files"))
    siblings = sibling_implementations(own.select("concept_id", "symbol_id"), symbols, edges)
    listed = siblings.groupBy("concept_id").agg(F.array_sort(F.collect_list(F.struct("name", "file"))).alias("sibling_implementations"))
    out = best.join(concepts, "concept_id").join(files, "concept_id", "left").join(listed, "concept_id", "left")
    return out.select(
        "concept_id", F.col("place").alias("rank"), concept_label(F.col("name"), F.col("concept_id")).alias("concept"), "role", F.round("score", 4).alias("score"),
        F.coalesce("files", F.array().cast(files.schema["files"].dataType)).alias("files"), F.coalesce("description", F.lit("")).alias("why_relevant"),
        F.coalesce("sibling_implementations", F.array().cast("array<struct<name:string,file:string>>")).alias("sibling_implementations"),
    )


def sibling_implementations(members: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """concept_id, name, file: symbols that inherit from a member and are none themselves."""
    heirs = edges.filter(F.col("kind") == "inherit").join(members.withColumnRenamed("symbol_id", "dst_symbol_id"), "dst_symbol_id")
    heirs = heirs.select("concept_id", F.col("src_symbol_id").alias("symbol_id")).distinct().join(members, ["concept_id", "symbol_id"], "left_anti")
    return heirs.join(symbols.select("symbol_id", "name", F.col("path").alias("file")), "symbol_id").select("concept_id", "name", "file").distinct()


def merge_best(found: DataFrame) -> DataFrame:
    """concept_id, score, step: for each concept its best score over steps, the earlier step of equals."""
    best = F.max_by(F.struct("score", "step"), F.struct("score", -F.col("step"))).alias("b")
    return found.groupBy("concept_id").agg(best).select("concept_id", "b.score", "b.step")


class Searcher:
    """The index tables and an encoder, ready for questions."""

    def __init__(self, concepts: DataFrame, embeddings: DataFrame, members: DataFrame, symbols: DataFrame, edges: DataFrame, encoder: Callable[[list[str]], np.ndarray]):
        self.concepts, self.embeddings, self.members, self.symbols, self.edges, self.encoder = concepts, embeddings, members, symbols, edges, encoder

    def query(self, text: str, top_k: int = 5, backend: enrich.Backend | None = None, rerank: bool = False) -> list[dict]:
        """Ranked concepts as dictionaries; with ``rerank`` three times as many candidates are judged by the backend."""
        vector = np.asarray(self.encoder([text]))[0].tolist()
        judged = rerank and backend is not None
        best = top_concepts(self.embeddings, vector, top_k * 3 if judged else top_k)
        if judged:
            best = enrich.rerank(best.join(self.concepts.select("concept_id", "name", "description"), "concept_id"), text, backend).filter(F.col("place") <= top_k)
        rows = expand(best, self.concepts, self.members, self.symbols, self.edges).orderBy("rank").collect()
        return [r.asDict(recursive=True) for r in rows]

    def agentic_query(self, text: str, backend: enrich.Backend, top_k: int = 5, max_iterations: int = 3) -> list[dict]:
        """Several questions, merged: a concept keeps its best score, the earlier one of equals."""
        seen: dict[tuple[int, int], dict] = {}
        asked = text
        for step in range(1, max_iterations + 1):
            found = self.query(asked, top_k * 2)
            seen |= {(r["concept_id"], step): r for r in found}
            asked = enrich.next_question(text, found, backend, step)
            if asked is None:
                break
        rows = self.concepts.sparkSession.createDataFrame([(c, r["score"], s) for (c, s), r in seen.items()], "concept_id long, score double, step int")
        merged = [seen[r.concept_id, r.step] for r in merge_best(rows).orderBy("step").collect()]
        order = {key: i for i, key in enumerate(seen)}  # equal scores stay as they were first found
        ranked = sorted(merged, key=lambda r: (-r["score"], min(i for (c, _), i in order.items() if c == r["concept_id"])))[:top_k]
        return [r | {"rank": i} for i, r in enumerate(ranked, 1)]


def render(results: list[dict]) -> str:
    out = []
    for r in results:
        out.append(f"[{r['rank']}] {r['concept'] or ''} ({r['role'] or ''}) — {r['score']:.2f}")
        if r["why_relevant"]:
            out.append(f"    why: {r['why_relevant']}")
        for f in r["files"]:
            out.append(f"    {f['path']}")
            out += [f"      {s['qualified_name'] or s['name']}  :{s['start_line']}-{s['end_line']}" for s in f["symbols"]]
        out += [f"    sibling: {s['name']} ({s['file']})" for s in r["sibling_implementations"]]
        out.append("")
    return "\n".join(out)
