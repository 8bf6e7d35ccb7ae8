"""Enrichment by a language model behind a small protocol: docstrings, concept
labels, relevance scores and follow-up questions.  A heuristic backend ships, so
that everything runs without a model."""

from __future__ import annotations

import json
import re
import urllib.request
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import parsed_score, shown_name
from ..schema import ROLES
from .languages import skeleton

MAX_MEMBERS, DOC_CHARS, NAME_CHARS, DESCRIPTION_CHARS = 20, 120, 120, 500
LABEL_SCHEMA = json.dumps({"type": "object", "properties": {"name": {"type": "string"}, "description": {"type": "string"}, "role": {"enum": list(ROLES)}}, "required": ["name", "description", "role"]})
STEER_SCHEMA = json.dumps({"type": "object", "required": ["done"], "properties": {"next_query": {"type": "string"}, "done": {"type": "boolean"}}})

LABEL_TASK = (
    "You name groups of code symbols. Reply with one JSON object: name (two to five specific words), "
    "description (a sentence that a search for this code would match), role (" + ", ".join(ROLES) + ")."
)
DOC_TASK = "Document the symbol below in at most three sentences, naming concrete types and purposes; reply with the comment's text alone."
RANK_TASK = "How well does the concept answer the developer's question? Reply with a number from 0 to 1 and nothing else."
STEER_TASK = "Judge whether the concepts found answer the question. Reply with a JSON object: done (true or false) and, only where some side of the question has no concept yet, next_query (a search for that side)."


class Backend(Protocol):
    def chat(self, messages: list[dict], max_tokens: int = 256, schema: str | None = None) -> str: ...


class Heuristic:
    """Deterministic answers from the prompt's own words."""

    def chat(self, messages: list[dict], max_tokens: int = 256, schema: str | None = None) -> str:
        task, text = messages[0]["content"], messages[-1]["content"]
        words = [w for w in re.findall(r"[a-z]{3,}", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text).lower())]
        top = [w for w, _ in sorted(Counter(words).items(), key=lambda x: (-x[1], x[0]))[:4]]
        if task == LABEL_TASK:
            role = "interface" if "interface" in words else "entry_point" if "main" in words else "implementation"
            return json.dumps({"name": " ".join(top[:3]).title() or "Misc", "description": f"Code about {', '.join(top) or 'nothing named'}.", "role": role})
        if task == STEER_TASK:
            return json.dumps({"done": True})
        if task == RANK_TASK:
            head, _, tail = text.partition("\n")
            asked, held = set(re.findall(r"[a-z]{3,}", head.lower())), set(re.findall(r"[a-z]{3,}", tail.lower()))
            return f"{len(asked & held) / max(len(asked), 1):.3f}"
        return f"About {', '.join(top)}." if top else ""


class ChatEndpoint:
    """A server with the common chat-completions interface."""

    def __init__(self, url: str, model: str, timeout: float = 120.0):
        self.url, self.model, self.timeout = url.rstrip("/"), model, timeout

    def chat(self, messages: list[dict], max_tokens: int = 256, schema: str | None = None) -> str:
        body = {"model": self.model, "messages": messages, "max_tokens": max_tokens, "temperature": 0}
        if schema:
            body["response_format"] = {"type": "json_object"}
        request = urllib.request.Request(f"{self.url}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)["choices"][0]["message"]["content"]


class LocalModel:
    """A model that runs in the workers: ``load`` gives a function (messages, max_tokens, schema) -> text, once in each worker."""

    def __init__(self, load: Callable[[], Callable[[list[dict], int, str | None], str]]):
        self.load, self._model = load, None

    def __getstate__(self):
        return {"load": self.load, "_model": None}

    def chat(self, messages: list[dict], max_tokens: int = 256, schema: str | None = None) -> str:
        if self._model is None:
            self._model = self.load()
        return self._model(messages, max_tokens, schema)


def ask(df: DataFrame, task: str, prompt: str, backend: Backend, schema: str | None = None, max_tokens: int = 256) -> DataFrame:
    """df with the backend's reply to each prompt (null if it fails).  Calls run in the partitions' tasks: repartition sets how many at a time."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            out = []
            for p in prompts:
                try:
                    out.append(backend.chat([{"role": "system", "content": task}, {"role": "user", "content": p}], max_tokens=max_tokens, schema=schema))
                except Exception:  # noqa: BLE001 - a failed call leaves its row without a reply
                    out.append(None)
            yield pd.Series(out, index=prompts.index, dtype=object)

    udf = F.pandas_udf("string")(_annotated(run)).asNondeterministic()
    return df.withColumn("reply", udf(F.col(prompt)))


def _annotated(run):
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run(batches)

    call.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return call


def member_line(qualified: Column, name: Column, kind: Column, signature: Column, docstring: Column) -> Column:
    doc = F.regexp_replace(F.substring(docstring, 1, DOC_CHARS), "\n", " ")
    return F.concat(F.lit("- "), shown_name(qualified, name), F.lit(" ("), kind, F.lit("): "), F.coalesce(F.nullif(signature, F.lit("")), name), F.when(docstring != "", F.concat(F.lit(" — "), doc)).otherwise(""))


def nearest_members(members: DataFrame, symbols: DataFrame, most: int = MAX_MEMBERS) -> DataFrame:
    """The members closest to each concept's centroid, with place 1 to ``most``."""
    place = F.row_number().over(Window.partitionBy("concept_id").orderBy("distance_to_centroid", "symbol_id"))
    return members.withColumn("place", place).filter(F.col("place") <= most).join(symbols, "symbol_id")


def label_prompts(concepts: DataFrame, members: DataFrame, symbols: DataFrame) -> DataFrame:
    """concept_id, prompt of the concepts without a name."""
    wanted = members.join(concepts.filter(F.col("name").isNull()).select("concept_id"), "concept_id", "left_semi")
    rows = nearest_members(wanted, symbols.select("symbol_id", "qualified_name", "name", "kind", "signature", "docstring"))
    line = member_line(*[F.col(c) for c in ("qualified_name", "name", "kind", "signature", "docstring")])
    listed = rows.groupBy("concept_id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("ls"))
    return listed.select("concept_id", F.concat(F.lit("Symbols:\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("prompt"))


def parse_labels(replies: DataFrame) -> DataFrame:
    """concept_id, name, description, role; all null where the reply is no JSON object, role null outside its domain."""
    parsed = replies.withColumn("j", F.from_json("reply", "name string, description string, role string", {"mode": "PERMISSIVE"}))
    valid = F.trim(F.coalesce("reply", F.lit(""))).rlike(r"(?s)^\{.*\}$") & (F.get_json_object("reply", "$").isNotNull())
    return parsed.select(
        "concept_id", F.when(valid, F.substring(F.coalesce("j.name", F.lit("")), 1, NAME_CHARS)).alias("name"),
        F.when(valid, F.substring(F.coalesce("j.description", F.lit("")), 1, DESCRIPTION_CHARS)).alias("description"),
        F.when(valid & F.col("j.role").isin(list(ROLES)), F.col("j.role")).alias("role"),
    )


def label_concepts(concepts: DataFrame, members: DataFrame, symbols: DataFrame, backend: Backend, workers: int = 1, chosen: Column | None = None) -> DataFrame:
    """concepts with labels where they had none (of ``chosen`` ones); malformed replies leave null."""
    prompts = label_prompts(concepts if chosen is None else concepts.filter(chosen), members, symbols).repartition(max(workers, 1))
    new = parse_labels(ask(prompts, LABEL_TASK, "prompt", backend, LABEL_SCHEMA)).select("concept_id", *[F.col(c).alias(f"new_{c}") for c in ("name", "description", "role")])
    out = concepts.join(new, "concept_id", "left")
    fresh = F.col("name").isNull()
    return out.select(*[F.when(fresh, F.coalesce(f"new_{c}", c)).otherwise(F.col(c)).alias(c) if c in ("name", "description", "role") else c for c in concepts.columns])


def docstring_prompts(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """symbol_id, prompt of the symbols without a docstring: their lines of source, classes without method bodies."""

    @F.pandas_udf("string")
    def bare(language: pd.Series, source: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([skeleton(a, s or "", k) for a, s, k in zip(language, source, kind, strict=True)])

    rows = symbols.filter(F.col("docstring").isNull()).join(files.select("path", "content"), "path")
    lines = F.split(F.decode("content", "UTF-8"), r"\r\n|\r|\n", -1)
    part = F.array_join(F.slice(lines, F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "\n")
    head = F.concat(F.col("kind"), F.lit(": "), shown_name(F.col("qualified_name"), F.col("name")), F.lit("\n\n"))
    return rows.select("symbol_id", F.concat(head, bare("language", part, "kind")).alias("prompt"))


def write_docstrings(symbols: DataFrame, files: DataFrame, backend: Backend | None, workers: int = 1) -> DataFrame:
    """symbols with written docstrings where there were none; hashes stay, so embeddings do too."""
    if backend is None:
        return symbols
    replies = ask(docstring_prompts(symbols, files).repartition(max(workers, 1)), DOC_TASK, "prompt", backend)
    new = replies.select("symbol_id", F.nullif(F.substring(F.trim("reply"), 1, DESCRIPTION_CHARS), F.lit("")).alias("written"))
    return symbols.join(new, "symbol_id", "left").withColumn("docstring", F.coalesce("docstring", "written")).select(*symbols.columns)


def rerank(candidates: DataFrame, question: str, backend: Backend) -> DataFrame:
    """candidates (concept_id, score, place, name, description) with score from the
    backend, the old score where a reply is no number; equal scores keep their order."""
    prompt = F.concat(F.lit(f"Question: {question}\nConcept: "), F.coalesce("name", F.lit("")), F.lit(": "), F.coalesce("description", F.lit("")))
    scored = ask(candidates.withColumn("prompt", prompt), RANK_TASK, "prompt", backend, max_tokens=8)
    scored = scored.withColumn("score", parsed_score(F.col("reply"), F.col("score"))).drop("prompt", "reply")
    return scored.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "place")))


def next_question(question: str, results: list[dict], backend: Backend, step: int) -> str | None:
    """A follow-up question, or None to stop (also on any malformed reply)."""
    found = "\n".join(f"- {r['concept']} ({r['role']}): {r['why_relevant']}" for r in results)
    try:
        reply = json.loads(backend.chat([{"role": "system", "content": STEER_TASK}, {"role": "user", "content": f"Question: {question}\n\nFound in step {step}:\n{found}"}], schema=STEER_SCHEMA))
        return None if reply.get("done") else reply.get("next_query") or None
    except Exception:  # noqa: BLE001
        return None
