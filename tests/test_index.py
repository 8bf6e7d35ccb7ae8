"""A small tree through the whole index: build, refresh, edges, clusters, labels, questions."""

import json
import shutil
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from stratalens import cli, schema
from stratalens.functions.vectors import HashedTrigrams
from stratalens.operators import cluster, diff, edges, enrich, evaluate, inspection
from stratalens.plans.pipeline import Index, Options
from stratalens.sources import fixtures, repo, scip
from stratalens.sources.store import TableStore
from stratalens.streaming import ingest

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILES = {
    "zoo/animals.py": 'class Animal:\n    """Base of all animals."""\n    def speak(self): pass\n\nclass Plant: pass\n',
    "zoo/dogs.py": "from zoo.animals import Animal\nimport zoo.animals\n\nclass Dog(Animal):\n    def speak(self): return 'w'\n\nclass Puppy(Dog): pass\n",
    "auth/auth.go": "package auth\n\nfunc Validate(token string) bool { return token != \"\" }\n",
    "api/api.go": "package api\n\nimport \"example.com/proj/auth\"\n\nfunc Handle(token string) bool { return auth.Validate(token) }\n",
    "java/Base.java": "package org.a;\npublic class Base implements Speaker {}\ninterface Speaker {}\n",
    "java/Sub.java": "package org.b;\nimport org.a.Base;\nclass Sub extends Base {}\n",
    "generated/x_pb2.py": "class Gen: pass\n",
    ".hidden/y.py": "class Hidden: pass\n",
    "node_modules/z.py": "class Dep: pass\n",
    "notes.txt": "not code",
}


def plant(root):
    for path, text in FILES.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return root


@pytest.fixture()
def tree(tmp_path):
    return plant(tmp_path / "src")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """Built once; the tests run in order, and the last one changes it."""
    tmp_path = tmp_path_factory.mktemp("index")
    index = Index(spark, str(tmp_path / "db"))
    options = Options(str(plant(tmp_path / "src")), exclude_paths=("generated/",), backend=enrich.Heuristic())
    index.run(options)
    return index, options, tmp_path / "src"


def qualified(df):
    return {r.qualified_name for r in df.select("qualified_name").collect()}


def edge_names(index):
    s = index.store.read("symbols").select("symbol_id", "qualified_name")
    e = index.store.read("references").join(s.toDF("src_symbol_id", "a"), "src_symbol_id").join(s.toDF("dst_symbol_id", "b"), "dst_symbol_id")
    return {(r.a, r.b, r.kind) for r in e.collect()}


def test_build(built):
    index, options, _ = built
    assert qualified(index.store.read("symbols")) >= {"zoo.animals.Animal", "zoo.animals.Animal.speak", "zoo.dogs.Puppy", "auth.Validate", "org.b.Sub"}
    assert {r.path for r in index.store.read("files").collect()} == {p for p in FILES if p.split("/")[0] in ("zoo", "auth", "api", "java")}
    assert edge_names(index) == {
        ("zoo.dogs.Dog", "zoo.animals.Animal", "inherit"), ("zoo.dogs.Puppy", "zoo.dogs.Dog", "inherit"), ("zoo.dogs.Dog", "zoo.animals.Animal", "import"),
        ("api.Handle", "auth.Validate", "import"), ("org.b.Sub", "org.a.Base", "inherit"), ("org.b.Sub", "org.a.Base", "import"), ("org.a.Base", "org.a.Speaker", "inherit"),
    }
    concepts, members = index.store.read("concepts"), index.store.read("concept_members")
    assert {r.package for r in concepts.collect()} == {"zoo", "auth", "api", "java"}
    assert members.count() == index.store.read("symbols").count() == members.select("symbol_id").distinct().count()
    assert concepts.filter("name is null or description is null").isEmpty()
    assert index.store.read("concept_embeddings").count() == concepts.count()
    assert index.store.config()["embed_model"] == HashedTrigrams().name
    again = index.run(options)
    assert {k for k, v in again.items() if v == "cached"} == set(again) - {"parse"}


def test_symbol_changes(spark):
    row = lambda i, name, h, line: (i, "a.py", name, f"def {name}()", 1, h, line, line)
    kinds = "symbol_id long, path string, qualified_name string, signature string, ordinal int, content_hash string, start_line int, end_line int"
    old = spark.createDataFrame([row(1, "a", "x", 1), row(2, "b", "x", 2), row(3, "c", "x", 3), row(4, "d", "x", 4)], kinds)
    new = spark.createDataFrame([row(1, "a", "x", 1), row(2, "b", "x", 9), row(3, "c", "y", 3), row(5, "e", "x", 5)], kinds)
    assert {r.symbol_id: r.action for r in diff.symbol_changes(old, new).collect()} == {1: "KEEP", 2: "MOVE", 3: "REPLACE", 4: "DELETE", 5: "INSERT"}


def test_query_inspect_eval(spark, built, tmp_path, capsys):
    index, _, _ = built
    s = index.searcher()
    found = s.query("animals that speak", top_k=3)
    assert [r["rank"] for r in found] == [1, 2, 3]
    zoo = next(r for r in s.query("zoo", top_k=9) if any(f["path"] == "zoo/animals.py" for f in r["files"]))
    assert [x["qualified_name"] for f in zoo["files"] for x in f["symbols"]][:2] == ["zoo.animals.Animal", "zoo.animals.Animal.speak"]
    assert len(s.query("animals", top_k=2, backend=enrich.Heuristic(), rerank=True)) == 2
    assert [r["rank"] for r in s.agentic_query("animals", enrich.Heuristic(), top_k=2)] == [1, 2]
    r = index.store.read
    seen = inspection.inspect_symbols(["zoo.animals.Animal", "nope"], r("symbols"), r("references"), r("concepts"), r("concept_members")).collect()
    assert len(seen) == 1 and [(c.symbol, c.line) for c in seen[0].callers] == [("zoo.dogs.Dog", 4), ("zoo.dogs.Dog", 4)]
    assert seen[0].docstring == "Base of all animals." and "zoo.dogs.Puppy" in [x.qualified_name for x in seen[0].concept_siblings]
    assert [c.qualified_name for c in inspection.find_candidates("ANIMAL.", r("symbols")).collect()] == ["zoo.animals.Animal.speak"]
    for name, want in (("one", {"files": ["zoo/animals.py"], "symbols": ["zoo.animals.Animal"]}), ("two", {}), ("bad", None)):
        d = tmp_path / "fx" / name
        d.mkdir(parents=True)
        (d / "input.txt").write_text("animals\n")
        (d / "expected.json").write_text(json.dumps(want) if want is not None else "{not json")
    per, mean = evaluate.run(s, fixtures.read_fixtures(spark, str(tmp_path / "fx")), [1, 9])
    assert {x.fixture for x in per.collect()} == {"one", "two"}
    assert {x.k: x.symbol_recall for x in mean.collect()}[9] == 1.0
    db = str(index.store.root)
    assert cli.main(["query", "animals", "--db", db, "--format", "json", "--top-k", "1"], spark) == 0
    assert json.loads(capsys.readouterr().out)[0]["rank"] == 1
    assert cli.main(["inspect", "Animal", "--db", db], spark) == 1 and "did you mean" in capsys.readouterr().err
    assert cli.main(["query", "x", "--db", db, "--rerank"], spark) == 2


class Replies:
    def __init__(self, reply):
        self.reply = reply

    def chat(self, messages, max_tokens=256, schema=None):
        if self.reply is None:
            raise OSError("down")
        return self.reply


@pytest.mark.parametrize(
    "reply, want",
    [
        ('{"name": "Auth", "description": "Checks.", "role": "interface"}', ("Auth", "Checks.", "interface")),
        ('{"name": "Auth", "description": "Checks.", "role": "wizard"}', ("Auth", "Checks.", None)),
        ("not json at all", (None, None, None)),
        ("[1]", (None, None, None)),
        (None, (None, None, None)),
    ],
)
def test_labels(spark, reply, want):
    concepts = spark.createDataFrame([(1, "p", None, None, None, [0.0], 1, "h"), (2, "p", "Kept", "d", None, [0.0], 1, "i")], schema.CONCEPTS)
    members = spark.createDataFrame([(1, 7, 0.1), (2, 8, 0.1)], schema.CONCEPT_MEMBERS)
    symbols = spark.createDataFrame([(7, "q.f", "f", "function", "def f()", "Doc."), (8, "q.g", "g", "function", None, None)], "symbol_id long, qualified_name string, name string, kind string, signature string, docstring string")
    out = {r.concept_id: r for r in enrich.label_concepts(concepts, members, symbols, Replies(reply)).collect()}
    assert (out[1].name, out[1].description, out[1].role) == want and out[2].name == "Kept"


def test_kmeans_partition_and_warm_start():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.05, (20, 4)) for c in (0, 3, 6)])
    labels = cluster.kmeans(x, 3)
    assert sorted(np.bincount(labels)) == [20, 20, 20]
    start = np.stack([x[labels == k].mean(0) for k in range(3)])
    assert (cluster.kmeans(x, 3, start) == labels).all()


def test_clusters_of_large_package(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"pkg/{i % 3}.py", [float(v) for v in rng.normal(size=8)]) for i in range(50)]
    df = spark.createDataFrame(rows, "symbol_id long, path string, embedding array<float>")
    labels = cluster.assign(df)
    assert labels.count() == 50 and labels.select("label").distinct().count() == 2  # 50 / 20, halves to even
    hashes = df.select("symbol_id", F.lit("h").alias("content_hash"))
    concepts, members = cluster.build_concepts(labels, df, hashes)
    again = cluster.assign(df, concepts)
    assert again.count() == 50 and members.filter("distance_to_centroid < 0").isEmpty()
    assert cluster.round_robin(df).groupBy("label").count().count() == 2


def reference_scan(symbols, line):
    """Nearest start first, going back; stops at the first symbol that doesn't reach the line."""
    best = None
    for s in sorted((x for x in symbols if x[0] <= line), reverse=True):
        if s[1] < line:
            break
        if best is None or s[0] > best[0]:
            best = s
    return best[2] if best else None


def test_enclosing_symbol_matches_scan(spark):
    rng = np.random.default_rng(2)
    symbols, probes, want = [], [], {}
    for f in range(30):
        own = [(int(a), int(a + rng.integers(0, 30)), f * 100 + i) for i, a in enumerate(rng.integers(1, 60, 12))]
        symbols += [(f"f{f}", *s) for s in own]
        for line in range(0, 95, 3):
            probes.append((f"f{f}", line, f * 1000 + line))
            want[f * 1000 + line] = reference_scan(own, line)
    s = spark.createDataFrame(symbols, "path string, start_line int, end_line int, symbol_id long")
    p = spark.createDataFrame(probes, "path string, line int, n long")
    assert {r.n: r.src for r in edges.enclosing_symbols(s, p).collect()} == want


def _field(number, wire, value):
    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    return varint(number << 3 | wire) + (varint(value) if wire == 0 else varint(len(value)) + value)


def test_scip(spark, built, tmp_path):
    index, _, _ = built
    occ = lambda rng, sym, role: _field(2, 2, _field(1, 2, bytes(rng)) + _field(2, 2, sym.encode()) + _field(3, 0, role))
    sym = "scip-go go example.com/proj v1 auth/Validate()."
    doc = _field(1, 2, b"api/api.go") + occ([4, 0, 3], sym, 0) + occ([4, 0, 3], sym, 2) + occ([4, 0, 3], sym, 1) + occ([4], "local 3", 0) + occ([0, 0, 1], sym, 0)
    (tmp_path / "i.scip").write_bytes(_field(1, 2, b"x") + _field(2, 2, doc))
    (tmp_path / "bad.scip").write_bytes(b"\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff")
    found = scip.read_occurrences(spark, str(tmp_path / "*.scip"))
    assert found.count() == 5
    rows = edges.resolve(index.store.read("symbols"), None, {"go": found}).filter("kind in ('call', 'import')").collect()
    assert sorted(r.kind for r in rows) == ["call", "import"]


def test_excludes(spark, tree):
    paths = lambda **k: {r.path for r in repo.scan_repo(spark, str(tree), **k).select("path").collect()}
    assert "generated/x_pb2.py" in paths() and ".hidden/y.py" not in paths() and "node_modules/z.py" not in paths()
    assert "generated/x_pb2.py" not in paths(exclude_patterns=(r".*_pb2\.py$",))
    assert "generated/x_pb2.py" not in paths(exclude_paths=("generated",))


def test_streaming_ingest(spark, tree, tmp_path):
    store = TableStore(spark, str(tmp_path / "db2"))
    ingest.start(spark, str(tree), store, str(tmp_path / "cp"), once=True).awaitTermination()
    assert "zoo.dogs.Puppy" in qualified(store.read("symbols"))
    (tree / "zoo/cats.py").write_text("class Cat: pass\n")
    ingest.start(spark, str(tree), store, str(tmp_path / "cp"), once=True).awaitTermination()
    assert {"zoo.cats.Cat", "zoo.dogs.Puppy"} <= qualified(store.read("symbols"))


def test_domain_check(spark, tmp_path):
    bad = spark.createDataFrame([(1, 2, "loves")], schema.REFERENCES)
    with pytest.raises(Exception, match="references.kind"):
        schema.checked(bad, "references").collect()
    shutil.rmtree(tmp_path, ignore_errors=True)


def test_refresh_keeps_what_did_not_change(built):
    index, options, tree = built
    before = {r.qualified_name: (r.symbol_id, r.start_line) for r in index.store.read("symbols").collect()}
    named = {r.member_hash: r.name for r in index.store.read("concepts").collect()}
    (tree / "zoo/dogs.py").write_text("# moved\n" + FILES["zoo/dogs.py"].replace("class Puppy(Dog): pass", "class Puppy(Dog):\n    'New.'"))
    (tree / "auth/auth.go").unlink()
    result = index.parse(options)
    assert result == {"processed": 1, "unchanged": 4, "deleted": 1}
    after = {r.qualified_name: (r.symbol_id, r.start_line) for r in index.store.read("symbols").collect()}
    assert "auth.Validate" not in after and after["zoo.dogs.Dog"] == (before["zoo.dogs.Dog"][0], before["zoo.dogs.Dog"][1] + 1)
    left = index.store.read("symbol_embeddings")
    reusable = diff.reusable_embeddings(left, index.store.read("symbols"), HashedTrigrams().name)
    ids = {r.symbol_id for r in reusable.collect()}
    assert before["zoo.dogs.Dog"][0] in ids and before["zoo.dogs.Puppy"][0] not in ids and before["auth.Validate"][0] not in ids
    for stage in ("index", "embed", "cluster"):
        index.run_stage(stage, options)
    for r in index.store.read("concepts").filter("package in ('api', 'java')").collect():
        assert r.name == named[r.member_hash]


def test_docgen_keeps_hash(spark, built):
    index, options, _ = built
    before = {r.symbol_id: r.content_hash for r in index.store.read("symbols").collect()}
    assert index.docgen(options)["written"] > 0
    rows = index.store.read("symbols").collect()
    assert {r.symbol_id: r.content_hash for r in rows} == before and all(r.docstring for r in rows)
    index.parse(options)
    assert all(r.docstring for r in index.store.read("symbols").collect())
