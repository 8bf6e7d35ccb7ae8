"""Storage, refreshes, clustering of large packages, and lookups in long files, against plain versions."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from stratalens import schema
from stratalens.functions import text, vectors
from stratalens.operators import cluster, diff, edges, enrich
from stratalens.operators.languages import imported_names
from stratalens.plans.pipeline import Index, Options
from stratalens.sources import repo
from stratalens.sources.store import TableStore
from stratalens.streaming import ingest


def run_rows(spark, *stages):
    return spark.createDataFrame([(s, "done", 1, "h", "{}") for s in stages], schema.PIPELINE_RUNS)


def test_store_commits_together_or_not_at_all(spark, tmp_path):
    store, other = TableStore(spark, str(tmp_path / "db")), TableStore(spark, str(tmp_path / "db"))
    stages = lambda s: sorted(r.stage for r in s.read("pipeline_runs").collect())
    store.write("pipeline_runs", run_rows(spark, "parse"))
    with store.transaction():
        store.write("pipeline_runs", run_rows(spark, "embed"))
        store.put_config({"a": 1})
        assert stages(store) == ["embed"] and stages(other) == ["parse"] and other.config() == {}
    assert stages(other) == ["embed"] and other.config() == {"a": 1}
    reader = other.read("pipeline_runs")
    with pytest.raises(ZeroDivisionError), store.transaction():
        store.write("pipeline_runs", run_rows(spark, "label"))
        1 / 0
    assert stages(store) == ["embed"] and [r.stage for r in reader.collect()] == ["embed"]
    store.write("pipeline_runs", store.read("pipeline_runs").unionByName(run_rows(spark, "index")))
    assert stages(store) == ["embed", "index"]
    for i in range(4):
        store.write("pipeline_runs", run_rows(spark, f"s{i}"))
    left = [n for n in os.listdir(tmp_path / "db") if n.startswith("pipeline_runs-")]
    assert len(left) == 2 and stages(store) == ["s3"]  # the current version and the one before


def tree(path, **files):
    for name, body in files.items():
        (path / name.replace("__", "/")).parent.mkdir(parents=True, exist_ok=True)
        (path / f"{name.replace('__', '/')}.py").write_text(body)
    return path


def test_a_file_that_cannot_be_read_keeps_its_rows(spark, tmp_path, monkeypatch):
    root = tree(tmp_path / "src", a="def f():\n    pass\n", b="def g():\n    pass\n")
    index = Index(spark, str(tmp_path / "db"))
    assert index.parse(Options(str(root)))["processed"] == 2
    whole = repo.scan_repo
    monkeypatch.setattr(repo, "scan_repo", lambda *a, **k: whole(*a, **k).filter("path <> 'a.py'"))
    assert index.parse(Options(str(root))) == {"processed": 0, "unchanged": 2, "deleted": 0}
    (root / "b.py").unlink()
    assert index.parse(Options(str(root)))["deleted"] == 1
    assert {r.name for r in index.store.read("symbols").collect()} == {"f"}


def test_batches_write_what_they_hold(spark, tmp_path, monkeypatch):
    store = TableStore(spark, str(tmp_path / "db"))
    batch = lambda *rows: spark.createDataFrame([(p, t.encode(), len(t), n) for p, t, n in rows], "path string, content binary, size_bytes long, modified int")
    names = lambda: sorted((r.path, r.name) for r in store.read("symbols").collect())
    one = "def f{}():\n    pass\n"
    ingest.upsert(store, batch(*[(f"m{i}.py", one.format(i), 1) for i in range(6)]))
    first = store._tables()["symbols"]
    ingest.upsert(store, batch(("m1.py", one.format(9), 2), ("m1.py", one.format(8), 1), ("m9.py", one.format(7), 1)))
    assert store._tables()["symbols"][0] == first[0] and len(store._tables()["symbols"]) == 2
    want = [(f"m{i}.py", f"f{9 if i == 1 else i}") for i in range(6)] + [("m9.py", "f7")]
    assert names() == want and store.read("files").count() == 7
    ingest.upsert(store, batch(("m1.py", one.format(9), 3)))
    assert len(store._tables()["symbols"]) == 2  # nothing new
    ingest.upsert(store, batch(("m1.py", "x = 1\n", 4)))
    assert names() == [w for w in want if w[0] != "m1.py"] and {r.path for r in store.read("files").collect()} >= {"m1.py"}
    monkeypatch.setattr("stratalens.sources.store.MOST_CHANGES", 2)
    ingest.upsert(store, batch(("m2.py", one.format(5), 5)))
    assert len(store._tables()["symbols"]) == 1 and ("m2.py", "f5") in names() and len(names()) == 6


def test_labels_are_committed_batch_by_batch(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "db"))
    ids = range(12)
    store.write("concepts", spark.createDataFrame([(i, "p", None, None, None, [0.0], 1, str(i)) for i in ids], schema.CONCEPTS))
    store.write("concept_members", spark.createDataFrame([(i, i, 0.1) for i in ids], schema.CONCEPT_MEMBERS))
    symbols = [(i, 1, "a.py", "python", f"f{i}", f"a.f{i}", "function", f"def f{i}()", 1, 2, None, 1, str(i)) for i in ids]
    store.write("symbols", spark.createDataFrame(symbols, schema.SYMBOLS))
    index = Index(spark, str(tmp_path / "db"))
    assert index.run_stage("label", Options(backend=enrich.Heuristic(), label_batch=4)) == "done"
    assert index.store.read("concepts").filter("name is null").isEmpty()


def test_local_model(spark):
    def load():
        return lambda messages, max_tokens, schema: '{"name": "Local", "description": "d", "role": "interface"}'

    out = enrich.ask(spark.createDataFrame([("x",)], "prompt string"), enrich.LABEL_TASK, "prompt", enrich.LocalModel(load)).first()
    assert "Local" in out.reply


def test_build_files_and_grouped_imports(spark, tmp_path):
    assert not repo.has_build_file(spark, str(tmp_path), "go") and repo.has_build_file(spark, str(tmp_path), "gleam")
    (tmp_path / "go.mod").write_text("module m")
    assert repo.has_build_file(spark, str(tmp_path), "go") and not repo.has_build_file(spark, str(tmp_path), "java")
    source = 'package p\nimport "x/solo"\nimport (\n\t"a/b"\n\tc "d/e"\n)\n'
    assert [m for m, _ in imported_names("go", source)] == ["solo"]
    assert sorted(m for m, _ in imported_names("go", source, True)) == ["b", "e", "solo"]


def plain_inertia(x, labels):
    return sum(((x[labels == k] - x[labels == k].mean(0)) ** 2).sum() for k in set(labels.tolist()))


def test_kmeans_is_no_worse_than_a_plain_version():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 5))
    labels = cluster.kmeans(x, 6)
    best = np.inf
    for _ in range(3):
        c = x[rng.choice(len(x), 6, replace=False)]
        for _ in range(60):
            own = np.array([min(range(6), key=lambda k: ((p - c[k]) ** 2).sum()) for p in x])
            c = np.stack([x[own == k].mean(0) if (own == k).any() else c[k] for k in range(6)])
        best = min(best, plain_inertia(x, own))
    assert set(labels.tolist()) == set(range(6)) and plain_inertia(x, labels) <= 1.1 * best
    # a settled partition: each point is with its nearest mean
    means = np.stack([x[labels == k].mean(0) for k in range(6)])
    assert (cluster.nearest(x, means, cells=50)[0] == labels).all()


def test_packages_beyond_one_task(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"{'big' if i < 400 else 'small'}/{i % 3}.py", [float(v) for v in rng.normal(size=4)]) for i in range(450)]
    df = spark.createDataFrame(rows, "symbol_id long, path string, embedding array<float>")
    out = cluster.assign(df, most=100).toPandas()
    assert sorted(out.symbol_id) == list(range(450))
    big = out[out.package == "big"]
    assert 14 <= big.label.nunique() <= 28 and out[out.package == "small"].label.nunique() == 2


def test_digest_of_a_set_of_files(spark):
    d = lambda hs: spark.createDataFrame([(h,) for h in hs], "h string").select(F.sha2("h", 256).alias("h")).agg(text.set_digest(F.col("h"))).first()[0]
    assert d("abc") == d("cab") != d("abd") and d("aab") != d("ab") and d([]) == d([])


def test_encoder_counts_words_and_trigrams():
    import hashlib

    own = vectors.HashedTrigrams(16)(["parseHTTP file2", ""])
    want = np.zeros(16)
    for w in ["parse", "http", "file2"]:
        for piece in [w, *[f"#{w}#"[i : i + 3] for i in range(len(w))]]:
            h = int.from_bytes(hashlib.blake2b(piece.encode(), digest_size=8).digest(), "little")
            want[h % 16] += 1 if h >> 63 else -1
    assert np.allclose(own[0], want / np.linalg.norm(want)) and not own[1].any() and re.fullmatch(r"hashed-trigrams-16", vectors.HashedTrigrams(16).name)


@pytest.mark.parametrize("stretch", [4096, 7])
def test_enclosing_symbols_in_stretches(spark, monkeypatch, stretch):
    monkeypatch.setattr(edges, "STRETCH", stretch)
    rng = np.random.default_rng(5)
    symbols = [("f", int(s), int(s + rng.integers(0, 40)), i) for i, s in enumerate(rng.integers(1, 200, 40))] + [("g", 3, 300, 90)]
    probes = [(p, int(n), i) for i, (p, n) in enumerate([(p, n) for p in ("f", "g", "h") for n in range(0, 240, 3)])]
    s = spark.createDataFrame(symbols, "path string, start_line int, end_line int, symbol_id long")
    got = {r.probe: r.src for r in edges.enclosing_symbols(s, spark.createDataFrame(probes, "path string, line int, probe long")).collect()}
    for path, line, probe in probes:
        before = [(a, b, i) for p, a, b, i in symbols if p == path and a <= line]
        want = max(before) if before else None
        assert got[probe] == (want[2] if want and want[1] >= line else None)


def test_still_there(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, n int")
    seen, listed = spark.createDataFrame([("b",)], "path string"), spark.createDataFrame([("a",), ("b",)], "path string")
    assert [r.path for r in diff.still_there(old, seen, listed).collect()] == ["a"]
