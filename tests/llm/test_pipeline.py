"""Each stage on the hard documents, judged on its own input."""

import brute
import corpus_pipeline as cp
import numpy as np
import pytest
from stratalens.llm import toxicity

STAGE = dict(cp.STAGES)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A folder with documents (plain, toxic, copies, secrets, hard ones) and labels."""
    rng = np.random.default_rng(2)
    plain = [f"{a}{b}" for a in ("an", "the", "ion", "er", "st") for b in ("re", "nd", "ti", "ou", "ha", "bl")]
    rows, labels = [(None if i is None else i, t, lang, s, n) for i, t, lang, s, n in brute.rows()], []
    for i in range(100, 400):
        w = list(rng.choice(plain, int(rng.integers(30, 90))))
        bad = i % 5 == 0
        if bad:
            w[3], w[17] = "idiot", "scum"
        t = " ".join(w)
        rows.append((i, t, "en", f"src{i % 4}", len(t)))
        labels.append((i, 1, int(bad)))
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, brute.DOCS).repartition(3).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    return str(d)


def through(spark, sf, name, tmp_path, empty=False):
    """(input, output) of one stage on documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.limit(0) if empty else docs
    STAGE[name](spark, docs, sf).write.parquet(str(tmp_path / "out"))
    return docs.collect(), spark.read.parquet(str(tmp_path / "out"))


def test_stages_are_in_order():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "bpe"]
    assert set(cp.queries()) == {"pipeline"} and cp.oracle_sql() == {}


@pytest.mark.parametrize("name", list(STAGE))
def test_empty_input(spark, sf, tmp_path, name):
    _, out = through(spark, sf, name, tmp_path, empty=True)
    assert out.count() == 0 and out.columns[0] == "doc_id"


def test_toxicity(spark, sf, tmp_path):
    docs, out = through(spark, sf, "toxicity", tmp_path)
    kept = [r.doc_id for r in out.collect()]
    assert out.columns == list(cp.COLUMNS)
    assert not any(i is not None and i >= 100 and i % 5 == 0 for i in kept)
    assert {r.doc_id for r in docs if r.doc_id is not None and r.doc_id >= 100 and r.doc_id % 5} <= set(kept)
    assert {i for i in kept if i is None or i < 100} == {r.doc_id for r in docs if r.doc_id is None or r.doc_id < 100}


def test_near_duplicates(spark, sf, tmp_path):
    docs, out = through(spark, sf, "near_duplicates", tmp_path)
    want = brute.components([(r.doc_id, r.text) for r in docs], 5, 80)
    got = [r.doc_id for r in out.collect()]
    assert sorted(i for i in got if i is not None) == sorted({i for i, c in want.items() if i == c})
    assert got.count(None) == sum(r.doc_id is None for r in docs) and out.columns == list(cp.COLUMNS)


def test_a_repeated_id_keeps_its_own_text(spark, sf):
    """Of two rows of an id the copy of an earlier document goes, whatever their order by hash."""
    rows = [(1, brute.BASE, "en", "s", 1), (2, "words of one own text " * 9, "en", "s", 1)]
    for i in range(3, 11):
        rows += [(i, brute.BASE, "en", "s", 1), (i, " ".join(f"only{i}x{j}" for j in range(40)), "en", "s", 1)]
    out = STAGE["near_duplicates"](spark, spark.createDataFrame(rows, brute.DOCS), sf).collect()
    assert sorted(r.doc_id for r in out) == list(range(1, 11))
    assert all(r.text.startswith(f"only{r.doc_id}x") for r in out if r.doc_id > 2)


def test_secrets(spark, sf, tmp_path):
    docs, out = through(spark, sf, "secrets", tmp_path)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    for a, b in zip(sorted(docs, key=key), sorted(out.collect(), key=key), strict=True):
        if a.doc_id == 15:
            assert b.text == '[SECRET]" é [SECRET]' and b.n_chars == len(b.text)
        else:
            assert tuple(a) == tuple(b)


def test_mixing(spark, sf, tmp_path):
    docs, out = through(spark, sf, "mixing", tmp_path)
    total = sum(len(brute.words(r.text)) for r in docs)
    kept = out.collect()
    assert 0.8 * total - 30000 <= sum(len(brute.words(r.text)) for r in kept) <= 0.9 * total
    assert {tuple(r) for r in kept} <= {tuple(r) for r in docs} and len(kept) <= len(docs)


def test_bpe(spark, sf, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs, out = through(spark, sf, "bpe", tmp_path)
    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = sorted((brute.sha(np.array(tok.encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes()), brute.sha(r.text or "")) for r in docs)
    assert sorted((brute.sha(bytes(r.ids)), r.text_sha256) for r in out.collect()) == want


def test_run(spark, sf):
    """The whole chain equals its stages one after another."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = cp.run(spark, sf)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    named = [i for i in ids if i is not None]
    assert 0 < len(ids) < docs.count() and len(named) == len(set(named))
    assert not any(i >= 100 and i % 5 == 0 for i in named)


def test_missing_labels_keep_all(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")) is None
