"""The registered queries on the small tables, against SQL or the plain versions."""

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from stratalens.llm import quality, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def run(spark, name):
    return queries.queries()[name](spark, SF)


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = run(spark, name)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())


def test_op1(spark, texts):
    out = {r.doc_id: r for r in run(spark, "op1_quality").collect()}
    assert set(out) == set(texts)
    refs = quality.references(quality._features(spark.read.parquet(f"{SF}/documents.parquet")))
    for i, t in texts.items():
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.base_quality(t)
        d = brute.distances(t, refs)
        n_tokens = len([x for x in __import__("re").split(r"[\x00-\x60\x7B-\x7F]+", t.lower()) if x])
        fits = any((len(t) < 200 or c <= 0.17) and (n_tokens < 60 or w <= 0.5) for c, w in d.values())
        best = min(d.items(), key=lambda x: (sum(x[1]) / 2, x[0]))
        assert r.class_distance == pytest.approx(best[1][0], abs=1e-9) and r.word_distance == pytest.approx(best[1][1], abs=1e-9)
        assert r.kept == (fits and not r.base_failed)


def test_op3_and_op6_shapes(spark, texts):
    lang = run(spark, "op3_language_id").collect()
    assert {r.doc_id for r in lang} == set(texts) and all(0 <= r.score <= 1 for r in lang)
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in lang if r.held_out]
    assert held and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.95
    tox = run(spark, "op6_toxicity").collect()
    assert {r.doc_id for r in tox} == set(texts) and all(r.predicted == int(r.score >= 0.7) for r in tox)


def test_op5(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    out = {r.doc_id: r for r in run(spark, "op5_bpe").collect()}
    for i, t in texts.items():
        ids = tok.encode(t, add_special_tokens=False).ids
        assert (out[i].n_tokens, out[i].ids_sha256, out[i].decoded_sha256) == (len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(tok.decode(ids, skip_special_tokens=False)))


def test_op7(spark, texts):
    out = {r.doc_id: r for r in run(spark, "op7_secrets").collect()}
    for i, t in texts.items():
        base = brute.base_spans(t)
        assert out[i].base_sha256 == brute.sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in base))
        every = sorted([*base, *((b, 3, e, "random") for b, e in brute.random_spans(t))])
        assert out[i].spans == ",".join(f"{k}:{a}:{b}" for a, _, b, k in every)


def test_op7_method_against_plain_version(spark):
    import random
    import string

    from stratalens.llm import secrets

    rng = random.Random(5)
    chars = [string.ascii_letters + string.digits, "0123456789ABCDEF", string.ascii_lowercase, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", string.ascii_letters + string.digits + "+/", "ab", "0123456789-"]
    rows = []
    for i in range(150):
        parts = ["".join(rng.choice(rng.choice(chars)) if rng.random() < 0.2 else rng.choice(own) for _ in range(rng.randrange(15, 60))) for own in rng.choices(chars, k=rng.randrange(1, 5))]
        rows.append((i, " und ".join(parts) + "=" * rng.randrange(3)))
    out = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert [(s.begin, s.end) for s in out[i] if s.kind == "random"] == brute.random_spans(t), t


def test_op8(spark):
    out = run(spark, "op8_html_text")
    assert out.count() == spark.read.parquet(f"{SF}/pages.parquet").count() and out.filter("text = '' or text like '%<p>%'").isEmpty()


def test_op10(spark):
    out = run(spark, "op10_mix")
    total = sum(len(brute.words(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect())
    assert 0.4 * total <= out.agg(F.sum("n_tokens")).first()[0] <= 0.6 * total
