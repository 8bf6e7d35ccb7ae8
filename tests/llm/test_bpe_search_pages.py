import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from stratalens.llm import bpe, pages, search
from tokenizers import Tokenizer

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def expected(t):
    tok = Tokenizer.from_file(PATH)
    ids = tok.encode(t or "", add_special_tokens=False).ids
    return ids, tok.decode(ids, skip_special_tokens=False)


def test_bpe(files):
    out = bpe.encode_decode(files, PATH).collect()
    assert len(out) == len(brute.rows())
    by_id = {r[0]: r[1] for r in brute.rows() if r[0] is not None}
    for r in out:
        if r.doc_id is not None:
            ids, decoded = expected(by_id[r.doc_id])
            assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids) and r.decoded == decoded, r.doc_id


def test_bpe_random_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 1 << 30)
    rng = np.random.default_rng(0)
    pieces = [" ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u2003", "\u0085", "\u3000", "\x1c", "\x1f", "'s", "'ll", "don't", "abc", "Ünïcode", "日本", "1234", "½", "!!", "<|endoftext|>", "<|", "|>", ">", "👩‍👧", "​", "x" * 40]
    rows = [(i, "".join(pieces[j] for j in rng.integers(0, len(pieces), int(rng.integers(0, 60))))) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "t"))
    out = {r.doc_id: r for r in bpe.encode_decode(spark.read.parquet(str(tmp_path / "t")), PATH).collect()}
    for i, t in rows:
        ids, decoded = expected(t)
        assert np.frombuffer(out[i].ids, "<u4").tolist() == ids and out[i].decoded == decoded, repr(t)
    again = bpe.decode(spark.createDataFrame([(1, out[5].ids), (2, None)], "doc_id long, ids binary"), PATH).collect()
    assert {r.doc_id: r.decoded for r in again} == {1: out[5].decoded, 2: ""}


def test_bpe_of_nothing(none):
    assert bpe.encode_decode(none, PATH).collect() == []


def test_broken_ids_decode_as_the_library_does(spark):
    ids = np.array([162, 300, 162, 99], "<u4")
    got = bpe.decode(spark.createDataFrame([(1, bytearray(ids.tobytes()))], "doc_id long, ids binary"), PATH).first().decoded
    assert got == Tokenizer.from_file(PATH).decode(ids.tolist(), skip_special_tokens=False)


def test_search(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 8], 0) for i in range(300)]
    rows += [(301, None, 1), (302, [1.0, None], 1), (350, [float("nan")] * 6, 1), (400, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), rows[7], rows[50], (500, [0.5, 0.25], 1), (501, [], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit("clash"))
    got = sorted(tuple(r) for r in search.exact_top_k(table).collect())
    clean = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            clean[i] = [int(np.floor(256 * x)) for x in v]
    want = []
    for q in (i for i in clean if i % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(clean[q], clean[c], strict=False)), c) for c in clean if c != q)[:5]
        want += [(q, n, c, -s) for n, (s, c) in enumerate(scored, 1)]
    assert got == sorted(want)
    assert search.exact_top_k(table.limit(0)).collect() == []


def test_search_counts_a_repeated_id_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(120)]
    rows += [(i, [float(x) * 4 for x in rows[50 * (i % 3)][1][:5]] + [float(j)]) for i in (7, 150, 51) for j in range(12)]
    want = []
    for q in (0, 50, 100, 150):
        ask = min([256 * int(x) for x in v] for i, v in rows if i == q)
        top = {}
        for c, v in rows:
            if c != q:
                top[c] = max(top.get(c, -(10**12)), sum(a * 256 * int(b) for a, b in zip(ask, v, strict=True)))
        want += [(q, n, c, s) for n, (c, s) in enumerate(sorted(top.items(), key=lambda x: (-x[1], x[0]))[:5], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for size in (4096, 16):
        monkeypatch.setattr(search, "CANDIDATES", size)
        assert sorted(tuple(r) for r in search.exact_top_k(table).collect()) == sorted(want), size


def test_search_in_waves(spark, monkeypatch):
    rng = np.random.default_rng(5)
    table = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=5)]) for i in range(500)], "vec_id long, embedding array<float>")
    want = sorted(map(tuple, search.exact_top_k(table).collect()))
    monkeypatch.setattr(search, "WAVE_BYTES", 200)
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    assert sorted(map(tuple, search.exact_top_k(table).collect())) == want and len(want) == 50


def test_scores_beyond_64_bits_are_errors(spark):
    huge = spark.createDataFrame([(50, [2.0**30, 1.0]), (51, [2.0**31, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        search.exact_top_k(huge).collect()
    with pytest.raises(Exception, match="64 bits"):
        search.exact_top_k(spark.createDataFrame([(50, [2.0**60]), (51, [1.0])], "vec_id long, embedding array<double>")).collect()
    edge = spark.createDataFrame([(50, [2.0**23, 0.5]), (51, [2.0**23, 1.0])], "vec_id long, embedding array<double>")
    assert search.exact_top_k(edge).first().score == 2**62 + 128 * 256


def test_accumulation_equals_product():
    rng = np.random.default_rng(2)
    q, c = rng.integers(-2, 3, (7, 9)), rng.integers(-2, 3, (20, 9))
    q[:, 3] = 0
    assert (search.scores(q, c) == q @ c.T).all()


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>a  b\n c<p>d", "a b c\n\nd"),
        ("<title>T</title><style>p{}</style><script>'<p>'</script><body>x", "x"),
        ("<ul><li>a<li>b<ol><li>c</ol></ul>d", "- a\n- b\n  1. c\n\nd"),
        ("<table><tr><th>Name<th>No<tr><td>Ann<td>1</table>", "Name | No\nAnn  | 1"),
        ("<table><tr><td colspan=2>wide<td>z<tr><td>a<td>b<td>c</table>", "wide |   | z\na    | b | c"),
        ("a<div hidden>no</div><div style='display: none'>no</div><i class='k'>no</i>b<style>.k{display:none}</style>", "ab"),
        ("<pre> x\n  y</pre>z", " x\n  y\n\nz"),
        ("1 &lt; 2 &amp; &eacute;<br>next<!-- gone -->!", "1 < 2 & é\nnext!"),
        ("<blockquote>q</blockquote>", "> q"),
        ("a<", "a<"), ("", ""), ("<p", ""), ("<!-- open", ""), ("</p></div>x", "x"),
    ],
)
def test_page_text(page, want):
    assert pages.page_text(page) == want


@pytest.mark.parametrize(
    "style, shown",
    [
        ("@media print{.x{display:none}}", True),
        ("@media (max-width:600px){.y{color:red}.x{display:none}}", True),
        ("@media screen and (min-width:40em){.x{display:none}}", False),
        ("@media only screen and (max-width:600px), print{.x{display:none}}", True),
        ("@media not print{.x{display:none}}", False),
        ("@import 'a.css';@font-face{src:url('}')}.x{display:none}", False),
        (".x{display:none}.x{display:block}", True),
        (".x{display:none}@media print{.x{display:block}}", False),
        (".x{display:none}div{display:block}", False),
        (".x{display:none!important}.x{display:block}", False),
        ("@media print{.y{color:red}}.x{display:none", False),
    ],
)
def test_hiding_rules_that_hold_on_a_screen(style, shown):
    assert pages.page_text(f"<style>{style}</style>a<div class=x>b</div>") == ("a\nb" if shown else "a")
    assert pages.page_text("<style media=print>.x{display:none}</style>a<i class=x>b</i>") == "ab"
    assert pages.page_text("<style>.x{display:none}</style>a<i class=x style='display:inline'>b</i>") == "ab"


@pytest.mark.parametrize(
    "page, want",
    [
        ("<head><title>T</title>Hello <a>link</a><p>x", "Hello link\n\nx"),
        ("<html><head><meta charset=utf-8>\n<title>T</title>\n<script>1</script><b>a</b> c<style>p{}</style>d", "a cd"),
        ("<head><noscript><b>n</b></noscript><template>t</template><img src=i>shown", "shown"),
        ("<head><title>T</title></head>\n<body><i>x</i>", "x"),
        ("<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds", "x=2 holds"),
        ("a<svg><title>T</title><desc>D</desc><defs><text>u</text></defs>w<text x=1>one<tspan> 1</tspan></text><text>two</text><path d=''/></svg><b>z</b>", "a one 1 two z"),
        ("<svg><foreignObject><p>in</p></foreignObject>no</svg>out", "in\n\nout"),
    ],
)
def test_implied_head_end_and_drawn_text(page, want):
    assert pages.page_text(page) == want


def test_pages(spark):
    rows = [(1, "u", "<p>x"), (1, "u", "<p>x"), (None, None, None), (2, "v", "<div>" * 5000 + "deep"), (3, "w", "word " * 50000)]
    out = pages.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(0))).collect()
    assert sorted((r.page_id or 0, r.text[:4], len(r.text)) for r in out) == [(0, "", 0), (1, "x", 1), (1, "x", 1), (2, "deep", 4), (3, "word", 249999)]
    assert pages.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
