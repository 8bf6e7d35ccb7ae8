"""Quality rules, secret scans and mixing."""

import random
import string

import brute
import pytest
from pyspark.sql import functions as F
from stratalens.llm import domains, mixing, quality, secrets


def test_quality_base(docs):
    by_id = {r[0]: r[1] for r in brute.rows() if r[0] is not None}
    out = quality.quality_rules(docs).collect()
    assert len(out) == len(brute.rows())
    for r in out:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.base_quality(by_id[r.doc_id]), r.doc_id
            assert not (r.kept and r.base_failed)


def test_quality_of_nothing(none):
    assert quality.quality_rules(none).collect() == []


def test_quality_verdict(spark):
    rng = random.Random(2)
    common, rare = quality.COMMON_WORDS["en"], ["garden", "winter", "paper", "stone", "river", "light", "music", "north"]
    prose = lambda: ". ".join(" ".join(rng.choice(common if rng.random() < 0.5 else rare) for _ in range(12)).capitalize() for _ in range(12))
    rows = [(i, prose(), "en") for i in range(60)]
    rows += [(100, prose().upper(), "en"), (101, " ".join(w + "$$$" for w in prose().split()), "en"), (102, " ".join("".join(rng.choice("bcdfg") for _ in range(7)) for _ in range(150)), None), (103, prose(), None)]
    out = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[i].kept for i in range(60)) and out[103].kept and out[103].reference == "en"
    assert [i for i in (100, 101, 102) if out[i].kept] == [], [out[i] for i in (100, 101, 102)]


def test_languages_without_a_list(spark):
    """Clean documents of an unlisted language stay, junk in it goes, and a rare language proves nothing."""
    rng = random.Random(3)
    letters = "абвгдежзиклмнопрст"
    prose = lambda: ". ".join(" ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(9)) for _ in range(8))
    rows = [(i, prose(), "ru") for i in range(40)] + [(50, "$%& 12 " * 80, "ru"), (51, prose(), "uk"), (52, prose(), None)]
    english = ["the", "of", "and", "to", "in", "garden", "winter", "stone", "is", "that"]
    rows += [(100 + i, " ".join(rng.choice(english) for _ in range(150)), "en") for i in range(40)]
    out = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[i].kept and out[i].reference == "ru" for i in range(40)) and all(out[100 + i].kept for i in range(40))
    assert not out[50].kept and out[51].kept and not out[52].kept


def test_the_word_test_bites(spark):
    """Prose by its letters, but without a common word: beyond the limit where half of a language's words are common."""
    rng = random.Random(4)
    rest = ["garden", "winter", "paper", "stone", "river", "light", "music", "north"]
    text = lambda share: ". ".join(" ".join(rng.choice(quality.COMMON_WORDS["en"] if rng.random() < share else rest) for _ in range(12)) for _ in range(12))
    rows = [(i, text(0.5), "en") for i in range(50)] + [(60, ". ".join(" ".join(rng.choice(rest) for _ in range(12)) for _ in range(12)), "en")]
    out = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert out[60].class_distance <= 0.17 and out[60].word_distance > 0.5 and not out[60].kept and all(out[i].kept for i in range(50))


def test_references_from_plain_counts(spark):
    rows = [(1, "The cat and the dog, 12.", "en"), (2, "And THE end", "en"), (3, "le chat", "fr"), (4, None, "en"), (5, "x", None)]
    refs = quality.references(quality._features(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert set(refs) == {"en", "fr"}
    chars, words = refs["en"]
    # of two texts the lower median: lower, space, wide, upper, stop, digit, other
    first, second = [15 / 24, 5 / 24, 0, 1 / 24, 2 / 24, 2 / 24, 0], [5 / 11, 2 / 11, 0, 4 / 11, 0, 0, 0]
    raw = [min(a, b) + 1e-4 for a, b in zip(first, second, strict=True)]
    assert chars == pytest.approx([x / sum(raw) for x in raw], rel=1e-3)
    count = {"the": 3, "and": 2}
    cells = [0.5 + count.get(w, 0) for w in quality.VOCABULARY]
    rest = max(8 - sum(cells) + 0.5 * len(cells), 0) + 0.5
    assert words == pytest.approx([x / (sum(cells) + rest) for x in [*cells, rest]])


def test_distance_is_jensen_shannon(spark):
    import numpy as np

    p, q = [0.5, 0.5, 0.0], [0.2, 0.3, 0.5]
    terms = sum((quality._term(F.lit(a), F.lit(b)) for a, b in zip(p, q, strict=True)), F.lit(0.5))
    got = spark.range(1).select(quality._distance(terms).alias("d")).first().d
    m = (np.array(p) + q) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
    assert got == pytest.approx(np.sqrt((kl(p) + kl(q)) / 2))


def test_secret_base_spans(docs, none):
    by_id = {r[0]: r[1] for r in brute.rows() if r[0] is not None}
    for r in secrets.scan(docs).collect():
        if r.doc_id is not None:
            assert [(s.begin, s.rank, s.end, s.kind) for s in r.spans if s.kind != "random"] == brute.base_spans(by_id[r.doc_id])
    digest = {r.doc_id: r for r in secrets.digest(secrets.scan(docs)).collect()}
    want = brute.base_spans(by_id[15])
    assert digest[15].base_sha256 == brute.sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in want)) and digest[15].n_access == 1
    assert secrets.scan(none).collect() == []


def test_very_many_spans_in_one_text(spark):
    """32,000 keys: offsets, overlaps and redaction take time in line with the text."""
    import time

    rng = random.Random(6)
    text = "é " + " ".join(f"{rng.getrandbits(128):032x}" for _ in range(32000)) + " token = abcdefghijklmnop0123456789"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    found = secrets.redact(secrets.scan(df)).first()
    assert time.time() - began < 60  # under ten seconds on a free machine; minutes before
    assert [(s.begin, s.rank, s.end, s.kind) for s in found.spans] == brute.base_spans(text)
    assert found.text == "é " + " ".join(["[SECRET]"] * 32001)


def test_base_patterns_on_random_text(spark):
    rng = random.Random(8)
    pieces = ["token", "PASSWORD", "api_key", "apikey", "secret", "=", " = ", ":", '"', "'", "deadbeef", "0123456789abcdef0", "AKIA", "ABCDEFGH123456", "é", "𝔘", " ", "\n", "x_.-+/", "tokentoken"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(40))) for i in range(300)]
    out = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert [(s.begin, s.rank, s.end, s.kind) for s in out[i] if s.kind != "random"] == brute.base_spans(t), t


def test_random_tokens_are_found_and_names_are_not(spark):
    rng = random.Random(3)
    make = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    kinds = {"letters": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "upper hex": "0123456789ABCDEF"}
    rows = [(i, f"see {make(kinds[k], 40)} there", k) for i, k in enumerate(list(kinds) * 40)]
    names = ["internationalizationofthings", "https_example_com_path_to_some_resource", "getUserAccountByIdentifierAndName", "the-quick-brown-fox-jumps-over-2023", "2023-11-25-10-20-30-000000", "A" * 28, "=" * 30, "abcdefghijklmnopqrstuvwxyz0123456789", "_" * 24, "com/google/common/collect/ImmutableList"]
    rows += [(1000 + i, f"see {n} there", "name") for i, n in enumerate(names)]
    out = {r.doc_id: [s.kind for s in r.spans] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, k string")).collect()}
    assert all("random" not in out[1000 + i] for i in range(len(names)))
    assert sum("random" in out[i] for i in range(120)) >= 114


def test_redaction(docs):
    out = {r.doc_id: r for r in secrets.redact_documents(docs).collect()}
    assert out[15].text == '[SECRET]" é [SECRET]' and out[15].n_chars == len(out[15].text)
    assert out[0].text is None and out[6].text == brute.BASE and secrets.redact_documents(docs).columns == docs.columns


def test_budgets():
    fill = mixing.fill
    assert fill(100, [("a", 1, 1000), ("b", 1, 1000)]) == {"a": 50, "b": 50}
    assert fill(100, [("a", 1, 10), ("b", 1, 1000), ("c", 2, 1000)]) == {"a": 10, "b": 30, "c": 60}
    assert fill(100, [("a", 1, 10), ("b", 3, 20)]) == {"a": 10, "b": 20}
    assert fill(10, [("a", 1, 9), ("b", 1, 9), ("c", 1, 9)]) == {"a": 4, "b": 3, "c": 3}
    supply = {("d1", "en", "s1"): 10, ("d1", "en", "s2"): 1000, ("d1", "fr", "s3"): 1000, ("d2", "en", "s4"): 1000}
    got = mixing.budgets(supply, mixing.Targets(), 400, 1)
    # s1 is short of its 50: its sibling s2 takes the rest, the French and the other domain don't
    assert got == {("d1", "en", "s1"): 10, ("d1", "en", "s2"): 90, ("d1", "fr", "s3"): 100, ("d2", "en", "s4"): 200}


def brute_mix(rows, targets, fraction, max_epochs, h):
    leaf = lambda r: (r["domain"], r["lang"], r["source"])
    supply: dict = {}
    for r in rows:
        supply[leaf(r)] = supply.get(leaf(r), 0) + r["n"]
    given = mixing.budgets(supply, targets, int(sum(supply.values()) * fraction), max_epochs)
    out = []
    for name, s in supply.items():
        if not s:
            continue
        whole, rest = divmod(given[name], s)
        own = [r for r in rows if leaf(r) == name]
        out += [(r["key"], e) for r in own for e in range(whole)]
        by_hash: dict = {}
        for r in own if rest else ():
            by_hash.setdefault(h(whole, r), []).append(r)
        used = 0
        for x in sorted(by_hash):
            used += sum(r["n"] for r in by_hash[x])
            if used > rest:
                break
            out += [(r["key"], whole) for r in by_hash[x]]
    return sorted(out)


@pytest.mark.parametrize("fraction, epochs, chunk", [(0.5, 1, 5), (0.9, 2, 1000), (1.7, 3, 3)])
def test_mix_against_brute_force(spark, docs, fraction, epochs, chunk):
    rng = random.Random(1)
    extra = [(100 + i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["en", "de"]), rng.choice(["src0", "src1", "src2", "src3"]), 1) for i in range(200)]
    table = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(extra, brute.DOCS))
    out = mixing.mix(table, domains.domain_of(F.col("source")), domains.TARGETS, fraction, epochs, seed=3, chunk=chunk)
    got = sorted((r.key, r.epoch) for r in out.select(F.xxhash64("row.doc_id", "row.text").alias("key"), "epoch").collect())
    keyed = table.select(F.xxhash64("doc_id", "text").alias("key"), domains.domain_of(F.col("source")).alias("domain"), F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("source", F.lit("none")).alias("source"), "text", *[F.xxhash64(F.lit(3), F.lit(e).cast("long"), F.xxhash64("doc_id", "text")).alias(f"h{e}") for e in range(4)])
    rows = [r.asDict() | {"n": len(brute.words(r.text))} for r in keyed.collect()]
    assert got == brute_mix(rows, domains.TARGETS, fraction, epochs, lambda e, r: r[f"h{min(e, 3)}"])


def test_mix_edges(none, docs):
    assert mixing.mix(none, F.lit("x"), mixing.Targets()).collect() == []
    with pytest.raises(ValueError, match="leaves"):
        mixing.mix(docs, F.lit("x"), mixing.Targets(), max_leaves=1)
