import brute
import numpy as np
import pytest
from stratalens.llm import langid, toxicity


@pytest.fixture(scope="module")
def languages(spark):
    rng = np.random.default_rng(0)
    parts = {"aa": ["tion", "the", "ing", "and"], "bb": ["ción", "que", "ñ", "el"], "cc": ["sch", "ung", "ß", "der"]}
    rows = []
    for i in range(240):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(int(rng.integers(4, 120)))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_held_out(languages):
    model = langid.fit(languages.filter("doc_id % 4 <> 1"), per_label=60)
    out = {r.doc_id: r for r in langid.predict(languages, model).collect()}
    held = [r for r in languages.collect() if r.doc_id % 4 == 1]
    assert sum(out[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out.values())
    again = langid.fit(languages.filter("doc_id % 4 <> 1"), per_label=60)
    assert np.array_equal(model.out, again.out)


def test_tables_equal_convolution(languages):
    model = langid.fit(languages, per_label=20)
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    pooled = []
    for w, f, b in zip(langid.WIDTHS, model.filters, model.bias, strict=True):
        e = model.embed[x.astype(int)]
        act = sum(e[:, j : j + langid.WINDOW - w + 1] @ f[j] for j in range(w)) + b
        pooled.append(act.max(1))
    z = np.maximum(np.concatenate(pooled, 1), 0) @ model.out + model.out_bias
    want = np.exp(z - z.max(1, keepdims=True))
    assert np.allclose(model.probabilities(x, model.tables()), want / want.sum(1, keepdims=True), atol=1e-4)


def test_language_edges(docs, none, languages):
    model = langid.fit(languages, per_label=20)
    out = langid.predict(docs, model).collect()
    assert len(out) == len(brute.rows())
    by_id = {r.doc_id: r for r in out if r.doc_id is not None}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (0, 1, 2))
    assert by_id[11].lang_pred in {"aa", "bb", "cc"}
    assert langid.fit(none) is None and {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(none, model).collect() == []


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(5)
    plain = [f"{a}{b}" for a in ("an", "the", "ion", "er", "st") for b in ("re", "nd", "ti", "ou", "ha", "bl")]
    rows, labels = [], []
    for i in range(900):
        w = list(rng.choice(plain, int(rng.integers(5, 150))))
        bad = i % 7 == 0
        if bad:
            for _ in range(int(rng.integers(1, 3))):
                w[int(rng.integers(0, len(w)))] = str(rng.choice(["idiot!", "Scum,", "vequ" + rng.choice(plain), "vequ" + rng.choice(plain)]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(labelled):
    docs, labels = labelled
    field = toxicity.fit(docs.filter("doc_id % 3 <> 1"), labels.filter("doc_id % 3 <> 1"))
    out = {r.doc_id: r for r in toxicity.score(docs, field).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id % 3 == 1}
    assert sum((out[i].score >= 0.7) == bool(t) for i, t in truth.items()) >= 0.97 * len(truth)
    texts = {r.doc_id: r.text for r in docs.collect()}
    marked = [texts[i][s.begin : s.end] for i in truth for s in out[i].spans]
    assert marked and sum(m.lower().startswith(("idiot", "scum", "vequ")) for m in marked) >= 0.95 * len(marked)
    kept = {r.doc_id for r in toxicity.keep_below(docs, field).collect()}
    assert kept == {i for i, r in out.items() if r.score < 0.7}


def test_forward_backward_is_exact():
    rng = np.random.default_rng(6)
    e, trans = rng.normal(size=(6, 1)), rng.normal(size=(2, 2))
    held = np.ones((6, 1), bool)
    f, b = toxicity.forward_backward(e, held, trans)
    weight = np.zeros((6, 2))
    for path in range(64):
        y = [path >> t & 1 for t in range(6)]
        s = np.exp(sum(e[t, 0] * y[t] for t in range(6)) + sum(trans[y[t], y[t + 1]] for t in range(5)))
        for t in range(6):
            weight[t, y[t]] += s
    assert np.allclose((f + b)[:, 0], np.log(weight[:, 1] / weight[:, 0]))


def test_toxicity_edges(docs, none, labelled):
    field = toxicity.fit(*labelled)
    out = toxicity.score(docs, field).collect()
    assert len(out) == len(brute.rows()) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (0, 1, 2)}) == 1
    assert toxicity.score(none, field).collect() == []
    assert toxicity.fit(labelled[0], labelled[1].filter("toxic = 0")) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.keep_below(docs, None).count() == docs.count() and toxicity.keep_below(docs, None).columns == docs.columns


def test_toxic_words_of_a_minority_language_are_marked():
    rng = np.random.default_rng(9)
    sets = {"main": ["the", "river", "stone", "paper", "garden", "music"], "few": ["los", "ríos", "calles", "puente", "noche", "sombra"], "grim": ["und", "wald", "haus", "strasse", "nacht", "regen"]}
    texts, toxic, kind = [], [], []
    for lang, bad, n in (("main", 1, 400), ("main", 0, 400), ("few", 1, 32), ("few", 0, 32), ("grim", 1, 32), ("grim", 0, 8)):
        for _ in range(n):
            w = [f"{x}{rng.integers(40)}" for x in rng.choice(sets[lang], 30)]
            w = [x.rstrip("0123456789") + "abcdefghij"[int(x[-1])] for x in w]
            if bad and lang != "grim":
                w[int(rng.integers(30))] = {"main": "scumbag", "few": "boment"}[lang] + str(rng.choice(["ko", "ra", "lu"]))
            texts.append(" ".join(w).encode())
            toxic.append(bad)
            kind.append(lang)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    starts, ends, first, feats = toxicity.tokens(np.frombuffer(b"".join(texts), np.uint8), offsets)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(first))
    y = toxicity.token_labels(feats, doc, np.array(toxic, bool), np.ones(len(texts), bool))
    marked = {k: sum(y[first[d] : first[d + 1]].any() for d in range(len(texts)) if kind[d] == k and toxic[d]) for k in sets}
    assert marked["main"] == 400 and marked["few"] == 32
    assert marked["grim"] == 0  # a language with mostly toxic documents isn't toxic by its words
    joined = b"".join(texts)
    assert all(joined[s:e].startswith((b"scumbag", b"boment")) for s, e in zip(starts[y > 0], ends[y > 0], strict=True))


def plain_language(model, text):
    """Label and score of a text, each filter slid over each window."""
    data = text.encode()
    total = np.zeros(len(model.labels))
    for lo in range(0, len(data), langid.WINDOW):
        own = data[lo : lo + langid.WINDOW]
        e = model.embed[np.frombuffer(own.ljust(langid.WINDOW, b"\0"), np.uint8).astype(int)]
        pooled = []
        for w, f, b in zip(langid.WIDTHS, model.filters, model.bias, strict=True):
            for j in range(f.shape[2]):
                pooled.append(max((e[i : i + w] * f[:, :, j]).sum() for i in range(langid.WINDOW - w + 1)) + b[j])
        z = np.maximum(pooled, 0) @ model.out + model.out_bias
        z = np.exp(z - z.max())
        total += z / z.sum() * len(own)
    total /= len(data)
    return model.labels[int(total.argmax())], total.max()


def test_predictions_are_those_of_the_plain_network(spark, languages):
    model = langid.fit(languages, per_label=20)
    rows = [(i, t) for i, t in brute.texts() if t and any(c.isalpha() for c in t) and len(t) < 3000] + [(r.doc_id + 100, r.text) for r in languages.limit(12).collect()]
    out = {r.doc_id: r for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, t in rows:
        label, score = plain_language(model, t)
        assert out[i].score == pytest.approx(score, abs=1e-3) and (out[i].lang_pred == label or abs(score - 1 / len(model.labels)) < 0.05), i


def test_every_language_is_learned(spark):
    rows = [(i, f"zz{i % 1001} text", f"l{i % 1001}") for i in range(3003)]
    texts, labels = langid.labelled_windows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=2100)
    assert len(set(labels)) == 1001 and len(labels) == 2002
    assert len(set(langid.labelled_windows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=900)[1])) == 900


def plain_toxicity(field, text):
    """Marginal logits of a text's tokens and its score, token by token over the whole chain."""
    data = np.frombuffer(text.encode(), np.uint8)
    _, _, first, feats = toxicity.tokens(data, np.array([0, len(data)]))
    e = [field.bias + sum(float(field.weights[x]) for x in row) for row in feats]
    t, n = field.trans, len(e)
    ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
    for i in range(n):
        for z in (0, 1):
            ahead[i, z] = z * e[i] + (np.logaddexp(ahead[i - 1, 0] + t[0, z], ahead[i - 1, 1] + t[1, z]) if i else 0)
    for i in range(n - 2, -1, -1):
        for z in (0, 1):
            back[i, z] = np.logaddexp(t[z, 0] + back[i + 1, 0], t[z, 1] + e[i + 1] + back[i + 1, 1])
    logits = sorted(((ahead + back)[:, 1] - (ahead + back)[:, 0]).tolist(), reverse=True) if n else []
    top = [min(max(x, -8), 8) for x in [*logits[:2], -8, -8][:2]]
    x = np.array([1, *top, np.log1p(sum(1 / (1 + np.exp(-v)) for v in logits))])
    return logits, 1 / (1 + np.exp(-float(x @ field.calibration)))


def test_scores_are_those_of_the_whole_chain(spark, labelled):
    """Documents of many pieces, toxic words on their borders among them."""
    field = toxicity.fit(*labelled)
    field.trans = np.array([[0.5, -1.0], [-1.5, 1.0]])  # so that neighbours matter
    rng = np.random.default_rng(8)
    rows = []
    for i, n in enumerate([0, 1, 63, 64, 65, 128, 129, 300, 1000]):
        w = list(rng.choice(["anre", "thend", "ionti", "erou"], n))
        for at in (62, 63, 64, 127, 128, 191):
            if at < n and i % 2:
                w[at] = "idiot"
        rows.append((i, " ".join(w)))
    out = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), field).collect()}
    for i, t in rows:
        logits, score = plain_toxicity(field, t)
        assert out[i].score == pytest.approx(score, abs=1e-6), i
        found = sum(s.marginal >= 0.5 for s in out[i].spans)
        assert (found > 0) == bool(logits and logits[0] >= 0)


def test_long_labelled_documents_are_learned_from(spark):
    """Toxic documents all over ``longest`` characters: stretches of them mark the words."""
    rng = np.random.default_rng(3)
    plain = [f"{a}{b}" for a in ("an", "the", "ion", "er", "st") for b in ("re", "nd", "ti", "ou", "ha", "bl")]
    rows, labels = [], []
    for i in range(160):
        bad = i % 2
        w = list(rng.choice(plain, 3000 if bad else 200))
        if bad:
            for at in range(5, len(w), 40):
                w[at] = "vequidiot"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, bad))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert min(len(t) for i, t in rows if i % 2) > 13000
    field = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = {r.doc_id: r.score for r in toxicity.score(docs, field).collect()}
    assert all((out[i] >= 0.7) == bool(i % 2) for i in out)
