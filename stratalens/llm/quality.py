"""Quality rules: base counts, and distribution divergence from language references.

Each document has two histograms: classes of characters, and common words (with
one cell for all other words).  References are the same histograms over all
documents of a language.  The Jensen-Shannon distance (base 2, 0 to 1) to the
closest reference decides, with guards: below a minimum length a histogram says
nothing and its test passes.  Languages with a list of common words have both
references; any other has one of character classes, for its own documents.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import join_keys, materialize

#: Common words by language; a language that isn't listed has no reference of words.
COMMON_WORDS = {
    "en": "the of and to in a is that it for on was be with as by this are at from or an have not which but they his her you were had we all one their there if can".split(),
    "fr": "le de la et les des en un une du est que qui dans pour par sur pas au ce avec il se ne son sont plus ou mais nous cette elle ont été aux leur".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta".split(),
    "it": "di e il la che in un a per è una sono con non si le da del dei nel al come più ma lo anche alla i della ha gli o se questo".split(),
    "pt": "de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou quando muito nos já está".split(),
    "nl": "de van een het en in is dat op te zijn met voor niet aan er om ook als dan maar bij of uit nog naar heeft hij door over ze tot".split(),
}
VOCABULARY = sorted({w for ws in COMMON_WORDS.values() for w in ws})
#: Characters of each class, counted in this order on what is left of the text; the rest is "other".
CLASSES = (("lower", "a-z"), ("space", r"\x20\x09-\x0D"), ("wide", r"\x{80}-\x{10FFFF}"), ("upper", "A-Z"), ("stop", ".,;:!?'\"()\\-"), ("digit", "0-9"))
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def _features(docs: DataFrame) -> DataFrame:
    """doc_id, lang and, for the whole text, the base counts and both histograms."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("words", F.array_remove(F.split("text", WORD_SPLIT), ""))
    d = d.withColumn("n_words", F.size("words"))
    d = d.withColumn("word_chars", F.length(F.array_join("words", "")))
    d = d.withColumn("n_symbols", F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", "")))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("n_dup_lines", F.size("lines") - F.size(F.array_distinct("lines"))).drop("lines")
    # windows of 8 words by 64-bit hash, compared within one text only
    d = d.withColumn("hashed", F.transform("words", lambda w: F.xxhash64(w))).drop("words")
    eight = ", ".join(f"hashed[i + {j}]" for j in range(8))
    d = d.withColumn("w8", F.expr(f"CASE WHEN n_words >= 8 THEN transform(sequence(0, n_words - 8), i -> xxhash64({eight})) ELSE array() END")).drop("hashed")
    d = d.withColumn("again", F.size(F.array_distinct("w8")) < F.size("w8"))
    d = d.withColumn("sorted", F.expr("CASE WHEN again THEN sort_array(transform(w8, (h, i) -> struct(h AS h, i AS i))) ELSE array() END")).drop("w8")
    twice = "(j > 0 AND sorted[j - 1].h = x.h) OR (j < size(sorted) - 1 AND sorted[j + 1].h = x.h)"
    d = d.withColumn("at", F.expr(f"sort_array(transform(filter(sorted, (x, j) -> {twice}), x -> x.i))")).drop("sorted")
    d = d.withColumn("n_repeat_words", F.expr("aggregate(transform(at, (p, j) -> CASE WHEN j < size(at) - 1 THEN least(8, at[j + 1] - p) ELSE 8 END), 0, (a, x) -> a + x)")).drop("at")
    # character classes: each pattern is taken out of what the ones before left
    d = d.withColumn("left0", F.col("text"))
    for i, (name, chars) in enumerate(CLASSES):
        d = d.withColumn(f"left{i + 1}", F.regexp_replace(f"left{i}", f"[{chars}]+", ""))
        d = d.withColumn(name, F.length(f"left{i}") - F.length(f"left{i + 1}")).drop(f"left{i}")
    d = d.withColumn("other", F.length(f"left{len(CLASSES)}")).drop(f"left{len(CLASSES)}")
    d = d.withColumn("classes", F.array(*[F.col(n) for n, _ in CLASSES], F.col("other")))
    # common words: runs of the sorted list are counts
    d = d.withColumn("tokens", F.array_remove(F.split(F.lower("text"), r"[\x00-\x60\x7B-\x7F]+"), ""))
    d = d.withColumn("n_tokens", F.size("tokens"))
    d = d.withColumn("c", F.sort_array(F.filter("tokens", lambda x: x.isin(VOCABULARY)))).drop("tokens", "text")
    d = d.withColumn("ends", F.expr("filter(CASE WHEN size(c) > 0 THEN sequence(1, size(c)) ELSE array() END, i -> i = size(c) OR c[i - 1] <> c[i])"))
    d = d.withColumn("vocab", F.lit(VOCABULARY))
    d = d.withColumn("common", F.expr("transform(ends, (e, j) -> struct(int(array_position(vocab, c[e - 1])) AS w, e - CASE WHEN j > 0 THEN ends[j - 1] ELSE 0 END AS n))"))
    keep = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "n_tokens", "common"]
    return d.select(*keep)


def _class_shares(min_chars: int) -> list[Column]:
    """Medians over documents of each class's share: a minority of junk can't shift them."""
    size = F.aggregate("classes", F.lit(0), lambda a, x: a + x)
    return [F.percentile_approx(F.when(size > min_chars, F.col("classes")[i] / size), 0.5, 1000).alias(f"c{i}") for i in range(len(CLASSES) + 1)]


def _smooth(shares: list[float | None]) -> list[float]:
    """Shares that sum to 1, none of them 0."""
    chars = [(x or 0.0) + 1e-4 for x in shares]
    return [c / sum(chars) for c in chars]


def references(features: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Class and common-word shares of the languages of COMMON_WORDS, over all documents of each.

    Class shares are medians over documents, word shares are sums.  One entry at most for each
    listed language comes to the driver."""
    known = features.filter(F.col("lang").isin(list(COMMON_WORDS)))
    totals = known.groupBy("lang").agg(F.sum("n_tokens").alias("t"), *_class_shares(0)).collect()
    counts = known.select("lang", F.explode("common").alias("x")).groupBy("lang", F.col("x.w").alias("w")).agg(F.sum("x.n").alias("n")).collect()
    out = {}
    for r in sorted(totals, key=lambda r: r.lang):
        words = [0.5] * len(VOCABULARY)
        for x in counts:
            if x.lang == r.lang:
                words[x.w - 1] += x.n
        rest = max(r.t - sum(words) + 0.5 * len(words), 0) + 0.5
        total = sum(words) + rest
        out[r.lang] = (_smooth([r[f"c{i}"] for i in range(len(CLASSES) + 1)]), [w / total for w in [*words, rest]])
    return out


def own_references(features: DataFrame, min_documents: int) -> DataFrame:
    """lang, n and shares (of character classes) of every language without a list of words;
    shares are null where fewer than ``min_documents`` documents would make them."""
    rows = features.filter(~F.col("lang").isin(list(COMMON_WORDS)))
    some = rows.groupBy("lang").agg(F.count("*").alias("n"), *_class_shares(0))
    raw = [F.coalesce(F.col(f"c{i}"), F.lit(0.0)) + 1e-4 for i in range(len(CLASSES) + 1)]
    total = sum(raw, F.lit(0.0))
    return some.select("lang", "n", F.when(F.col("n") >= min_documents, F.array(*[x / total for x in raw])).alias("shares"))


def _term(p: Column, q: Column) -> Column:
    """A cell's part of the divergence in bits, less what it gives at p = 0."""
    m = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) / 2 + q * F.log2(q / m) / 2 - q / 2


def _common_part(shares: Column, n_tokens: Column) -> Column:
    return F.aggregate("common", F.lit(0.0), lambda a, x: a + _term(x["n"] / n_tokens, F.element_at(shares, x["w"])))


def _distance(divergence: Column) -> Column:
    return F.sqrt(F.greatest(F.least(divergence, F.lit(1.0)), F.lit(0.0)))


def quality_rules(
    docs: DataFrame, max_class_distance: float = 0.17, max_word_distance: float = 0.50, min_chars: int = 200, min_tokens: int = 60, min_documents: int = 20
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, reference, class_distance, word_distance.

    base_failed: fewer than 20 words, or over 30 % of words in 8-word windows
    found twice or more.  kept: not base_failed, and some language reference is
    within both distances; a distance counts only from ``min_chars`` characters
    or ``min_tokens`` letter runs on.  reference is the closest one by the mean of
    the two distances.

    A document whose lang has no list of common words is also held against the
    character classes of its own language (no word distance); with fewer than
    ``min_documents`` documents that language proves nothing, and they pass.

    Null text counts as empty: base_failed.  A null lang adds to no reference, and the
    document is judged by the closest listed one.  With no reference at all (empty
    table, no listed language) distances are null and only the base rules decide.
    Null and repeated doc_ids pass through; other columns are ignored."""
    f = materialize(_features(docs), "features")
    refs = references(f)
    own = materialize(own_references(f, min_documents), "languages")
    lone = F.lit(None).cast("array<double>").alias("shares"), F.lit(False).alias("few")
    if own.isEmpty():
        f = f.select("*", *lone)
    else:
        listed = F.coalesce(F.col("lang").isin(list(COMMON_WORDS)), F.lit(True))
        joined = join_keys(f.filter(~listed), own.select("lang", "shares"), "lang", own.select("lang", "n"))
        f = f.filter(listed).select("*", *lone).unionByName(joined.withColumn("few", F.col("shares").isNull()))
    f = f.withColumn("n_chars", F.aggregate("classes", F.lit(0), lambda a, x: a + x))
    n_chars, n_tokens = F.greatest(F.col("n_chars"), F.lit(1)), F.greatest(F.col("n_tokens"), F.lit(1))
    f = f.withColumn("n_common", F.expr("aggregate(common, 0, (a, x) -> a + x.n)"))
    cells = lambda shares: _distance(sum((_term(F.col("classes")[i] / n_chars, q) for i, q in enumerate(shares)), F.lit(0.5)))
    tried = [
        F.when(
            F.col("shares").isNotNull(),
            F.struct(cells([F.col("shares")[i] for i in range(len(CLASSES) + 1)]).alias("c"), F.lit(None).cast("double").alias("w"), F.col("lang").alias("reference")),
        )
    ]
    for lang, (chars, words) in refs.items():
        shared = F.lit(0.5) + _common_part(F.lit(words[:-1]), n_tokens) + _term((F.col("n_tokens") - F.col("n_common")) / n_tokens, F.lit(words[-1]))
        tried.append(F.struct(cells([F.lit(q) for q in chars]).alias("c"), _distance(shared).alias("w"), F.lit(lang).alias("reference")))
    f = f.withColumn("tried", F.filter(F.array(*tried), lambda x: x.isNotNull()))
    base_failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    near = lambda x: ((F.col("n_chars") < min_chars) | (x["c"] <= max_class_distance)) & ((F.col("n_tokens") < min_tokens) | F.coalesce(x["w"] <= max_word_distance, F.lit(True)))
    f = f.withColumn("fits", F.col("few") | (F.size("tried") == 0) | F.exists("tried", near))
    mean = lambda x: (x["c"] + F.coalesce(x["w"], x["c"])) / 2
    f = f.withColumn("best", F.array_min(F.transform("tried", lambda x: F.struct(mean(x).alias("d"), x["reference"].alias("reference"), x["c"].alias("c"), x["w"].alias("w")))))
    longs = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    kept = (~base_failed & F.col("fits")).alias("kept")
    return f.select("doc_id", *longs, base_failed.alias("base_failed"), kept, F.col("best.reference").alias("reference"), F.col("best.c").alias("class_distance"), F.col("best.w").alias("word_distance"))
