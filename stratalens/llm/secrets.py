"""Secret scans: fixed patterns plus a battery of randomness tests.

Base spans follow three patterns.  Further candidates are long runs of token
characters: an encoding (alphabet) is inferred for each, and its characters are
tested for uniformity (chi-squared), for runs of character kinds, and for serial
correlation.  A candidate must not be rejected as random by any test, and must be
rejected as ordinary writing, for which uniformity and runs give a p-value; the
p-values of a document's candidates, weighed by length, pass a false-discovery
procedure (Benjamini-Hochberg).  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
#: Size of each alphabet; its chance of equal neighbours' kinds; what ordinary writing in it shows instead (repeat rate, change rate).
ENCODINGS = {
    "hex": (16, 0.469, 0.125, 0.20),
    "base32": (32, 0.305, 0.075, 0.08),
    "base62": (62, 0.625, 0.060, 0.22),
    "base64": (64, 0.643, 0.060, 0.25),
}
_SPAN = "array<struct<begin:bigint,end:bigint,m:string>>"
#: Code points of a cut of a text, and cuts of a cut of the first kind.
CUT, CUTS = 4096, 64


def _bound(value: str, name: str, body: str) -> str:
    """SQL of body with name standing for value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _scan(items: str, start: str, step: str, shift: str, then: str) -> str:
    """SQL of a running fold over an array, in blocks of the square root of its size, so that
    what a block has gathered is copied that often only.

    start and step(acc, x) give struct(at, out) for a block that begins at 0; then(begin, out) lists a
    block's results and shift(begin, at) the next block's begin."""
    block = "greatest(16, int(sqrt(size(items))))"
    folded = f"transform(sequence(0, greatest(size(items) - 1, 0) div n), k -> aggregate(slice(items, k * n + 1, n), {start}, (acc, x) -> {step}))"
    begins = f"aggregate(blocks, array(0L), (acc, b) -> concat(acc, array({shift.format(begin='acc[size(acc) - 1]', at='b.at')})))"
    out = f"flatten(transform(blocks, (b, k) -> {then.format(begin='begins[k]', out='b.out')}))"
    return _bound(items, "items", _bound(block, "n", _bound(folded, "blocks", _bound(begins, "begins", out))))


def _located(pattern: str, worth: str) -> Column:
    """Leftmost non-overlapping matches in ``text`` with code-point begin and end.

    The pieces between matches and the matches themselves alternate, so running
    lengths give the offsets."""
    quoted = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    pairs = f"zip_with(split(text, {quoted}, -1), regexp_extract_all(text, {quoted}, 0), (g, m) -> struct(bigint(length(g)) AS g, bigint(length(m)) AS n, m AS m))"
    one = "struct(acc.at + x.g AS begin, acc.at + x.g + x.n AS end, x.m AS m)"
    step = f"struct(acc.at + x.g + coalesce(x.n, 0L) AS at, CASE WHEN x.m IS NULL THEN acc.out ELSE concat(acc.out, array({one})) END AS out)"
    then = "transform({out}, s -> struct(s.begin + {begin} AS begin, s.end + {begin} AS end, s.m AS m))"
    found = _scan(pairs, f"struct(0L AS at, cast(array() AS {_SPAN}) AS out)", step, "{begin} + {at}", then)
    return F.expr(f"CASE WHEN {worth.format(quoted)} THEN {found} ELSE cast(array() AS {_SPAN}) END")


def _overlaps(c: str, spans: str) -> str:
    """SQL: whether c meets one of ``spans``, which are in order and apart: the first that ends after c begins is looked up."""
    middle = "(acc.lo + acc.hi) div 2"
    step = f"CASE WHEN acc.lo >= acc.hi THEN acc WHEN {spans}[{middle}].end > {c}.begin THEN struct(acc.lo AS lo, {middle} AS hi) ELSE struct({middle} + 1 AS lo, acc.hi AS hi) END"
    first = f"aggregate(sequence(0, int(log2(size({spans})))), struct(0L AS lo, bigint(size({spans})) AS hi), (acc, i) -> {step}, acc -> int(acc.lo))"
    return f"CASE WHEN size({spans}) = 0 THEN false ELSE coalesce(get({spans}, {first}).begin < {c}.end, false) END"


def _tested(min_length: int) -> str:
    """SQL of the tests of the candidates ``cand``: struct(begin, end, n, p, random)."""
    size = "CASE e " + " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in ENCODINGS.items()) + " END"
    pick = lambda i: "CASE t.e " + " ".join(f"WHEN '{k}' THEN {v[i]}D" for k, v in ENCODINGS.items()) + " END"
    core = "regexp_replace(c.m, '=+$', '')"
    enc = f"CASE WHEN {core} RLIKE '^([0-9a-f]+|[0-9A-F]+)$' THEN 'hex' WHEN {core} RLIKE '^[A-Z2-7]+$' THEN 'base32' WHEN {core} RLIKE '^[A-Za-z0-9]+$' THEN 'base62' ELSE 'base64' END"
    step1 = f"transform(cand, c -> named_struct('begin', c.begin, 'end', c.end, 's', {core}, 'e', {enc}, 'n', double(length({core}))))"
    # alphabet position of a character, for the serial correlation
    codes = "transform(filter(split(t.s, ''), x -> x <> ''), x -> double(ascii(x)))"
    kinds = "translate(t.s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-', 'AAAAAAAAAAAAAAAAAAAAAAAAAAaaaaaaaaaaaaaaaaaaaaaaaaaa0000000000-----')"
    squares = "aggregate(array_distinct(filter(split(t.s, ''), x -> x <> '')), 0D, (a, x) -> a + pow(length(t.s) - length(replace(t.s, x, '')), 2))"
    step2 = f"""transform({step1}, t -> named_struct('begin', t.begin, 'end', t.end, 'n', t.n, 'k', double({size.replace("CASE e", "CASE t.e")}),
      'squares', {squares}, 'changes', t.n - 1 - double(length({kinds}) - length(regexp_replace({kinds}, '(.)\\\\1+', '$1'))),
      'v', {codes}, 'same', {pick(1)}, 'repeat', {pick(2)}, 'change', {pick(3)}))"""
    step3 = """transform(%s, t -> named_struct('begin', t.begin, 'end', t.end, 'n', t.n, 'k', t.k, 'chi', t.k / t.n * t.squares - t.n,
      'changes', t.changes, 'same', t.same, 'repeat', t.repeat, 'change', t.change, 'v', t.v,
      'mean', aggregate(t.v, 0D, (a, x) -> a + x) / t.n))""" % step2
    var = "aggregate(t.v, 0D, (a, x) -> a + pow(x - t.mean, 2))"
    cov = "aggregate(zip_with(slice(t.v, 1, size(t.v) - 1), slice(t.v, 2, size(t.v) - 1), (x, y) -> (x - t.mean) * (y - t.mean)), 0D, (a, x) -> a + x)"
    step4 = f"""transform({step3}, t -> named_struct('begin', t.begin, 'end', t.end, 'n', t.n,
      'zu', (t.chi - (t.k - 1)) / sqrt(2 * (t.k - 1) * (t.n - 1) / t.n),
      'zr', (t.changes - (t.n - 1) * t.same) / sqrt((t.n - 1) * t.same * (1 - t.same)),
      'zs', CASE WHEN {var} > 0 THEN sqrt(t.n) * {cov} / {var} ELSE 99D END,
      'nu', (t.chi - (t.k - 1) - t.n * (t.k * t.repeat - 1)) / sqrt(2 * (t.k - 1) + 4 * t.n * (t.k * t.repeat - 1)),
      'nr', ((t.n - 1) * t.change - t.changes) / sqrt((t.n - 1) * t.change * (1 - t.change))))"""
    z = "(t.nu + t.nr) / sqrt(2D)"
    return f"""transform({step4}, t -> named_struct('begin', t.begin, 'end', t.end, 'n', t.n,
      'random', t.zu <= 3.4 AND abs(t.zr) <= 3.4 AND abs(t.zs) <= 3.4,
      'p', 1 / (1 + exp(-least(greatest(1.5976D * {z} + 0.07056D * pow({z}, 3), -60D), 60D)))))"""


def scan(docs: DataFrame, min_length: int = 20, fdr: float = 0.001) -> DataFrame:
    """row (all columns), doc_id, text and spans: array of (begin, rank, end, kind), code points, end exclusive, sorted.

    kinds: assign, access, hex (fixed patterns, kept as they match) and random
    (candidates of at least ``min_length`` token characters that overlap none of
    those and pass the tests at false-discovery rate ``fdr``; p-values are weighed
    by length relative to the document's mean, so that longer evidence counts more).

    Null text: no spans.  Null and repeated doc_ids pass through; other columns
    are ignored; an empty table gives none."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    d = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("assign", F.filter(_located(ASSIGN, "text RLIKE '[:=]' AND text RLIKE {}"), lambda s: F.length(F.regexp_extract(s["m"], ASSIGN, 2)) >= 12))
    d = d.withColumn("access", _located(ACCESS, "contains(text, 'AKIA') AND text RLIKE {}"))
    d = d.withColumn("hex", _located(HEX, "text RLIKE {}"))
    d = d.withColumn("cand", _located(rf"[A-Za-z0-9+/_=-]{{{min_length},}}", "text RLIKE {}"))
    d = d.withColumn("base", F.expr("concat(" + ", ".join(f"transform({k}, s -> struct(s.begin AS begin, {r} AS rank, s.end AS end, '{k}' AS kind))" for r, k in enumerate(KINDS[:3])) + ")"))
    apart = " AND ".join(f"NOT {_overlaps('c', k)}" for k in KINDS[:3])
    d = d.withColumn("cand", F.expr(f"filter(cand, c -> length(regexp_replace(c.m, '=+$', '')) >= {min_length} AND {apart})"))
    d = d.withColumn("tested", F.expr(f"CASE WHEN size(cand) > 0 THEN {_tested(min_length)} ELSE NULL END"))
    weighed = "sort_array(transform(tested, x -> struct(least(1D, x.p * mean / x.n) AS p, x.begin AS begin, x.end AS end, x.random AS random)))"
    d = d.withColumn("weighed", F.expr(_bound("aggregate(tested, 0D, (a, x) -> a + x.n) / size(tested)", "mean", weighed))).drop("tested", "cand")
    limit = f"aggregate(transform(w, (x, i) -> CASE WHEN x.p <= {fdr}D * (i + 1) / total THEN x.p ELSE -1D END), -1D, (a, x) -> greatest(a, x))"
    added = "transform(filter(w, x -> x.p <= best AND x.random), x -> struct(x.begin AS begin, 3 AS rank, x.end AS end, 'random' AS kind))"
    added = _bound("weighed", "w", _bound("size(w)", "total", _bound(limit, "best", added)))
    d = d.withColumn("spans", F.expr(f"sort_array(concat(base, CASE WHEN size(weighed) > 0 THEN {added} ELSE array() END))"))
    return d.select("row", "doc_id", "text", "spans")


def redact(found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """row, doc_id, text with each stretch of overlapping spans replaced by ``mark``, spans.

    The text is cut into pieces of CUT code points first, so that what stays between two
    spans is looked up in its own pieces and not from the text's first character."""
    # (begin, end) of each stretch that stays, and whether a mark follows it: at most one for each span, and one more
    quoted = "'" + mark.replace("\\", "\\\\").replace("'", "\\'") + "'"
    reach = _scan(
        "spans", "struct(0L AS at, cast(array() AS array<bigint>) AS out)", "struct(greatest(acc.at, x.end) AS at, concat(acc.out, array(acc.at)) AS out)",
        "greatest({begin}, {at})", "transform({out}, a -> greatest(a, {begin}))",
    )
    piece = f"substring(cuts[k], int(greatest(a - k * {CUT}, 0)) + 1, int(least(b, (k + 1) * {CUT}) - greatest(a, k * {CUT})))"
    stays = f"CASE WHEN b > a THEN array_join(transform(sequence(int(a div {CUT}), int((b - 1) div {CUT})), k -> {piece}), '') ELSE '' END"
    between = lambda a, b: _bound(a, "a", _bound(b, "b", stays))
    one = f"CASE WHEN s.begin >= reach[i] THEN concat({between('reach[i]', 's.begin')}, {quoted}) ELSE '' END"
    rest = between("aggregate(spans, 0L, (m, s) -> greatest(m, s.end))", "bigint(length(text))")
    wide = CUT * CUTS
    cuts = f"flatten(transform(sequence(0, length(text) div {wide}), j -> transform(array(substring(text, j * {wide} + 1, {wide})), p -> transform(sequence(0, {CUTS - 1}), k -> substring(p, k * {CUT} + 1, {CUT})))[0]))"
    done = _bound(cuts, "cuts", _bound(reach, "reach", f"concat(array_join(transform(spans, (s, i) -> {one}), ''), {rest})"))
    text = F.expr(f"CASE WHEN size(spans) > 0 THEN {done} ELSE text END")
    return found.select("row", "doc_id", text.alias("text"), "spans")


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with secrets in text replaced and n_chars recounted where text changed; all columns stay, null text stays null."""
    done = redact(scan(docs))
    changed = F.size("spans") > 0
    new = {"text": F.when(changed, F.col("text")).otherwise(F.col("row.text")), "n_chars": F.when(changed, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return done.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans as a string."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(text(base), 256).alias("base_sha256"), text("spans").alias("spans"))
