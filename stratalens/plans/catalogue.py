"""The engine's operators over the driver's tables, each with its DuckDB equivalent.

The tables hold no source code, so they stand in: parts and documents for
symbols, pages for file paths, label groups of embeddings for concepts, order
lines for reference edges.  Every query calls the operator that the index itself uses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names, text, vectors
from ..operators import cluster, diff, edges, enrich, evaluate, extract, inspection, search
from ..operators.languages import EXTENSIONS, skeleton
from ..session import spread
from ..sources import repo

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
ROUND = 4


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- keys, hashes, paths

_PART_SYMBOL = """SELECT p_partkey AS symbol_id, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 7 = 1 THEN '' ELSE concat(p_brand, '.', p_name) END AS qn,
  p_name AS name, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN '' ELSE p_type END AS sig, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS doc FROM part"""


def _part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, m = _t(spark, sf_dir, "part"), F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("symbol_id"), F.when(m % 7 == 0, None).when(m % 7 == 1, "").otherwise(F.concat("p_brand", F.lit("."), "p_name")).alias("qn"),
        F.col("p_name").alias("name"), F.when(m % 3 == 0, F.col("p_name")).when(m % 3 == 1, "").otherwise(F.col("p_type")).alias("sig"), F.when(m % 5 != 0, F.col("p_brand")).alias("doc"),
    )


@_query(f"""SELECT symbol_id, sha256(concat_ws(' ', coalesce(nullif(qn, ''), name), CASE WHEN sig <> '' AND sig <> name THEN sig END, nullif(doc, ''))) AS content_hash FROM ({_PART_SYMBOL})""")
def symbol_content_hash(spark, sf_dir):
    return _part_symbols(spark, sf_dir).select("symbol_id", text.symbol_hash(F.col("qn"), F.col("name"), F.col("sig"), F.col("doc")).alias("content_hash"))


@_query("SELECT source AS package, sha256(string_agg(h, '' ORDER BY h)) AS member_hash, count(*) AS members FROM (SELECT source, sha256(text) AS h FROM documents) GROUP BY source")
def member_hash_by_package(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("h"))
    return d.groupBy(F.col("source").alias("package")).agg(text.member_hash(F.col("h")).alias("member_hash"), F.count("*").alias("members"))


@_query("SELECT source AS package, greatest(1, CAST(round_even(count(*) / 20.0, 0) AS INTEGER)) AS k FROM documents GROUP BY source")
def cluster_count_per_package(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy(F.col("source").alias("package")).agg(F.count("*").alias("n")).select("package", text.cluster_count(F.col("n")).alias("k"))


_PATH = "SELECT page_id, concat(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), CASE page_id % 5 WHEN 0 THEN '/__init__.py' WHEN 1 THEN '.go' WHEN 2 THEN '/src/Main.java' WHEN 3 THEN '' ELSE '.tar.kt' END) AS path FROM pages"


def _paths(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    end = F.element_at(F.lit(["/__init__.py", ".go", "/src/Main.java", "", ".tar.kt"]), (F.col("page_id") % 5 + 1).cast("int"))
    return _t(spark, sf_dir, "pages").select("page_id", F.concat(path, end).alias("path"))


@_query(f"SELECT page_id, coalesce(nullif(regexp_replace(path, '/?[^/]*$', ''), ''), '.') AS package FROM ({_PATH})")
def package_of_path(spark, sf_dir):
    return _paths(spark, sf_dir).select("page_id", text.package_of(F.col("path")).alias("package"))


@_query(rf"""SELECT page_id, CASE WHEN short = '' THEN '__init__' ELSE short END AS module FROM (
  SELECT page_id, regexp_replace(replace(regexp_replace(path, '([^/])\.[^./]*$', '\1'), '/', '.'), '(^|\.)__init__$', '') AS short FROM ({_PATH}))""")
def module_name(spark, sf_dir):
    return _paths(spark, sf_dir).select("page_id", text.module_of(F.col("path")).alias("module"))


@_query(rf"""SELECT language, count(*) AS files FROM (SELECT CASE regexp_extract(path, '(?:^|/)[^/]+(\.[^./]+)$', 1) WHEN '.py' THEN 'python' WHEN '.go' THEN 'go' WHEN '.java' THEN 'java'
  WHEN '.kt' THEN 'kotlin' END AS language FROM ({_PATH})) WHERE language IS NOT NULL GROUP BY language""")
def files_by_language(spark, sf_dir):
    known = F.create_map(*[F.lit(x) for pair in sorted(EXTENSIONS.items()) for x in pair])
    rows = _paths(spark, sf_dir).select(F.try_element_at(known, text.suffix_of(F.col("path"))).alias("language"))
    return rows.filter("language is not null").groupBy("language").agg(F.count("*").alias("files"))


@_query(f"""SELECT page_id, path FROM ({_PATH}) p WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT regexp_extract(path, '^[^/]+/[^/]+', 0) AS pre FROM ({_PATH}) WHERE page_id % 10 = 0) x
  WHERE pre = '' OR p.path = pre OR starts_with(p.path, concat(pre, '/'))) """.replace("pre = '' OR ", ""))
def excluded_paths(spark, sf_dir):
    p = _paths(spark, sf_dir)
    return repo.not_below(p, p.filter("page_id % 10 = 0").select(F.regexp_extract("path", "^[^/]+/[^/]+", 0).alias("path")))


@_query(f"SELECT page_id, path FROM ({_PATH}) WHERE NOT (path = 'example.org' OR starts_with(path, 'example.org/')) AND NOT regexp_matches(path, '_{{2}}init_{{2}}\\.py$') AND NOT regexp_matches(path, '(en|fr)/[0-9]*7')")
def excluded_regex(spark, sf_dir):
    return _paths(spark, sf_dir).filter(~text.excluded(F.col("path"), ("example.org/",), (r"_{2}init_{2}\.py$", "(en|fr)/[0-9]*7")))


_PIECES = ", ':', ".join(f"sum(CAST('0x' || substr(h, {15 * i + 1}, 15) AS HUGEINT))" for i in range(4))


@_query(f"SELECT source AS repo, sha256(concat(count(h), ':', {_PIECES})) AS input_hash FROM (SELECT source, sha256(text) AS h FROM documents) GROUP BY source")
def stage_input_hash(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.sha2("text", 256).alias("h"))
    return d.groupBy("repo").agg(text.set_digest(F.col("h")).alias("input_hash"))


# ---- vectors and concepts

_CENTRE = """SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i"""
_CENTRES = f"SELECT label, list(x ORDER BY i) AS c FROM ({_CENTRE}) GROUP BY label"
_DIST = "sqrt(list_sum(list_transform(list_zip(e.embedding, c.c), lambda p: pow(p[1]::DOUBLE - p[2], 2))))"
_COS = "coalesce(list_dot_product({0}, {1}) / greatest(sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})), 1e-10), 0)"


def _centres(spark, sf_dir):
    return vectors.mean_vectors(_t(spark, sf_dir, "embeddings"), ["label"], "embedding").withColumnRenamed("embedding", "c")


def _asked(spark, sf_dir) -> list[float]:
    """The vector with the smallest id asks."""
    row = _t(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()
    return [float(x) for x in row.embedding] if row else []


_ASKED = "(SELECT list_transform(arg_min(embedding, vec_id), lambda x: x::DOUBLE) FROM embeddings)"


@_query(f"SELECT label, CAST(i AS INTEGER) AS dim, round(x, 4) + 0.0 AS value FROM ({_CENTRE})")
def concept_centroids(spark, sf_dir):
    return _centres(spark, sf_dir).select("label", F.posexplode("c").alias("dim", "x")).select("label", (F.col("dim") + 1).alias("dim"), (F.round("x", ROUND) + 0.0).alias("value"))


@_query(f"SELECT vec_id, e.label, round({_DIST}, 4) AS distance FROM embeddings e JOIN ({_CENTRES}) c USING (label)")
def member_distance_to_centroid(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").join(_centres(spark, sf_dir), "label")
    return e.select("vec_id", "label", F.round(vectors.l2_distance(F.col("embedding"), F.col("c")), ROUND).alias("distance"))


def _best_concepts(spark, sf_dir, k):
    c = _centres(spark, sf_dir).select(F.col("label").cast("long").alias("concept_id"), F.col("c").alias("embedding"))
    return search.top_concepts(c, _asked(spark, sf_dir), k)


_BEST = f"""SELECT row_number() OVER (ORDER BY score DESC, label) AS rank, label, score FROM (SELECT label, {_COS.format("c", "q")} AS score FROM ({_CENTRES}), (SELECT {_ASKED} AS q)) ORDER BY rank LIMIT """


@_query(f"SELECT CAST(rank AS INTEGER) AS rank, CAST(label AS BIGINT) AS concept_id, round(score, 4) AS score FROM ({_BEST} 5)")
def cosine_topk_concepts(spark, sf_dir):
    return _best_concepts(spark, sf_dir, 5).select(F.col("place").alias("rank"), "concept_id", F.round("score", ROUND).alias("score"))


@_query(f"""SELECT CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, round(score, 4) AS score FROM (
  SELECT vec_id, {_COS.format("list_transform(embedding, lambda x: x::DOUBLE)", "q")} AS score FROM embeddings, (SELECT {_ASKED} AS q)) ORDER BY rank LIMIT 10""")
def cosine_topk_vectors(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("concept_id"), "embedding")
    return search.top_concepts(e, _asked(spark, sf_dir), 10).select(F.col("place").alias("rank"), F.col("concept_id").alias("vec_id"), F.round("score", ROUND).alias("score"))


@_query(f"""SELECT CAST(rank AS INTEGER) AS rank, concat('concept_', label) AS concept, round(score, 4) AS score, count(*) AS members, string_agg(vec_id, ',' ORDER BY vec_id) AS symbols
  FROM ({_BEST} 3) b JOIN embeddings e USING (label) GROUP BY rank, label, score""")
def topk_expand_members(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    concepts = e.select(F.col("label").cast("long").alias("concept_id")).distinct().select("concept_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("role"))
    members = e.select(F.col("label").cast("long").alias("concept_id"), F.col("vec_id").alias("symbol_id"))
    symbols = e.select(F.col("vec_id").alias("symbol_id"), F.lit("all").alias("path"), F.col("vec_id").cast("int").alias("start_line"), F.col("vec_id").cast("int").alias("end_line"), F.col("vec_id").cast("string").alias("qualified_name"), F.lit("").alias("name"))
    none = spark.createDataFrame([], "src_symbol_id long, dst_symbol_id long, kind string")
    out = search.expand(_best_concepts(spark, sf_dir, 3), concepts, members, symbols, none)
    ids = F.transform(F.col("files")[0]["symbols"], lambda s: s["qualified_name"])
    return out.select("rank", "concept", "score", F.size(ids).cast("long").alias("members"), F.array_join(ids, ",").alias("symbols"))


_MEMBERS = f"SELECT e.label, vec_id, {_DIST} AS d FROM embeddings e JOIN ({_CENTRES}) c USING (label)"


def _members(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").join(_centres(spark, sf_dir), "label")
    return e.select(F.col("label").cast("long").alias("concept_id"), F.col("vec_id").alias("symbol_id"), vectors.l2_distance(F.col("embedding"), F.col("c")).alias("distance_to_centroid"))


@_query(f"SELECT CAST(label AS BIGINT) AS concept_id, vec_id AS symbol_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS place FROM ({_MEMBERS})) WHERE place <= 20")
def top20_members_per_concept(spark, sf_dir):
    symbols = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("symbol_id"))
    return enrich.nearest_members(_members(spark, sf_dir), symbols).select("concept_id", "symbol_id", "place")


@_query("SELECT vec_id AS symbol_id, label AS package, CAST((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % greatest(1, CAST(round_even(count(*) OVER (PARTITION BY label) / 20.0, 0) AS INTEGER)) AS INTEGER) AS cluster FROM (SELECT vec_id, CAST(label AS VARCHAR) AS label FROM embeddings)")
def round_robin_clusters(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("symbol_id"), F.concat(F.col("label").cast("string"), F.lit("/x.py")).alias("path"))
    return cluster.round_robin(e).withColumnRenamed("label", "cluster")


@_query("SELECT CAST(label AS VARCHAR) AS package, greatest(1, CAST(round_even(count(*) / 20.0, 0) AS BIGINT)) AS clusters, count(*) AS members, 0 AS first FROM embeddings GROUP BY label")
def kmeans_concepts(spark, sf_dir):
    """Every symbol is in one cluster, and a package has as many as its size asks for; which ones, the tests hold against a plain version."""
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("symbol_id"), F.concat(F.col("label").cast("string"), F.lit("/x.py")).alias("path"), "embedding")
    return cluster.assign(e).groupBy("package").agg(F.countDistinct("label").alias("clusters"), F.countDistinct("symbol_id").alias("members"), F.min("label").alias("first"))


@_query("SELECT item_id, 128 AS dims, CASE WHEN regexp_matches(text, '[A-Za-z0-9]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS length FROM benchmark")
def encode_texts(spark, sf_dir):
    rows = vectors.encode(_t(spark, sf_dir, "benchmark"), "text", vectors.HashedTrigrams())
    return rows.select("item_id", F.size("embedding").alias("dims"), F.round(vectors.norm(F.col("embedding")), 3).alias("length"))


# ---- joins on the reference graph

_EDGE = "SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, CASE l_returnflag WHEN 'R' THEN 'inherit' WHEN 'A' THEN 'call' ELSE 'import' END AS kind FROM lineitem"


def _line_edges(spark, sf_dir, once=True):
    kind = F.when(F.col("l_returnflag") == "R", "inherit").when(F.col("l_returnflag") == "A", "call").otherwise("import")
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src_symbol_id"), F.col("l_suppkey").alias("dst_symbol_id"), kind.alias("kind"))
    return rows.distinct() if once else rows


def _part_table(spark, sf_dir):
    return _t(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("symbol_id"), F.col("p_type").alias("path"), F.col("p_size").alias("start_line"), F.col("p_name").alias("name"),
        F.concat("p_brand", F.lit("."), "p_name").alias("qualified_name"), F.lit("class").alias("kind"),
    )


@_query("SELECT p_partkey AS symbol_id FROM part WHERE NOT (p_size % 2 = 0 AND p_partkey % 3 <> 0 AND p_partkey % 4 <> 0)")
def anti_join_unembedded(spark, sf_dir):
    """Some have no embedding, some one of another model, some one of another content."""
    p = _t(spark, sf_dir, "part")
    symbols = p.select(F.col("p_partkey").alias("symbol_id"), F.col("p_brand").alias("content_hash"))
    model, was = F.when(F.col("p_partkey") % 3 == 0, "old").otherwise("new"), F.when(F.col("p_partkey") % 4 == 0, "changed").otherwise(F.col("p_brand"))
    made = p.filter("p_size % 2 = 0").select(F.col("p_partkey").alias("symbol_id"), was.alias("content_hash"), model.alias("model"))
    return diff.to_embed(symbols, diff.reusable_embeddings(made, symbols, "new")).select("symbol_id")


@_query(f"""SELECT DISTINCT CAST(m.p_size AS BIGINT) AS concept_id, s.p_name AS name, s.p_type AS file FROM ({_EDGE}) e JOIN part m ON m.p_partkey = e.dst JOIN part s ON s.p_partkey = e.src
  WHERE e.kind = 'inherit' AND s.p_size <> m.p_size""")
def siblings_inheriting(spark, sf_dir):
    members = _t(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("concept_id"), F.col("p_partkey").alias("symbol_id"))
    return search.sibling_implementations(members, _part_table(spark, sf_dir), _line_edges(spark, sf_dir))


def _neighbour_sql(here: str, there: str) -> str:
    return f"""SELECT symbol_id, CAST(place AS INTEGER) AS place, symbol, file, line FROM (SELECT e.{here} AS symbol_id, concat(o.p_brand, '.', o.p_name) AS symbol, o.p_type AS file, o.p_size AS line,
      row_number() OVER (PARTITION BY e.{here} ORDER BY o.p_type, o.p_size, o.p_partkey) AS place FROM (SELECT DISTINCT src, dst FROM ({_EDGE})) e
      JOIN part o ON o.p_partkey = e.{there} JOIN part w ON w.p_partkey = e.{here}) WHERE place <= 20"""


def _neighbours(spark, sf_dir, callers):
    s = _part_table(spark, sf_dir)
    rows = inspection.neighbours(s, _line_edges(spark, sf_dir, once=False), s, callers, once=True).select("symbol_id", F.posexplode("others").alias("place", "o"))
    return rows.select("symbol_id", (F.col("place") + 1).alias("place"), "o.symbol", "o.file", "o.line")


@_query(_neighbour_sql("dst", "src"))
def callers(spark, sf_dir):
    return _neighbours(spark, sf_dir, True)


@_query(_neighbour_sql("src", "dst"))
def callees(spark, sf_dir):
    return _neighbours(spark, sf_dir, False)


@_query("""WITH m AS (SELECT p_partkey, p_name, p_type, concat(p_brand, '/', p_size) AS concept, concat(p_brand, '.', p_name) AS q FROM part)
  SELECT a.p_partkey AS symbol_id, a.concept, string_agg(b.q, ',' ORDER BY b.p_type, b.p_name, b.p_partkey) AS siblings FROM m a LEFT JOIN m b ON a.concept = b.concept AND a.p_partkey <> b.p_partkey GROUP BY 1, 2""")
def concept_siblings(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select(F.xxhash64("p_brand", "p_size").alias("concept_id"), F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("name"), F.lit(None).cast("string").alias("role"), F.col("p_partkey").alias("symbol_id"))
    s = _part_table(spark, sf_dir)
    out = inspection.concept_siblings(s, p.select("concept_id", "name", "role").distinct(), p.select("concept_id", "symbol_id"), s, joined=",")
    return out.select("symbol_id", "concept", "siblings")


@_query("SELECT qualified_name FROM (SELECT concat(p_brand, '.', p_name) AS qualified_name FROM part) WHERE qualified_name ILIKE '%BRAND_1%' ORDER BY qualified_name LIMIT 20")
def find_candidates(spark, sf_dir):
    return inspection.find_candidates("BRAND_1", _part_table(spark, sf_dir))


# Symbols of three languages, their import statements and index occurrences; the same expressions run in both engines.
_LANGUAGE = "CASE p_partkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'java' ELSE 'go' END"
_N = "CAST({} AS STRING)".format
_CODE = {
    "symbol_id": "p_partkey", "language": _LANGUAGE, "path": f"concat(p_brand, '/f', {_N('p_partkey % 6')})",
    "name": f"CASE p_partkey % 3 WHEN 0 THEN concat('C', {_N('p_partkey % 300')}) WHEN 1 THEN concat('J', {_N('p_partkey % 301')}) ELSE concat('G', {_N('p_partkey % 299')}) END",
    "qualified_name": f"""CASE p_partkey % 3 WHEN 0 THEN concat('m', {_N('p_size')}, '.C', {_N('p_partkey % 300')}) WHEN 1 THEN
      CASE WHEN p_partkey % 5 = 1 THEN concat('J', {_N('p_partkey % 301')}) ELSE concat('com.p', {_N('p_size')}, '.J', {_N('p_partkey % 301')}) END ELSE concat('g', {_N('p_size')}, '.G', {_N('p_partkey % 299')}) END""",
    "kind": "CASE p_partkey % 3 WHEN 0 THEN 'class' WHEN 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'class' ELSE 'interface' END ELSE 'struct' END",
    "signature": f"""CASE p_partkey % 3 WHEN 0 THEN concat('class X(C', {_N('(p_partkey * 7) % 200')}, ', m', {_N('p_size')}, '.C', {_N('(p_partkey * 3) % 50')}, ', object)')
      WHEN 1 THEN concat('class X extends J', {_N('(p_partkey * 5) % 200')}, '<T> implements J', {_N('(p_partkey * 3) % 60')}, ', J', {_N('(p_partkey * 11) % 290')}) END""",
    "start_line": "CAST(p_partkey % 1000 AS INT)", "end_line": "CAST(p_partkey % 1000 + p_size AS INT)",
}
_IMPORTS = {
    "path": _CODE["path"], "language": _LANGUAGE,
    "module": f"""CASE p_partkey % 3 WHEN 0 THEN concat('m', {_N('(p_size * 3) % 50 + 1')}) WHEN 1 THEN concat('com.p', {_N('(p_size * 3) % 50 + 1')}, '.J', {_N('(p_partkey * 13) % 301')}) ELSE concat('g', {_N('(p_size * 7) % 60')}) END""",
    "name": f"CASE WHEN p_partkey % 12 IN (0, 3, 6) THEN concat('C', {_N('(p_partkey * 11) % 300')}) END",
}
_SEEN = {
    "path": _CODE["path"], "roles": "CAST(p_partkey % 4 AS INT)", "line": "CASE WHEN p_partkey % 11 <> 0 THEN CAST((p_partkey * 17) % 1000 AS INT) END",
    "symbol": f"CASE WHEN p_partkey % 13 = 0 THEN 'local 1' WHEN p_partkey % 17 = 0 THEN '' ELSE concat('scip-go go example.com/m v1 in/g', {_N('(p_size * 3) % 50 + 1')}, '/G', {_N('(p_partkey * 13) % 299')}, '#') END",
}


def _of_part(spark, sf_dir, columns: dict[str, str]) -> DataFrame:
    return _t(spark, sf_dir, "part").selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def _occurrences(spark, sf_dir) -> DataFrame:
    return _of_part(spark, sf_dir, _SEEN | {"language": _LANGUAGE}).filter("language = 'go'").drop("language")


_from_part = lambda columns: "SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + " FROM part"
_WITH = f"""WITH code AS ({_from_part(_CODE)}), imp AS ({_from_part(_IMPORTS)}),
  q AS (SELECT language, qualified_name AS key, symbol_id AS dst FROM (SELECT *, row_number() OVER (PARTITION BY language, qualified_name ORDER BY path DESC, start_line DESC, end_line DESC, symbol_id DESC) AS n FROM code) WHERE n = 1),
  sole AS (SELECT language, name AS key, min(symbol_id) AS dst FROM code GROUP BY ALL HAVING count(*) = 1),
  src AS (SELECT language, path, symbol_id AS src FROM (SELECT *, row_number() OVER (PARTITION BY language, path ORDER BY start_line, end_line, symbol_id) AS n FROM code) WHERE n = 1),
  bases AS (SELECT symbol_id AS src, language, unnest(CASE language WHEN 'java' THEN [concat('J', (symbol_id * 5) % 200), concat('J', (symbol_id * 3) % 60), concat('J', (symbol_id * 11) % 290)]
    WHEN 'python' THEN [concat('C', (symbol_id * 7) % 200), regexp_extract(qualified_name, '^[^.]*') || concat('.C', (symbol_id * 3) % 50)] ELSE [] END) AS key FROM code),
  inherit AS (SELECT b.language, b.src, coalesce(q.dst, (SELECT CASE WHEN count(*) = 1 THEN min(c.symbol_id) END FROM code c WHERE c.language = b.language AND c.name = b.key AND c.symbol_id <> b.src)) AS dst, 'inherit' AS kind
    FROM bases b LEFT JOIN q ON q.language = b.language AND q.key = b.key),
  named AS (SELECT imp.language, src.src, coalesce(q.dst, sole.dst) AS dst, 'import' AS kind FROM imp JOIN src ON src.language = imp.language AND src.path = imp.path
    LEFT JOIN q ON q.language = imp.language AND q.key = CASE imp.language WHEN 'java' THEN imp.module ELSE concat(imp.module, '.', imp.name) END
    LEFT JOIN sole ON sole.language = imp.language AND sole.key = CASE imp.language WHEN 'java' THEN regexp_extract(imp.module, '[^.]*$') ELSE imp.name END
    WHERE imp.language = 'java' OR imp.language = 'python' AND imp.name IS NOT NULL),
  below AS (SELECT language, regexp_extract(key, '^[^.]*') AS module, arg_min(dst, o) AS dst FROM (SELECT q.language, q.key, q.dst, (SELECT min((path, start_line, end_line, symbol_id)) FROM code c WHERE c.language = q.language AND c.qualified_name = q.key) AS o FROM q
    WHERE q.language = 'python') GROUP BY ALL),
  whole AS (SELECT imp.language, src.src, below.dst, 'import' AS kind FROM imp JOIN src ON src.language = imp.language AND src.path = imp.path JOIN below ON below.language = imp.language AND below.module = imp.module WHERE imp.name IS NULL),
  packages AS (SELECT regexp_extract(qualified_name, '^[^.]*') AS module, arg_min(symbol_id, (path, start_line, end_line, symbol_id)) AS dst FROM code WHERE language = 'go' GROUP BY 1),
  gone AS (SELECT 'go' AS language, src.src, packages.dst, 'import' AS kind FROM imp JOIN src ON src.language = imp.language AND src.path = imp.path JOIN packages ON packages.module = imp.module WHERE imp.language = 'go'),
  seen AS (SELECT path, roles, line + 1 AS line, regexp_replace(regexp_extract(symbol, '[^/]*/[^/]*$'), '/(.*)#', '.\\1') AS key FROM ({_from_part(_SEEN | {"language": _LANGUAGE})}) WHERE language = 'go' AND symbol <> '' AND symbol NOT LIKE 'local %' AND roles % 2 = 0 AND line IS NOT NULL),
  marks AS (SELECT path, start_line, max((end_line, symbol_id)) AS m FROM code WHERE language = 'go' GROUP BY ALL),
  used AS (SELECT 'go' AS language, CASE WHEN m[1] >= line THEN m[2] END AS src, q.dst, CASE WHEN roles >= 2 THEN 'import' ELSE 'call' END AS kind FROM seen ASOF JOIN marks ON seen.path = marks.path AND seen.line >= marks.start_line
    JOIN q ON q.language = 'go' AND q.key = seen.key)
  SELECT DISTINCT src AS src_symbol_id, dst AS dst_symbol_id, kind FROM ({{}}) WHERE src <> dst AND {{}}"""


@_query(_WITH.format("SELECT * FROM inherit", "language = 'java'"))
def java_inheritance(spark, sf_dir):
    return edges.java_inherit(_of_part(spark, sf_dir, _CODE)).distinct()


@_query(_WITH.format("SELECT * FROM named UNION ALL SELECT * FROM whole", "language = 'python'"))
def python_import_edges(spark, sf_dir):
    return edges.python_imports(_of_part(spark, sf_dir, _IMPORTS), _of_part(spark, sf_dir, _CODE)).distinct()


@_query(_WITH.format("SELECT * FROM named", "language = 'java'"))
def java_import_edges(spark, sf_dir):
    return edges.java_imports(_of_part(spark, sf_dir, _IMPORTS), _of_part(spark, sf_dir, _CODE)).distinct()


@_query(_WITH.format("SELECT * FROM gone", "true"))
def go_import_edges(spark, sf_dir):
    return edges.go_imports(_of_part(spark, sf_dir, _IMPORTS), _of_part(spark, sf_dir, _CODE)).distinct()


@_query(_WITH.format("SELECT * FROM used", "true"))
def index_occurrence_edges(spark, sf_dir):
    return edges.scip_edges(_occurrences(spark, sf_dir), _of_part(spark, sf_dir, _CODE), "go").distinct()


@_query(_WITH.format("SELECT * FROM inherit UNION ALL SELECT * FROM named UNION ALL SELECT * FROM whole UNION ALL SELECT * FROM used", "true"))
def edge_union_distinct(spark, sf_dir):
    """The whole graph: Go by its index's occurrences, the others by their import statements."""
    return edges.resolve(_of_part(spark, sf_dir, _CODE), _of_part(spark, sf_dir, _IMPORTS), {"go": _occurrences(spark, sf_dir)})


_ASKED_NAMES = ("Brand#13.cold widget", "Brand#5.small widget", "Brand#1.no such part")


@_query(f"""WITH f AS (SELECT min(p_partkey) AS id, concat(p_brand, '.', p_name) AS symbol FROM part WHERE concat(p_brand, '.', p_name) IN {_ASKED_NAMES} GROUP BY 2)
  SELECT symbol, p.p_type AS file, concat(p_size, '-', p_size + 3) AS lines, (SELECT least(20, count(DISTINCT src)) FROM ({_EDGE}) e JOIN part o ON o.p_partkey = e.src WHERE e.dst = f.id) AS callers,
  (SELECT least(20, count(DISTINCT dst)) FROM ({_EDGE}) e JOIN part o ON o.p_partkey = e.dst WHERE e.src = f.id) AS callees FROM f JOIN part p ON p.p_partkey = f.id""")
def inspect_symbols(spark, sf_dir):
    s = _part_table(spark, sf_dir).withColumns({"end_line": F.col("start_line") + 3, "signature": F.lit(None).cast("string"), "docstring": F.lit(None).cast("string")})
    concepts = spark.createDataFrame([], "concept_id long, name string, role string")
    e = _line_edges(spark, sf_dir).select("src_symbol_id", "dst_symbol_id").distinct()
    out = inspection.inspect_symbols(list(_ASKED_NAMES), s, e, concepts, spark.createDataFrame([], "concept_id long, symbol_id long"))
    return out.select("symbol", "file", "lines", F.size("callers").cast("long").alias("callers"), F.size("callees").cast("long").alias("callees"))


_CLASSES = """SELECT p_partkey AS id, concat('C', p_partkey % 1500) AS name, concat('m', p_size, '.C', p_partkey % 1500) AS qn, p_brand AS path,
  concat('class C', p_partkey % 1500, '(C', (p_partkey * 7) % 900, '[T], m', p_size, '.C', p_partkey % 50, ', object, )') AS sig FROM part"""


def _classes(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    num = lambda x: x.cast("string")
    sig = F.concat(F.lit("class C"), num(k % 1500), F.lit("(C"), num(k * 7 % 900), F.lit("[T], m"), s, F.lit(".C"), num(k % 50), F.lit(", object, )"))
    return p.select(k.alias("symbol_id"), F.concat(F.lit("C"), num(k % 1500)).alias("name"), F.concat(F.lit("m"), s, F.lit(".C"), num(k % 1500)).alias("qualified_name"), F.col("p_brand").alias("path"), k.alias("start_line"), k.alias("end_line"), sig.alias("signature"), F.lit("class").alias("kind"), F.lit("python").alias("language"))


@_query(f"""WITH c AS ({_CLASSES}), b AS (SELECT id, trim(unnest(string_split(regexp_extract(sig, '^class\\s+\\w+\\s*\\(([^)]*)\\)', 1), ','))) AS written FROM c),
  w AS (SELECT id, written, trim(regexp_replace(written, '[\\[(<].*$', '')) AS base FROM b WHERE written <> ''),
  q AS (SELECT qn, id AS dst FROM (SELECT *, row_number() OVER (PARTITION BY qn ORDER BY path DESC, id DESC) AS n FROM c) WHERE n = 1),
  r AS (SELECT w.id AS src, coalesce(q1.dst, q2.dst, (SELECT CASE WHEN count(*) = 1 THEN min(x.id) END FROM c x WHERE x.name = w.base AND x.id <> w.id)) AS dst
    FROM w LEFT JOIN q q1 ON q1.qn = w.written LEFT JOIN q q2 ON q2.qn = w.base WHERE base NOT IN ('', 'object', 'ABC', 'Protocol'))
  SELECT DISTINCT src AS src_symbol_id, dst AS dst_symbol_id, 'inherit' AS kind FROM r WHERE dst IS NOT NULL AND dst <> src""")
def qname_cascade_resolution(spark, sf_dir):
    return edges.python_inherit(_classes(spark, sf_dir)).distinct()


@_query(f"""WITH q AS (SELECT qn, min(concat(path, ' ', lpad(CAST(id AS VARCHAR), 12, '0'))) AS o, arg_max(id, concat(path, ' ', lpad(CAST(id AS VARCHAR), 12, '0'))) AS dst FROM ({_CLASSES}) GROUP BY qn)
  SELECT regexp_extract(qn, '^[^.]+', 0) AS prefix, arg_min(dst, o) AS dst FROM q GROUP BY 1""")
def prefix_import_resolution(spark, sf_dir):
    return edges.first_below_prefix(_classes(spark, sf_dir))


@_query(f"SELECT name AS key, min(id) AS dst FROM ({_CLASSES}) GROUP BY name HAVING count(*) = 1")
def unique_name_lookup(spark, sf_dir):
    return edges.unique_names(_classes(spark, sf_dir))


@_query(f"SELECT path, arg_min(id, id) AS src FROM ({_CLASSES}) GROUP BY path")
def first_symbol_per_file(spark, sf_dir):
    return edges.first_symbols(_classes(spark, sf_dir))


@_query("""WITH s AS (SELECT l_suppkey % 97 AS path, l_partkey AS line, max((CAST(l_partkey + l_quantity AS BIGINT), l_orderkey * 10 + l_linenumber)) AS s FROM lineitem GROUP BY 1, 2),
  p AS (SELECT o_orderkey AS probe, o_custkey % 97 AS path, CAST(floor(o_totalprice / 50) AS BIGINT) AS line FROM orders)
  SELECT p.probe, CASE WHEN s.s[1] >= p.line THEN s.s[2] END AS src FROM p ASOF LEFT JOIN s ON p.path = s.path AND p.line >= s.line""")
def containing_interval_asof(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 97).alias("path"), F.col("l_partkey").alias("start_line"), (F.col("l_partkey") + F.col("l_quantity")).cast("long").alias("end_line"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("symbol_id")
    )
    o = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 97).alias("path"), F.floor(F.col("o_totalprice") / 50).alias("line"), F.col("o_orderkey").alias("probe"))
    return edges.enclosing_symbols(li, o).select("probe", "src")


# ---- incremental maintenance

_SNAP = "SELECT p_partkey, concat(p_brand, '/', p_partkey, '.py') AS path, {h} AS h FROM part WHERE p_partkey % {m} <> 0"
_OLD, _NEW = _SNAP.format(h="p_brand", m=10), _SNAP.format(h="CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE p_brand END", m=7)


def _snapshots(spark, sf_dir):
    p = _t(spark, sf_dir, "part").withColumn("path", F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".py")))
    return p.filter("p_partkey % 10 <> 0").withColumn("content_hash", F.col("p_brand")), p.filter("p_partkey % 7 <> 0").withColumn("content_hash", F.expr("CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE p_brand END"))


@_query(f"""SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'DELETE' WHEN o.path IS NULL THEN 'INSERT' WHEN o.h = n.h THEN 'KEEP' ELSE 'REPLACE' END AS action
  FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.path = n.path""")
def file_diff(spark, sf_dir):
    return diff.file_changes(*_snapshots(spark, sf_dir)).select("path", "action")


@_query(f"""SELECT coalesce(o.p_partkey, n.p_partkey) AS symbol_id, CASE WHEN n.path IS NULL THEN 'DELETE' WHEN o.path IS NULL THEN 'INSERT' WHEN o.h <> n.h THEN 'REPLACE'
  WHEN n.p_partkey % 3 = 0 THEN 'MOVE' ELSE 'KEEP' END AS action FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.path = n.path""")
def symbol_diff(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    shape = lambda df, shift: df.select(F.col("p_partkey").alias("symbol_id"), "path", F.col("p_name").alias("qualified_name"), F.lit(None).cast("string").alias("signature"), F.lit(1).alias("ordinal"), "content_hash", shift.alias("start_line"), shift.alias("end_line"))
    return diff.symbol_changes(shape(old, F.lit(1)), shape(new, F.when(F.col("p_partkey") % 3 == 0, 2).otherwise(1)))


@_query(f"""SELECT e.src AS src_symbol_id, e.dst AS dst_symbol_id, e.kind FROM ({_EDGE}) e WHERE e.src IN (SELECT p_partkey FROM ({_NEW})) AND e.dst IN (SELECT p_partkey FROM ({_NEW}))""")
def cascade_surviving_edges(spark, sf_dir):
    alive = _snapshots(spark, sf_dir)[1].select(F.col("p_partkey").alias("symbol_id"))
    return diff.surviving_edges(_line_edges(spark, sf_dir), alive)


@_query("""WITH c AS (SELECT label, count(*) AS member_count, sha256(string_agg(sha256(CAST(vec_id AS VARCHAR)), '' ORDER BY sha256(CAST(vec_id AS VARCHAR)))) AS member_hash FROM embeddings GROUP BY label)
  SELECT CAST(label % 3 AS VARCHAR) AS package, CAST(member_count AS INTEGER) AS member_count, member_hash, CASE WHEN label % 2 = 0 THEN concat('name of ', label) END AS name, CASE WHEN label % 2 = 0 THEN 'interface' END AS role FROM c""")
def label_reuse_by_member_hash(spark, sf_dir):
    """Every second concept of a run before had a name; a concept of the same members takes it over."""
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("symbol_id"), (F.col("label") % 3).cast("string").alias("package"), "label", "embedding", F.sha2(F.col("vec_id").cast("string"), 256).alias("content_hash"))
    old = e.groupBy("label").agg(text.member_hash(F.col("content_hash")).alias("member_hash"))
    name = F.when(F.col("label") % 2 == 0, F.concat(F.lit("name of "), F.col("label").cast("string")))
    old = old.select(F.col("label").cast("long").alias("concept_id"), "member_hash", name.alias("name"), F.lit("kept").alias("description"), F.lit("interface").alias("role"))
    concepts, _ = cluster.build_concepts(e.select("symbol_id", "package", "label"), e, e, old)
    return concepts.select("package", "member_count", "member_hash", "name", "role")


# ---- names, signatures, replies

_GO = """SELECT p_partkey AS id, concat(CASE WHEN p_partkey % 11 = 0 THEN 'local ' ELSE 'scip-go go example.com/m ' END, 'v1 ', CASE p_partkey % 5 WHEN 0 THEN concat('in/pkg', p_size, '/Do', p_partkey, '().')
  WHEN 1 THEN concat('in/pkg', p_size, '/Svc#Run(x).') WHEN 2 THEN concat('pkg', p_size, '/Svc#') WHEN 3 THEN 'NoSlash.' ELSE concat('a/b/pkg', p_size, '/') END) AS s FROM part"""


@_query(f"""WITH d AS (SELECT id, CASE WHEN s NOT LIKE 'local %' AND len(string_split(s, ' ')) >= 5 THEN regexp_replace(rtrim(array_to_string(string_split(s, ' ')[5:], ' '), '.'), '\\([^)]*\\)$', '') END AS d FROM ({_GO})),
  x AS (SELECT id, d, string_split(d, '/')[-1] AS rest, CASE WHEN d LIKE '%/%' THEN string_split(d, '/')[-2] END AS pkg FROM d)
  SELECT id, CASE WHEN d LIKE '%/%' THEN CASE WHEN d LIKE '%#%' THEN CASE WHEN string_split(rest, '#')[2] <> '' THEN concat(pkg, '.', string_split(rest, '#')[1], '.', string_split(rest, '#')[2])
    ELSE concat(pkg, '.', string_split(rest, '#')[1]) END WHEN rest <> '' THEN concat(pkg, '.', rest) END END AS qualified_name FROM x""")
def scip_qname_go(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    desc = (
        F.when(k % 5 == 0, F.concat(F.lit("in/pkg"), s, F.lit("/Do"), k.cast("string"), F.lit("()."))).when(k % 5 == 1, F.concat(F.lit("in/pkg"), s, F.lit("/Svc#Run(x).")))
        .when(k % 5 == 2, F.concat(F.lit("pkg"), s, F.lit("/Svc#"))).when(k % 5 == 3, "NoSlash.").otherwise(F.concat(F.lit("a/b/pkg"), s, F.lit("/")))
    )
    symbol = F.concat(F.when(k % 11 == 0, "local ").otherwise("scip-go go example.com/m "), F.lit("v1 "), desc)
    return _t(spark, sf_dir, "part").select(k.alias("id"), names.go_name(symbol).alias("qualified_name"))


_PY_DESC = ["`m.a{0}`/run().", "`m.a{0}`/Base#run().", "`m.a{0}`/Base#", "`m.a{0}`/__init__:", "`m.a{0}`/run().(arg)", "plain{0}", "`m.a{0}`/LIMIT."]
_PY_WANT = ["'m.a' || p_size || '.run'", "'m.a' || p_size || '.Base.run'", "'m.a' || p_size || '.Base'", "NULL", "NULL", "NULL", "'m.a' || p_size || '.LIMIT'"]


@_query("SELECT p_partkey AS id, CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(_PY_WANT)) + " END AS qualified_name FROM part")
def scip_qname_python(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    desc = F.replace(F.element_at(F.lit(_PY_DESC), (k % 7 + 1).cast("int")), F.lit("{0}"), s)
    return _t(spark, sf_dir, "part").select(k.alias("id"), names.python_name(F.concat(F.lit("scip-python python p 1 "), desc)).alias("qualified_name"))


@_query("""SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN concat('com.p', p_size, '.Foo.run') WHEN 1 THEN concat('com.p', p_size, '.Foo') END AS qualified_name FROM part""")
def scip_qname_java(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    desc = F.when(k % 3 == 0, F.concat(F.lit("scip-java java p 1 com/p"), s, F.lit("/Foo#run(+1)."))).when(k % 3 == 1, F.concat(F.lit("scip-java java p 1 com/p"), s, F.lit("/Foo#"))).otherwise("too short")
    return _t(spark, sf_dir, "part").select(k.alias("id"), names.java_name(desc).alias("qualified_name"))


@_query(f"SELECT id, trim(regexp_replace(b, '[\\[(<].*$', '')) AS base, b AS written FROM (SELECT id, trim(unnest(string_split(regexp_extract(sig, '^class\\s+\\w+\\s*\\(([^)]*)\\)', 1), ','))) AS b FROM ({_CLASSES})) WHERE b <> ''")
def parse_bases(spark, sf_dir):
    rows = _classes(spark, sf_dir).select(F.col("symbol_id").alias("id"), F.explode(names.python_bases(F.col("signature"))).alias("written"))
    return rows.select("id", names.clean_base(F.col("written")).alias("base"), "written")


@_query("""SELECT p_partkey AS id, unnest(CASE p_partkey % 3 WHEN 0 THEN [concat('B', p_size), 'Sized', 'Map', 'V>'] WHEN 1 THEN ['Sized'] ELSE CAST([] AS VARCHAR[]) END) AS base FROM part""")
def java_supertypes(spark, sf_dir):
    k = F.col("p_partkey")
    sig = F.when(k % 3 == 0, F.concat(F.lit("class A extends B"), F.col("p_size").cast("string"), F.lit("<T> implements Sized, Map<K, V>"))).when(k % 3 == 1, "class A implements Sized").otherwise("class A")
    # a comma inside type arguments also splits, as in the original
    return _t(spark, sf_dir, "part").select(k.alias("id"), F.explode(names.java_supertypes(sig)).alias("base"))


_REPLY = """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN concat('{"name": "', p_name, '", "description": "', p_type, '", "role": "interface"}') WHEN 1 THEN '{"name": "x", "role": "wizard"}'
  WHEN 2 THEN 'not json at all' WHEN 3 THEN '[1, 2]' END AS reply FROM part"""


@_query(f"""SELECT id AS concept_id, CASE WHEN ok THEN substr(coalesce(reply ->> '$.name', ''), 1, 120) END AS name, CASE WHEN ok THEN substr(coalesce(reply ->> '$.description', ''), 1, 500) END AS description,
  CASE WHEN ok AND (reply ->> '$.role') IN ('interface', 'implementation', 'orchestrator', 'entry_point', 'domain_model', 'infrastructure', 'cross_cutting') THEN reply ->> '$.role' END AS role
  FROM (SELECT id, CASE WHEN json_valid(reply) THEN reply END AS reply, coalesce(json_valid(reply) AND reply LIKE '{{%', false) AS ok FROM ({_REPLY}))""")
def llm_json_validate(spark, sf_dir):
    k = F.col("p_partkey")
    full = F.concat(F.lit('{"name": "'), "p_name", F.lit('", "description": "'), "p_type", F.lit('", "role": "interface"}'))
    reply = F.when(k % 5 == 0, full).when(k % 5 == 1, '{"name": "x", "role": "wizard"}').when(k % 5 == 2, "not json at all").when(k % 5 == 3, "[1, 2]")
    return enrich.parse_labels(_t(spark, sf_dir, "part").select(k.alias("concept_id"), reply.alias("reply")))


@_query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS DOUBLE) / 64 WHEN 1 THEN 0.25 ELSE -1.0 END AS score FROM part""")
def rerank_parse_score(spark, sf_dir):
    k = F.col("p_partkey")
    reply = F.when(k % 4 == 0, F.concat((F.col("p_size") / 64).cast("string"), F.lit(" or so"))).when(k % 4 == 1, "  0.25\n").when(k % 4 == 2, "hard to say")
    return _t(spark, sf_dir, "part").select(k.alias("id"), text.parsed_score(reply, F.lit(-1.0)).alias("score"))


@_query("""SELECT l_partkey AS concept_id, max(l_discount) AS score, CAST(arg_max(l_linenumber, (l_discount, -l_linenumber)) AS INTEGER) AS iteration FROM lineitem GROUP BY l_partkey""")
def agentic_max_merge(spark, sf_dir):
    found = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("concept_id"), F.col("l_linenumber").alias("step")).agg(F.max("l_discount").alias("score"))
    return search.merge_best(found).select("concept_id", "score", F.col("step").cast("int").alias("iteration"))


_CASES = f"""SELECT label, (SELECT list(CAST(vec_id AS VARCHAR) ORDER BY vec_id) FROM embeddings x WHERE x.label = m.label AND vec_id % 3 = 0) AS expected, list(CAST(vec_id AS VARCHAR) ORDER BY d, vec_id) AS got FROM ({_MEMBERS}) m GROUP BY label"""
_RECALL = f"""SELECT CAST(label AS VARCHAR) AS fixture, k, CASE WHEN expected IS NULL THEN 1.0 ELSE round(len(list_intersect(expected, got[1:k])) / CAST(len(expected) AS DOUBLE), 4) END AS recall FROM ({_CASES}), (SELECT unnest([1, 3, 5, 10]) AS k)"""


def _recalls(spark, sf_dir):
    m = _members(spark, sf_dir)
    name = F.col("symbol_id").cast("string")
    got = m.groupBy("concept_id").agg(F.array_sort(F.collect_list(F.struct("distance_to_centroid", "symbol_id"))).alias("g"), F.collect_list(F.when(F.col("symbol_id") % 3 == 0, name)).alias("expected"))
    got = got.select(F.col("concept_id").cast("string").alias("fixture"), "expected", F.transform("g", lambda x: x["symbol_id"].cast("string")).alias("got"))
    cases = got.select("fixture", F.col("expected").alias("expected_files"), F.col("expected").alias("expected_symbols"), F.col("got").alias("files"), F.col("got").alias("symbols"))
    return evaluate.recalls(cases, [1, 3, 5, 10])


@_query(_RECALL)
def recall_at_k(spark, sf_dir):
    return _recalls(spark, sf_dir).select("fixture", "k", F.round("file_recall", ROUND).alias("recall"))


@_query(f"SELECT k, round(avg(recall), 3) AS recall FROM ({_RECALL.replace('round(len(', '(len(').replace(', 4) END', ') END')}) GROUP BY k")
def macro_recall(spark, sf_dir):
    return evaluate.macro_average(_recalls(spark, sf_dir)).select("k", F.round("file_recall", 3).alias("recall"))


@_query("SELECT CASE WHEN (l_linenumber & 2) <> 0 THEN 'import' ELSE 'call' END AS kind, count(*) AS edges FROM lineitem WHERE (l_linenumber & 1) = 0 GROUP BY 1")
def role_flags_bitmask(spark, sf_dir):
    roles = F.col("l_linenumber")
    rows = _t(spark, sf_dir, "lineitem").filter(edges.is_use(roles)).select(edges.role_kind(roles).alias("kind"))
    return rows.groupBy("kind").agg(F.count("*").alias("edges"))


@_query(f"""SELECT symbol_id, concat('- ', coalesce(nullif(qn, ''), name), ' (class): ', coalesce(nullif(sig, ''), name), CASE WHEN doc <> '' THEN concat(' — ', replace(substr(doc, 1, 120), chr(10), ' ')) ELSE '' END) AS line FROM ({_PART_SYMBOL})""")
def label_prompt_lines(spark, sf_dir):
    s = _part_symbols(spark, sf_dir)
    return s.select("symbol_id", enrich.member_line(F.col("qn"), F.col("name"), F.lit("class"), F.col("sig"), F.col("doc")).alias("line"))


@_query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE concat('concept_', p_partkey) END AS label, concat(p_size, '-', p_size + 3) AS lines, string_split(p_type, ' ')[-1] AS last FROM part")
def display_fields(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"), text.concept_label(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).when(F.col("p_size") % 3 == 0, ""), F.col("p_partkey")).alias("label"),
        F.concat_ws("-", F.col("p_size").cast("string"), (F.col("p_size") + 3).cast("string")).alias("lines"), text.last_part(F.translate("p_type", " ", ".")).alias("last"),
    )


@_query("SELECT source, count(*) AS concepts, count(CASE WHEN doc_id % 3 = 0 THEN 1 END) AS reused, count(DISTINCT lang) AS packages FROM documents GROUP BY source")
def index_counters(spark, sf_dir):
    concepts = _t(spark, sf_dir, "documents").select("source", F.when(F.col("doc_id") % 3 == 0, "known").alias("name"), F.col("lang").alias("package"))
    return concepts.groupBy("source").agg(*cluster.counters())


# ---- table functions


#: A source file in each language (@: the part's number, ~: its name), and its symbols: name, qualified name (^: the file's module), kind, signature, lines, whether documented.
_BODIES = {
    "python": "class C@(Base):\n    '''~'''\n    def run(self, x):\n        return x\n\ndef free@(a, *, b=1) -> int:\n    return a\n",
    "go": "package p\n\n// ~\ntype T@ struct {\n\tx int\n}\n\nfunc (t *T@) Run(x int) int { return x }\n\ntype I@ interface {\n\tRun(x int) int\n}\n",
    "java": "package p;\n/** ~ */\nclass J@ extends Base {\n  J@(int y) {}\n  int run(int x) { return x; }\n}\nenum E@ { A, B }\n",
    "kotlin": "package p\n/** ~ */\nclass K@(val x: Int) : Base() {\n  fun run(y: Int): Int = y\n}\nobject O@\n",
    "gleam": "/// ~\npub fn run@(x: Int) -> Int {\n  x\n}\npub type T@ {\n  A\n}\n",
    "erlang": "-module(m).\n%% ~\nrun@(X) -> X.\n-record(r@, {a}).\n",
}
_FOUND = {
    "python": [("C@", "^.C@", "class", "class C@(Base)", 1, 4, 1), ("run", "^.C@.run", "method", "def run(self, x)", 3, 4, 0), ("free@", "^.free@", "function", "def free@(a, *, b=1)", 6, 7, 0)],
    "go": [("T@", "p.T@", "struct", "type T@ struct", 4, 6, 1), ("Run", "p.T@.Run", "method", "func (t *T@) Run(x int)", 8, 8, 0), ("I@", "p.I@", "interface", "type I@ interface", 10, 12, 0)],
    "java": [
        ("J@", "p.J@", "class", "class J@ extends Base", 3, 6, 1), ("J@", "p.J@.J@", "constructor", "J@(int y)", 4, 4, 0), ("run", "p.J@.run", "method", "int run(int x)", 5, 5, 0),
        ("E@", "p.E@", "enum", "enum E@", 7, 7, 0), ("A", "p.E@.A", "enum_constant", "A", 7, 7, 0), ("B", "p.E@.B", "enum_constant", "B", 7, 7, 0),
    ],
    "kotlin": [("K@", "p.K@", "class", "class K@(val x: Int) : Base()", 3, 5, 1), ("run", "p.K@.run", "method", "fun run(y: Int): Int", 4, 4, 0), ("O@", "p.O@", "class", "object O@", 6, 6, 0)],
    "gleam": [("run@", "^.run@", "function", "pub fn run@(x: Int) -> Int", 2, 4, 1), ("T@", "^.T@", "enum", "pub type T@", 5, 7, 0)],
    "erlang": [("run@", "^.run@", "function", "run@(X)", 3, 3, 1), ("r@", "^.r@", "record", "-record(r@, ...)", 4, 4, 0)],
}


def _sources(spark, sf_dir):
    """A source file for each part, in the six languages."""
    p = spread(_t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name"), "p_partkey")  # a row group of parts is one task's; as files they are a lot of work
    n = F.col("p_partkey").cast("string")
    at = lambda template: F.concat(*[x for i, t in enumerate(template.split("@")) for x in ((n, F.lit(t)) if i else (F.lit(t),))])
    bodies = {k: F.replace(at(v), F.lit("~"), F.col("p_name")) for k, v in _BODIES.items()}
    languages = list(bodies)
    language = F.element_at(F.lit(languages), (F.col("p_partkey") % len(languages) + 1).cast("int"))
    content = F.coalesce(*[F.when(language == k, v) for k, v in bodies.items()]).cast("binary")
    return p.select(F.xxhash64("p_partkey").alias("file_id"), F.concat(F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""), F.lit("/f"), n).alias("path"), language.alias("language"), content.alias("content"))


_FOUND_SQL = ", ".join(f"('{lang}', {i}, '{name}', '{qn}', '{kind}', '{sig}', {lo}, {hi}, {doc})" for i, (lang, rows) in enumerate(_FOUND.items()) for name, qn, kind, sig, lo, hi, doc in rows)


@_query(f"""SELECT path, language, replace(name, '@', n) AS name, replace(replace(qn, '@', n), '^', replace(path, '/', '.')) AS qualified_name, kind, replace(sig, '@', n) AS signature, lo AS start_line, hi AS end_line,
  CASE WHEN doc = 1 THEN p_name END AS docstring FROM (SELECT *, CAST(p_partkey AS VARCHAR) AS n, concat(regexp_replace(p_brand, '[^A-Za-z0-9]', ''), '/f', p_partkey) AS path FROM part)
  JOIN (VALUES {_FOUND_SQL}) AS t(language, nth, name, qn, kind, sig, lo, hi, doc) ON p_partkey % 6 = nth""")
def extract_symbols(spark, sf_dir):
    return extract.extract_symbols(_sources(spark, sf_dir)).select("path", "language", "name", "qualified_name", "kind", "signature", "start_line", "end_line", "docstring")


@_query("""SELECT concat(regexp_replace(p_brand, '[^A-Za-z0-9]', ''), '/f', p_partkey) AS path,
  concat('class C', p_partkey, '(Base):', chr(10), '    ''''''', p_name, '''''''', chr(10), '    def run(self, x):', chr(10), '        ...', chr(10), chr(10), 'def free', p_partkey, '(a, *, b=1) -> int:', chr(10), '    return a') AS skeleton
  FROM part WHERE p_partkey % 6 = 0""")
def class_skeletons(spark, sf_dir):
    @F.pandas_udf("string")
    def bare(source):
        return source.map(lambda s: skeleton("python", s, "class"))

    rows = _sources(spark, sf_dir).filter("language = 'python'")
    return rows.select("path", bare(F.col("content").cast("string")).alias("skeleton"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
