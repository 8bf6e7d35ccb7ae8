"""Reference edges between symbols, as joins.

Lookups follow the scan order (path, start_line, end_line, id): where the key is
not unique, the last symbol of a qualified name and the first of a package or
prefix counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.text import first_part, last_part

ORDER = ("path", "start_line", "end_line", "symbol_id")
_NOT_BASES = ("object", "ABC", "Protocol")
STRETCH = 4096


def _order() -> Column:
    return F.struct(*ORDER)


def by_qualified_name(symbols: DataFrame) -> DataFrame:
    """key, dst: the last symbol of each qualified name."""
    named = symbols.filter(F.col("qualified_name").isNotNull() & (F.col("qualified_name") != ""))
    return named.groupBy(F.col("qualified_name").alias("key")).agg(F.max_by("symbol_id", _order()).alias("dst"))


def unique_names(symbols: DataFrame) -> DataFrame:
    """key, dst: names that exactly one symbol has."""
    return symbols.groupBy(F.col("name").alias("key")).agg(F.count("*").alias("n"), F.min("symbol_id").alias("dst")).filter("n = 1").select("key", "dst")


def names_but_self(symbols: DataFrame) -> DataFrame:
    """key, low, high, n of the symbols of each name: tells the only other one from any of them."""
    return symbols.groupBy(F.col("name").alias("key")).agg(F.min("symbol_id").alias("low"), F.max("symbol_id").alias("high"), F.count("*").alias("n"))


def _only_other(src: Column) -> Column:
    alone = F.when((F.col("n") == 1) & (F.col("low") != src), F.col("low"))
    return F.when((F.col("n") == 2) & (F.col("low") == src), F.col("high")).when((F.col("n") == 2) & (F.col("high") == src), F.col("low")).otherwise(alone)


def first_symbols(symbols: DataFrame) -> DataFrame:
    """path, src: the first symbol of each file, which stands for it as an importer."""
    return symbols.groupBy("path").agg(F.min_by("symbol_id", F.struct("start_line", "end_line", "symbol_id")).alias("src"))


def _edges(found: DataFrame, kind: Column) -> DataFrame:
    pairs = found.filter(F.col("dst").isNotNull() & (F.col("dst") != F.col("src")))
    return pairs.select(F.col("src").alias("src_symbol_id"), F.col("dst").alias("dst_symbol_id"), kind.alias("kind"))


def _inherit(bases: DataFrame, symbols: DataFrame, tries: tuple[str, ...], sole: str) -> DataFrame:
    """bases: src and key columns; qualified names are tried in turn, then the only other symbol of a name."""
    lookup = by_qualified_name(symbols)
    for i, t in enumerate(tries):
        bases = bases.join(lookup.select(F.col("key").alias(t), F.col("dst").alias(f"d{i}")), t, "left")
    bases = bases.join(names_but_self(symbols).withColumnRenamed("key", sole), sole, "left")
    dst = F.coalesce(*[F.col(f"d{i}") for i in range(len(tries))], _only_other(F.col("src")))
    return _edges(bases.withColumn("dst", dst), F.lit("inherit"))


def python_inherit(symbols: DataFrame, all_languages: bool = False) -> DataFrame:
    """Bases of classes: as written, without arguments, then by unique name.  ``all_languages`` looks among symbols of any language."""
    scope = symbols if all_languages else symbols.filter(F.col("language") == "python")
    classes = scope.filter(F.col("kind") == "class").select(F.col("symbol_id").alias("src"), F.explode(names.python_bases(F.coalesce("signature", F.lit("")))).alias("written"))
    classes = classes.withColumn("base", names.clean_base(F.col("written"))).filter((F.col("base") != "") & ~F.col("base").isin(list(_NOT_BASES)))
    return _inherit(classes, scope, ("written", "base"), "base")


def java_inherit(symbols: DataFrame) -> DataFrame:
    scope = symbols.filter(F.col("language") == "java")
    types = scope.filter(F.col("kind").isin("class", "interface")).select(F.col("symbol_id").alias("src"), F.explode(names.java_supertypes(F.coalesce("signature", F.lit("")))).alias("base"))
    return _inherit(types, scope, ("base",), "base")


def _importers(imports: DataFrame, symbols: DataFrame, language: str) -> tuple[DataFrame, DataFrame]:
    scope = symbols.filter(F.col("language") == language)
    return imports.filter(F.col("language") == language).join(first_symbols(scope), "path"), scope


def python_imports(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """from m import n: m.n, else the only symbol named n.  import a.b: the first symbol below a.b."""
    rows, scope = _importers(imports, symbols, "python")
    named = rows.filter(F.col("name").isNotNull()).withColumn("key", F.concat_ws(".", "module", "name"))
    named = named.join(by_qualified_name(scope), "key", "left").join(unique_names(scope).select(F.col("key").alias("name"), F.col("dst").alias("sole")), "name", "left")
    named = named.select("src", F.coalesce("dst", "sole").alias("dst"))
    whole = rows.filter(F.col("name").isNull()).join(first_below_prefix(scope), F.col("module") == F.col("prefix")).select("src", "dst")
    return _edges(named.unionByName(whole), F.lit("import"))


def first_below_prefix(symbols: DataFrame) -> DataFrame:
    """prefix, dst: for each dotted prefix of a qualified name, the first symbol strictly below it.

    Qualified names are spread over their prefixes, which turns a prefix search into an equality join."""
    seen = symbols.filter(F.col("qualified_name").isNotNull()).groupBy("qualified_name").agg(F.min(_order()).alias("o"), F.max_by("symbol_id", _order()).alias("dst"))
    parts = F.split("qualified_name", r"\.")
    spread = seen.filter(F.size(parts) > 1).withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "."))))
    return spread.groupBy("prefix").agg(F.min_by("dst", "o").alias("dst"))


def java_imports(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    rows, scope = _importers(imports, symbols, "java")
    rows = rows.withColumn("key", F.col("module")).join(by_qualified_name(scope), "key", "left")
    sole = unique_names(scope).select(F.col("key").alias("last"), F.col("dst").alias("sole"))
    rows = rows.withColumn("last", last_part(F.col("module"))).join(sole, "last", "left")
    return _edges(rows.select("src", F.coalesce("dst", "sole").alias("dst")), F.lit("import"))


def go_imports(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    rows, scope = _importers(imports, symbols, "go")
    package = scope.filter(F.col("qualified_name").isNotNull()).groupBy(first_part(F.col("qualified_name")).alias("module")).agg(F.min_by("symbol_id", _order()).alias("dst"))
    return _edges(rows.join(package, "module").select("src", "dst"), F.lit("import"))


def enclosing_symbols(symbols: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (path, line, ...) with src: the symbol with the greatest (start, end, id)
    that starts at or before the line, if it also ends at or after it; else null.

    One sort by file and line, no range join.  Files are cut into stretches of STRETCH
    lines, each of which takes over the last symbol that starts in one before, so
    that a very long file isn't one task's."""
    extra = [c for c in probes.columns if c not in ("path", "line")]
    none = [F.lit(None).cast(dict(probes.dtypes)[c]).alias(c) for c in extra]
    marks = symbols.groupBy("path", F.col("start_line").alias("line")).agg(F.max(F.struct("end_line", "symbol_id")).alias("_s"))
    both = marks.select("path", F.col("line").cast("long").alias("line"), "_s", F.lit(0).alias("_probe"), *none).unionByName(
        probes.select("path", F.col("line").cast("long").alias("line"), F.lit(None).cast(marks.schema["_s"].dataType).alias("_s"), F.lit(1).alias("_probe"), *extra)
    )
    both = both.withColumn("_part", F.floor(F.col("line") / STRETCH))
    ends = both.filter("_s is not null").groupBy("path", "_part").agg(F.max_by("_s", "line").alias("_end"))
    # the last symbol of all stretches before; stretches without a symbol ask too
    asked = both.select("path", "_part").distinct().join(ends, ["path", "_part"], "left")
    carry = F.last("_end", ignorenulls=True).over(Window.partitionBy("path").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    both = both.join(asked.select("path", "_part", carry.alias("_carry")), ["path", "_part"])
    last = F.last("_s", ignorenulls=True).over(Window.partitionBy("path", "_part").orderBy("line", "_probe").rowsBetween(Window.unboundedPreceding, 0))
    hit = both.withColumn("_hit", F.coalesce(last, "_carry")).filter("_probe = 1")
    return hit.select("path", "line", *extra, F.when(F.col("_hit.end_line") >= F.col("line"), F.col("_hit.symbol_id")).alias("src"))


_TO_NAME = {"go": names.go_name, "python": names.python_name, "java": names.java_name}


def is_use(roles: Column) -> Column:
    """Whether an occurrence isn't a definition."""
    return roles.bitwiseAND(1) == 0


def role_kind(roles: Column) -> Column:
    return F.when(roles.bitwiseAND(2) != 0, "import").otherwise("call")


def scip_edges(occurrences: DataFrame, symbols: DataFrame, language: str) -> DataFrame:
    """Edges from decoded index occurrences (path, symbol, roles, line from 0; null line: no range)."""
    scope = symbols.filter(F.col("language") == language)
    used = occurrences.filter((F.col("symbol") != "") & ~F.startswith("symbol", F.lit("local ")) & is_use(F.col("roles")) & F.col("line").isNotNull())
    used = used.select("path", (F.col("line") + 1).alias("line"), _TO_NAME[language](F.col("symbol")).alias("key"), role_kind(F.col("roles")).alias("kind"))
    found = enclosing_symbols(scope, used).filter(F.col("src").isNotNull()).join(by_qualified_name(scope), "key")
    return _edges(found, F.col("kind"))


def resolve(symbols: DataFrame, imports: DataFrame | None = None, occurrences: dict[str, DataFrame] | None = None, all_languages: bool = False) -> DataFrame:
    """All edges, distinct: inheritance always; for each language either its index's occurrences or its import statements."""
    occurrences = occurrences or {}
    parts = [python_inherit(symbols, all_languages), java_inherit(symbols)]
    for language, by_imports in (("python", python_imports), ("java", java_imports), ("go", go_imports)):
        if language in occurrences:
            parts.append(scip_edges(occurrences[language], symbols, language))
        elif imports is not None:
            parts.append(by_imports(imports, symbols))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["src_symbol_id", "dst_symbol_id", "kind"])
