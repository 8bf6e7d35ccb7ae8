"""What queries shuffle, hold and deal out, on tables where more than that would show."""

from pyspark.sql import functions as F

from stratalens.operators import inspection
from stratalens.plans import catalogue


def nodes(plan):
    """A run plan's nodes, those of its stages among them."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from nodes(plan.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from nodes(plan.plan())
    else:
        yield kind, plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))


def ran(df):
    """Its rows, and (kind, rows out) of the plan's nodes that count them."""
    rows = df.collect()
    counted = [(kind, p.metrics().get("numOutputRows")) for kind, p in nodes(df._jdf.queryExecution().executedPlan())]
    return rows, [(kind, m.get().value()) for kind, m in counted if m.isDefined()]


def test_concept_siblings_list_members_once(spark):
    """60 members of one concept are 3,540 pairs."""
    ids = spark.range(60)
    symbols = ids.select(F.col("id").alias("symbol_id"), F.concat(F.lit("f"), (F.col("id") % 7).cast("string")).alias("path"), F.lit("n").alias("name"), F.concat(F.lit("\u00e9"), F.col("id").cast("string")).alias("qualified_name"), F.lit("class").alias("kind"))
    concepts = spark.createDataFrame([(1, "c", "role")], "concept_id long, name string, role string")
    members = ids.select(F.lit(1).cast("long").alias("concept_id"), F.col("id").alias("symbol_id"))
    order = sorted(range(60), key=lambda i: (i % 7, i))
    for joined in (None, ", "):
        rows, counted = ran(inspection.concept_siblings(symbols, concepts, members, symbols, **({"joined": joined} if joined else {})))
        got = {r.symbol_id: r.siblings if joined else [s.qualified_name for s in r.siblings] for r in rows}
        want = {i: [f"\u00e9{o}" for o in order if o != i] for i in range(60)}
        assert got == {i: joined.join(w) if joined else w for i, w in want.items()}
        assert max(n for _, n in counted) <= 60


def test_concept_siblings_of_odd_members(spark):
    """Several concepts of a name, members of two, members that are no symbols, names that are null, concepts of one and without a name."""
    symbols = spark.createDataFrame([(1, "b", "x", "q1", "k"), (2, "a", "x", None, "k"), (3, "a", "w", "q3", "k"), (4, "c", "x", "q4", "k"), (5, "c", "x", "q5", "k"), (6, "d", "x", None, "k"), (7, "d", "y", "q7", "k")], "symbol_id long, path string, name string, qualified_name string, kind string")
    concepts = spark.createDataFrame([(1, "c", "r"), (2, "c", "s"), (3, "sole", None), (4, None, "r"), (5, "d", "r"), (6, "gone", "r")], "concept_id long, name string, role string")
    members = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 1), (1, 99), (3, 4), (4, 5), (5, 6), (5, 1), (6, 7), (6, 98)], "concept_id long, symbol_id long")
    wanted = symbols.filter("symbol_id <> 2")
    plain = inspection.concept_siblings(wanted, concepts, members, symbols).collect()
    assert {r.symbol_id: (r.concept, r.role, r.siblings and [(s.qualified_name, s.kind, s.file) for s in r.siblings]) for r in plain} == {
        1: ("c", "r", [("q3", "k", "a"), (None, "k", "a")]), 3: ("c", "s", [(None, "k", "a"), ("q1", "k", "b")]),
        4: ("sole", None, None), 5: (None, "r", None), 6: ("d", "r", [("q1", "k", "b")]), 7: ("gone", "r", None),
    }
    joined = inspection.concept_siblings(wanted, concepts, members, symbols, joined=",").collect()
    assert {r.symbol_id: r.siblings for r in joined} == {1: "q3", 3: "q1", 4: None, 5: None, 6: "q1", 7: None}


def test_neighbours_stay_spread(spark):
    """No task takes several parts of the edges, and an end that several edges lead to counts as often as asked."""
    symbols = spark.range(2000).select(F.col("id").alias("symbol_id"), F.concat(F.lit("f"), (F.col("id") % 3).cast("string")).alias("path"), (F.col("id") % 5).cast("int").alias("start_line"), F.lit("n").alias("name"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("qualified_name"))
    edges = spark.range(12000).select((F.col("id") % 2000).alias("src_symbol_id"), (F.col("id") % 7).alias("dst_symbol_id"), F.lit("call").alias("kind"))
    pairs = {(i % 2000, i % 7) for i in range(12000)}
    twice = edges.union(edges.withColumn("kind", F.lit("import")))
    for callers in (True, False):
        df = inspection.neighbours(symbols, twice, symbols, callers, once=True)
        got = {r.symbol_id: [o.symbol for o in r.others] for r in df.collect()}
        ends = {}
        for src, dst in pairs:
            ends.setdefault(dst if callers else src, []).append(src if callers else dst)
        assert got == {i: [f"q{o}" for o in sorted(e, key=lambda o: (o % 3, o % 5, o))[:20]] for i, e in ends.items()}
        assert "coalesced" not in df._jdf.queryExecution().executedPlan().toString()
    both = {r.symbol_id: len(r.others) for r in inspection.neighbours(symbols, twice, symbols, False).collect()}
    assert both == {i: 2 * len(e) for i, e in ends.items()}


def test_files_are_dealt_out(spark):
    """Parts lie in one row group; their files are read by more than the task that reads it."""
    for name in ("extract_symbols", "class_skeletons"):
        df = catalogue.queries()[name](spark, "/root/testdata/sf0.001")
        assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 4
