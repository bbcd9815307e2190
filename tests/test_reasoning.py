"""Datalog, SHACL, graphs, time, resolution, views and streams on small inputs."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from orrery.functions import similarity as S
from orrery.functions import values as V
from orrery.operators import datalog as D
from orrery.operators import graph as G
from orrery.operators import resolution as R
from orrery.operators import temporal as T
from orrery.operators.shacl import Validator, parse_shapes
from orrery.plans import algebra as A
from orrery.sources.quads import QuadStore
from orrery.streaming import views

P = {"": "http://x/"}


def store_of(spark, ttl):
    s = QuadStore(spark, prefixes=P)
    s.load("@prefix : <http://x/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . " + ttl)
    return s


def names(df, p):
    return sorted((r.s.lex[9:], r.o.lex.replace("http://x/", "")) for r in df.where(F.col("p") == "http://x/" + p).collect())


def test_closure_negation_and_strata(spark):
    s = store_of(spark, ":a :e :b . :b :e :c . :c :e :a . :d :e :d2 .")
    rules = D.parse_rules("?x :t ?y :- ?x :e ?y . ?x :t ?z :- ?x :t ?y, ?y :t ?z . ?x :open ?x :- ?x :e ?y, NOT ?x :t ?x .", P)
    out = D.infer(s.quads, rules)
    assert len(names(out.derived, "t")) == 10 and names(out.derived, "open") == [("d", "d")]
    assert len(D.stratify(rules)) == 2
    with pytest.raises(D.DatalogError):
        D.stratify(D.parse_rules("?x :p true :- ?x :q true, NOT ?x :r true . ?x :r true :- ?x :q true, NOT ?x :p true .", P))
    with pytest.raises(D.DatalogError):
        D.parse_rules("?x :p ?nowhere :- ?x :q ?y .", P)


def test_subsumption_and_conflicts():
    rules = D.parse_rules("?x :p ?y :- ?x :q ?y . ?a :p ?b :- ?a :q ?b, ?a :r ?c . ?x :s ?y :- ?x :q ?y, NOT ?x :p ?y .", P)
    kept, gone = D.without_subsumed(rules)
    assert len(gone) == 1 and len(kept) == 2
    assert len(D.conflicts(rules)) == 2 and D.explain(kept)[1]["stratum"] == 1


def test_proofs_and_retraction(spark):
    s = store_of(spark, ":a :e :b . :b :e :c . :a :e :c .")
    rules = D.parse_rules('?x :t ?y :- ?x :e ?y . @name("step") ?x :t ?z :- ?x :t ?y, ?y :e ?z . @name("chain")', P)
    out = D.infer(s.quads, rules)
    tree = D.justify(out, rules, "<http://x/a> <http://x/t> <http://x/c>")
    assert tree["rule"] in ("step", "chain") and tree["because"]
    gone = s.quads.where("s.lex = 'http://x/a' and o.lex = 'http://x/b'")
    after = D.retract(s.quads, out.derived, rules, gone)
    assert names(after.derived, "t") == [("a", "c"), ("b", "c")]


def test_well_founded(spark):
    s = store_of(spark, ":a :move :b . :b :move :a . :b :move :c .")
    true, unknown = D.well_founded(s.quads, D.parse_rules("?x :win true :- ?x :move ?y, NOT ?y :win true .", P))
    assert names(true, "win") == [("b", "true")] and unknown.count() == 0
    s = store_of(spark, ":a :move :b . :b :move :a .")
    true, unknown = D.well_founded(s.quads, D.parse_rules("?x :win true :- ?x :move ?y, NOT ?y :win true .", P))
    assert true.count() == 0 and len(names(unknown, "win")) == 2


def test_owl(spark):
    s = store_of(spark, ":p a owl:TransitiveProperty, owl:SymmetricProperty . :a :p :b . :b :p :c . :gp owl:propertyChainAxiom (:par :par) . :a :par :b . :b :par :c . :A owl:intersectionOf (:B :C) . :z a :B, :C . :a owl:sameAs :a2 . :a2 owl:sameAs :a3 .")
    rules = D.rule_set("owl-rl") + D.list_rules(s.quads, spark)
    out = D.infer(s.quads, rules)
    assert len(names(out.facts, "p")) == 9 and names(out.derived, "gp") == [("a", "c")]
    assert out.derived.where("s.lex = 'http://x/z' and o.lex = 'http://x/A'").count() == 1
    assert {r.canonical.lex for r in D.same_as(s.quads).collect()} == {"http://x/a"}
    assert D.canonicalised(s.quads).where("s.lex like '%a2' or o.lex like '%a2'").count() == 0


def test_shapes(spark):
    s = store_of(spark, ':p1 a :Person ; :name "A" ; :age 5 ; :friend :p2 . :p2 a :Person ; :age "x", 7 ; :odd 1 . :p3 a :Person ; :name "A"@en, "B"@en ; :friend :p3 .')
    ttl = """@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix : <http://x/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .
      :S sh:targetClass :Person ; sh:closed true ; sh:ignoredProperties (rdf:type) ; sh:property :n, :a, :f .
      :n sh:path :name ; sh:minCount 1 ; sh:uniqueLang true . :a sh:path :age ; sh:maxCount 1 ; sh:datatype xsd:integer .
      :f sh:path :friend ; sh:node :N ; sh:qualifiedValueShape :N ; sh:qualifiedMaxCount 0 . :N sh:property [ sh:path :name ; sh:minCount 1 ] .
      :Q sh:targetNode :p1 ; sh:property [ sh:path (:friend :age) ; sh:maxCount 1 ] ; sh:sparql [ sh:select "SELECT $this WHERE { $this <http://x/age> 5 }" ] ."""
    v = Validator(s, parse_shapes(ttl))
    got = sorted((r["focus"].replace("<http://x/", "")[:2], r["constraint"]) for r in v.report().collect())
    assert got == sorted([("p2", "minCount"), ("p2", "maxCount"), ("p2", "datatype"), ("p2", "closed"), ("p3", "uniqueLang"), ("p1", "node"), ("p3", "qualifiedValueShape"), ("p1", "maxCount"), ("p1", "sparql")])
    assert not v.conforms() and 0 < v.score() < 1
    rule = parse_shapes('@prefix sh: <http://www.w3.org/ns/shacl#> . <urn:R> sh:targetClass <http://x/Person> ; sh:rule [ sh:construct "CONSTRUCT { ?b <http://x/friend> ?a } WHERE { ?a <http://x/friend> ?b }" ] .')
    assert Validator(s, rule).apply_rules() == 1 and s.ask("ASK { :p2 :friend :p1 }")


def test_shapes_of_many_subclasses(spark):
    n = 10_050
    iri = lambda text: V.struct(0, text)
    x, rdf, sub = F.lit("http://x/"), F.lit(A.RDF + "type"), F.lit(A.RDFS + "subClassOf")
    i = spark.range(n).withColumn("i", F.col("id").cast("string"))
    fact = lambda df, s, p, o: df.select(iri(s).alias("s"), p.alias("p"), iri(o).alias("o"), F.lit("").alias("g"))
    cls, deep, thing = F.concat(x, F.lit("C"), "i"), F.concat(x, F.lit("D"), "i"), F.concat(x, F.lit("t"), "i")
    one = spark.range(1)
    facts = fact(i, cls, sub, F.concat(x, F.lit("Top"))).unionByName(fact(i, deep, sub, cls)).unionByName(fact(i, thing, rdf, deep)).unionByName(fact(i, F.concat(x, F.lit("box")), F.lit("http://x/has"), thing))
    facts = facts.unionByName(fact(one, F.lit("http://x/Top"), sub, F.lit("http://x/C0"))).unionByName(fact(one, F.lit("http://x/box"), F.lit("http://x/has"), F.lit("http://x/other")))
    ttl = """@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix : <http://x/> . :S sh:targetClass :Top ; sh:property [ sh:path :name ; sh:minCount 1 ] .
      :B sh:targetNode :box ; sh:property [ sh:path :has ; sh:class :Top ] ."""
    got = {r.constraint: r.n for r in Validator(QuadStore(spark, facts), parse_shapes(ttl)).report().groupBy("constraint").agg(F.count("*").alias("n")).collect()}
    assert got == {"minCount": n, "class": 1}


def test_graphs(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("x", "y")], "s string, o string")
    pr = {r.node: r.score for r in G.pagerank(e, tolerance=1e-10).collect()}
    assert abs(sum(pr.values()) - 1) < 1e-6 and pr["c"] > pr["a"] > pr["d"]
    seeded = {r.node: r.score for r in G.pagerank(e, seeds=spark.createDataFrame([("x",)], "node string")).collect()}
    assert seeded["a"] < 1e-3 < seeded["x"]
    assert {r.component for r in G.components(e).collect()} == {"a", "x"}
    assert [tuple(r) for r in G.triangles(e).collect()] == [("a", "b", "c")]
    assert {r.node: r.depth for r in G.ancestors(e, F.lit("d")).collect()} == {"c": 1, "a": 2, "b": 3}
    assert G.contributors(e, G.pagerank(e), F.lit("c")).count() == 2 and G.siblings(e, F.lit("b")).count() == 1
    assert {r.score for r in G.centrality(e, "out").collect()} == {1.0}


def test_time(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    f = spark.createDataFrame([("a", "p", "1", t(1)), ("a", "p", "2", t(5)), ("b", "p", "1", t(2))], "s string, p string, o string, valid_from timestamp_ntz")
    s = T.snapshots(f)
    at = lambda h: F.lit(str(t(h))).cast("timestamp_ntz")
    assert {(r.s, r.o) for r in T.at(s, at(6)).collect()} == {("a", "2"), ("b", "1")}
    assert {(r.s, r.o, r.change) for r in T.difference(s, at(3), at(6)).collect()} == {("a", "2", "added"), ("a", "1", "removed")}
    closed = T.retracted(s, spark.createDataFrame([("b", "p")], "s string, p string"), at(9))
    assert closed.where("s = 'b'").first().valid_to == t(9) and T.longer_than(closed, "PT5H").count() == 1
    assert T.within(s, at(6), "PT2H").count() == 1
    assert T.sequences(f.where("o = '1'"), f.where("o = '2'"), "PT4H", ["s"]).count() == 1
    assert T.consecutive(f, 2, "PT3H", ["s"]).count() == 0 and T.consecutive(f, 2, "PT4H", ["s"], sliding=False).count() == 1
    assert T.duration("P1DT2H") == dt.timedelta(days=1, hours=2)
    with pytest.raises(ValueError):
        T.duration("1 day")


def test_resolution(spark):
    rows = spark.createDataFrame([(i, f"n{i // 3}") for i in range(200)], "id long, name string")
    pairs = R.blocked_pairs(rows, "id", F.lit("one block"), window=10)
    assert pairs.count() == sum(min(10, 199 - i) for i in range(200))
    found = R.resolve(R.blocked_pairs(rows, "id", F.col("name")), F.lit(1.0), 0.9)
    gold = rows.select(F.col("id").alias("node"), F.col("name").alias("component"))
    r = R.evaluated(found, gold).first()
    assert r.f1 == 1.0
    assert R.full_text(spark.createDataFrame([("The cats are running",), ("dogs",)], "t string"), "t", "cat run").count() == 1
    assert R.bloom("Alice", b"k") == R.bloom("alice", b"k") != R.bloom("Alicia", b"k")
    noisy = R.noisy_count(rows, 1.0, seed=3).first().n
    assert abs(noisy - 200) < 30
    one = spark.range(1)
    got = one.select(S.trigram(F.lit("word"), F.lit("words")).alias("t"), S.dice(F.lit("ff00"), F.lit("0f00")).alias("d"), S.jaro_winkler(F.lit("MARTHA"), F.lit("MARHTA")).alias("j"), S.metaphone(F.lit("Knight")).alias("m"), S.geo_test("sfIntersects")(F.lit("POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"), F.lit("POINT (1 1)")).alias("g"), S.geo_measure("area")(F.lit("POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))")).alias("a"), S.geo_shape("envelope")(F.lit("bad")).alias("b")).first()
    assert abs(got.t - 4 / 7) < 1e-9 and abs(got.d - 2 * 4 / 12) < 1e-9 and abs(got.j - 0.9611) < 1e-3 and got.m and got.g and got.a == 4.0 and got.b is None
    import pandas as pd

    e, r = R.transe(pd.DataFrame({"h": list("abc"), "r": ["p"] * 3, "t": list("bcd")}), epochs=5)
    assert set(e) == set("abcd") and set(r) == {"p"}


def test_resolution_of_large_blocks(spark):
    rows = spark.createDataFrame([(i, "same name" if i in (1, 1000) else f"n{i} m{i}") for i in range(1, 1201)], "id long, name string")
    assert R.blocked_pairs(rows, "id", F.lit("hot")).count() == 1200 * 1199 // 2
    names = [f"a b c d e{i % 40} f{i % 7}" for i in range(300)] + ["", None, "lone"]
    some = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    for df, percent in ((rows, 90), (some, 66), (some, 80), (some, 100)):
        found = R.similar_links(df, "id", F.lit("hot"), F.split("name", " "), percent)
        got = {(r.node, r.component) for r in R.resolve(found, F.col("score"), percent / 100).collect()}
        sets = {r.id: frozenset(r.name.split(" ")) for r in df.collect() if r.name is not None}
        boss = {i: i for i in sets}

        def top(i, boss=boss):
            while boss[i] != i:
                i = boss[i]
            return i

        linked = set()
        for i, x in sets.items():
            for j, y in sets.items():
                if i < j and 100 * len(x & y) >= percent * len(x | y):
                    linked |= {i, j}
                    a, b = sorted((top(i), top(j)))
                    boss[b] = a
        assert got == {(i, top(i)) for i in linked}


def test_nearest_of_each(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(R, "CELL", 4)
    m = np.random.default_rng(1).normal(size=(100, 8)).round(2)
    m[7] = m[40]
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(100, [0.0] * 8)], "id long, v array<double>")
    got = {(r["query"], r.id): r.similarity for r in R.nearest_of_each(rows, "v", rows.where("id % 5 = 0"), 6, "id").collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for i in range(0, 100, 5):
        line = np.round(u @ u[i], 12)
        assert {j for q, j in got if q == i} == set(sorted(range(100), key=lambda j: (-line[j], j))[:6])
    assert {j for q, j in got if q == 100} == set(range(6)) and len(got) == 21 * 6


def test_trade_of_all_lineitems(spark, tmp_path):
    from orrery.queries import QUERIES

    tables = {"customer": ("c_custkey long, c_nationkey int", [(1, 5), (2, 6)]), "orders": ("o_orderkey long, o_custkey long", [(1, 1), (2, 2)]), "supplier": ("s_suppkey long, s_nationkey int", [(1, 7)]), "lineitem": ("l_orderkey long, l_suppkey long, l_quantity double", [(1, 1, 50.0), (2, 1, 3.0)])}
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert {(r.node, r.component) for r in QUERIES["connected_components"](spark, str(tmp_path)).collect()} == {(5, 5), (6, 5), (7, 5)}


def test_views(spark):
    s = store_of(spark, ":a :in :r . :b :in :r .")
    view = views.sparql_view(s, "v1", "SELECT ?x WHERE { ?x :in :r }")
    got = []
    sub = views.Subscription(s, "SELECT ?x WHERE { ?x :in :r }", lambda came, went: got.append((came.count(), went.count())))
    assert view.refresh().count() == 2
    s.update("INSERT DATA { :c :in :r } ; DELETE DATA { :a :in :r }")
    sub.notify()
    assert got == [(1, 1)] and view.refresh().count() == 2 and spark.table("v1").count() == 2
    assert views.changes(s, "http://x/in", since=1).groupBy("op").count().count() == 2
    w = views.WriteBack(s)
    w.create("r1", "CONSTRUCT { ?x :near ?y } WHERE { ?x :in ?r . ?y :in ?r }", "http://x/d", ())
    w.create("r2", "CONSTRUCT { ?x :near ?x } WHERE { ?x :in ?r }", "http://x/d", ())
    w.run()
    w.drop("r1")
    assert s.quads.where("g = 'http://x/d'").count() == 2
    w.create("r3", "CONSTRUCT { ?x :k ?y } WHERE { GRAPH :d { ?x :near ?y } }", "http://x/e", ("http://x/d",))
    assert w.order() == ["r2", "r3"]
    with pytest.raises(ValueError):
        w.create("r4", "CONSTRUCT { ?x :near ?y } WHERE { GRAPH :e { ?x :k ?y } }", "http://x/d", ("http://x/e",))


def test_filters_of_two_columns_cost_few_steps(spark):
    import time

    odd = [("ff00", "0f00"), ("f" * 31, "0" * 30 + "f1"), ("Zf", "1f"), ("", ""), ("", "0"), ("", "ff"), (None, "ff"), (None, None), (None, "0"), ("abc", "ABC"), ("00", "0000")]
    ones = lambda x: [int(c, 16) if c in "0123456789abcdefABCDEF" else 0 for c in x or ""]

    def expected(a, b):
        if a is not None and a == b:
            return 1.0
        x, y = ones(a), ones(b)
        total = sum(i.bit_count() for i in x + y)
        return 2.0 * sum((i & j).bit_count() for i, j in zip(x, y)) / total if total else None if a is None or b is None else 0.0

    got = spark.createDataFrame(odd, "a string, b string").select("a", "b", S.dice(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.d for r in got] == [expected(r.a, r.b) for r in got]
    # the encoding of round 1 (bits set one by one)
    assert R.bloom("Ann", b"k", 2, 16) == _bloom_by_bits("Ann", b"k", 2, 16) and R.bloom("Große ring", b"key") == _bloom_by_bits("Große ring", b"key", 20, 1024)
    # rows of different texts, which would take minutes with each bit set and each digit read by itself
    rows = spark.range(20_000).select(F.concat(F.lit("urn "), "id").alias("x"), F.concat("id", F.lit(" urn")).alias("y"))
    start = time.time()
    assert rows.select(R.bloom_encoded(F.col("x"), b"k").alias("x"), R.bloom_encoded(F.col("y"), b"k").alias("y")).where(S.dice(F.col("x"), F.col("y")) < 1).count() == 20_000
    assert time.time() - start < 20


@pytest.mark.parametrize("block", [7, 1000])
def test_components_of_a_long_path_take_few_rounds(spark, monkeypatch, block):
    made = []
    monkeypatch.setattr(G, "written", lambda df, keep=G.written: made.append(1) or keep(df))
    # texts along a path are in the order of numbers, not of texts, so that it has many local minima; a loop and a pair besides
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    path = spark.range(1, 120).select(name(F.col("id")).alias("s"), name(F.col("id") + 1).alias("o"))
    e = path.unionByName(spark.createDataFrame([("x", "x"), ("z", "y"), ("y", "z"), ("z", None)], "s string, o string"))
    got = {r.node: r.component for r in G.components(e, block_edges=block).collect()}
    assert got == {f"n{i}": "n1" for i in range(1, 121)} | {"x": "x", "y": "y", "z": "y"}
    assert len(made) < 40
    quads = path.select(*[V.struct(0, F.col(c)).alias(c) for c in "so"]).withColumn("p", F.lit(A.OWL + "sameAs"))
    assert {r.c for r in D.same_as(quads).select(F.col("canonical.lex").alias("c")).collect()} == {"n1"}


def test_blocks_are_resolved_without_their_pairs(spark, tmp_path, monkeypatch):
    from orrery.queries import QUERIES

    rows = [(i, f"B{i % 2}", i % 3) for i in range(300)] + [(900, None, 1), (901, None, 1), (902, "B0", None), (903, "B0", None), (904, "B9", 9)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    linked = []
    monkeypatch.setattr(R, "components", lambda e, keep=R.components: linked.append(e.count()) or keep(e))
    got = {r.node: r.component for r in QUERIES["entity_resolution"](spark, str(tmp_path)).collect()}
    assert got == {i: i % 6 for i in range(300)} and linked == [294]


def test_rounds_broadcast_by_rows_not_by_files(spark):
    from orrery.operators.lineage import sized_broadcasts

    key = "spark.sql.autoBroadcastJoinThreshold"
    told, keep = spark.conf.get(key), D.written
    try:
        spark.conf.set(key, "200000")
        # 30,000 facts about one object take less than the limit in a file and far more as rows
        rows = G.written(spark.range(30_000).select(V.struct(0, F.concat(F.lit("urn:x:"), F.col("id").cast("string"))).alias("s"), F.lit("urn:in").alias("p"), V.struct(0, F.lit("urn:y")).alias("o")))
        plan = lambda: rows.alias("a").join(rows.alias("b"), F.col("a.s") == F.col("b.o"))._jdf.queryExecution().sparkPlan().toString()
        with sized_broadcasts(spark):
            assert "BroadcastHashJoin" not in plan() and spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == "200000"
        assert spark.conf.get(key) == "200000" and spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None
        seen = []
        D.written = lambda df: seen.append(df._jdf.queryExecution().sparkPlan().toString()) or G.written(df)
        out = D.infer(rows, D.parse_rules("?x <urn:w> ?y :- ?x <urn:in> ?y . ?x <urn:w> ?z :- ?x <urn:w> ?y, ?y <urn:in> ?z ."))
        assert out.derived.count() == 30_000 and not any("BroadcastHashJoin" in x for x in seen) and spark.conf.get(key) == "200000"
    finally:
        D.written = keep
        spark.conf.set(key, told)


def test_tasks_of_rounds_are_small_and_frequent_keys_are_split(spark, monkeypatch):
    from orrery.operators import lineage

    key, seen = "spark.sql.autoBroadcastJoinThreshold", []
    told = spark.conf.get(key)
    iris = lambda df, s, o: df.select(V.struct(0, s).alias("s"), F.lit("urn:in").alias("p"), V.struct(0, o).alias("o"))
    facts = G.written(iris(spark.range(30_000), F.concat(F.lit("urn:x:"), F.col("id").cast("string")), F.lit("urn:y")).unionByName(iris(spark.range(1), F.lit("urn:y"), F.lit("urn:z"))))

    def run_first(df):
        out = df.select(*df.columns)
        seen.append((out.rdd.getNumPartitions(), out._jdf.queryExecution().executedPlan().toString()))
        return G.written(df)

    monkeypatch.setattr(lineage, "TASK_BYTES", 20_000)
    monkeypatch.setattr(D, "written", run_first)
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        spark.conf.set(key, "1000")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1000")
        rules = D.parse_rules("?x <urn:w> ?y :- ?x <urn:in> ?y . ?x <urn:w> ?z :- ?x <urn:w> ?y, ?y <urn:in> ?z .")
        assert D.infer(facts, rules).derived.count() == 60_001
        first, second = seen[0], seen[1]
        assert first[0] > 10  # four partitions are set
        assert "skew=true" in second[1]
    finally:
        spark.conf.set(key, told)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    assert before == {k: spark.conf.get(k, None) for k in before}


def test_no_round_hashes_rows_where_files_are_read(spark, monkeypatch):
    plans = []

    def run_seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return G.written(df)

    def first_above_scans(plan):
        path, out = [], []
        for line in plan.splitlines():
            node = line.lstrip(" :+-*")
            depth = len(line) - len(node)
            path = [x for x in path if x[0] < depth] + [(depth, node.split()[0] if node else "")]
            if "Scan parquet" in node:
                out.append(next((n for _, n in reversed(path) if "Exchange" in n or "Aggregate" in n), ""))
        return out

    monkeypatch.setattr(D, "written", run_seen)
    iris = lambda df, s, p, o: df.select(V.struct(0, s).alias("s"), F.lit(p).alias("p"), V.struct(0, o).alias("o"))
    ids = F.concat(F.lit("urn:x:"), F.col("id").cast("string"))
    told = G.written(iris(spark.range(3000), ids, "urn:in", F.lit("urn:y")).unionByName(iris(spark.range(1), F.lit("urn:y"), "urn:in", F.lit("urn:z"))))
    rules = D.parse_rules("?x <urn:w> ?y :- ?x <urn:in> ?y . ?x <urn:w> ?z :- ?x <urn:w> ?y, ?y <urn:in> ?z . ?y <urn:back> ?x :- ?x <urn:w> ?y . ?x <urn:w> ?y :- ?y <urn:back> ?x . <urn:a> <urn:some> <urn:b> :- ?x <urn:in> ?y .")
    out = D.infer(told, rules)
    assert out.derived.count() == out.derived.distinct().count() == 2 * 6001 + 1
    kept = D.retract(told, out.derived, rules, told.where("s.lex = 'urn:y'"))
    assert kept.derived.count() == 2 * 3000 + 1
    more, fewer = D.hypothetical(told, rules, assume=iris(spark.range(1), F.lit("urn:z"), "urn:in", F.lit("urn:end")))
    assert (more.count(), fewer.count()) == (2 * 3002, 0)
    sure = D.weighted(told.withColumn("confidence", F.lit(0.5)), rules[:1])
    assert {r.confidence for r in sure.collect()} == {0.5} and sure.count() == 3001
    above = [n for p in plans for n in first_above_scans(p)]
    assert above and not [n for n in above if "Aggregate" in n]


def test_approximate_counts_keep_a_sketch_for_each_group_only(spark, tmp_path):
    from orrery.queries import QUERIES

    rows = [("A", i % 700) for i in range(2000)] + [("N", 1), ("N", None), (None, 5), (None, 5), ("R", None)]
    spark.createDataFrame(rows, "l_returnflag string, l_orderkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = QUERIES["approximate_distinct"](spark, str(tmp_path))
    assert {(r.f, r.near) for r in out.collect()} == {("A", True), ("N", True), (None, True), ("R", True)}
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert not [x for x in plan.splitlines() if "approx_count_distinct" in x and "keys=[" in x and "l_orderkey" in x.split("functions=")[0]]


def test_frequent_values_meet_in_many_tasks(spark, tmp_path, monkeypatch):
    from orrery.plans import compiler
    from orrery.queries import QUERIES

    monkeypatch.setattr(compiler, "CELL", 16)
    rows = [(i, 1, "B") for i in range(300)] + [(i, i % 4, f"B{i % 3}") for i in range(300, 340)] + [(400, None, "B"), (401, 1, None)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    out = QUERIES["bgp_value_join"](spark, str(tmp_path))
    expected = sorted((f"urn:part:{x[0]}", f"urn:part:{y[0]}") for x in rows for y in rows if x[1] is not None and x[1] < 3 and x[1:] == y[1:] and None not in x and x[0] != y[0])
    got = out.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.a, r.b) for r in got) == expected
    assert len({r.task for r in got if r.a == "urn:part:7"}) > 3  # one row's partners come from more tasks than one


@pytest.mark.parametrize(
    ("on", "fits"),
    [
        ("?cb > ?sb + 9000", lambda s, c: c > s + 9000),
        ("?sb + 9000 <= ?cb", lambda s, c: c >= s + 9000),
        ("?cb < ?sb && ?cb != 40.0e0 && ?sb < 900", lambda s, c: c < s < 900 and c != 40),
        ("?cb >= ?sb && ?cb <= ?sb + 5", lambda s, c: s <= c <= s + 5),  # two ranges: the plain join
    ],
)
def test_ranges_of_an_optional_meet_in_cells(spark, tmp_path, monkeypatch, on, fits):
    from orrery.plans import compiler
    from orrery.sources.quads import select
    from orrery.sources.tables import star_schema

    monkeypatch.setattr(compiler, "CELL", 4)
    # ties over many cells, a frequent nation, suppliers without partners, nations on one side only, unbound values
    customers = [(i, 1, float(i % 50 * 200)) for i in range(400)] + [(i, 2, 40.0) for i in range(400, 460)] + [(500, 3, 9999.0), (501, 1, None), (502, None, 9999.0), (503, 1, -0.0)]
    suppliers = [(i, 1 + i % 2, float(i * 30 - 600)) for i in range(60)] + [(70, 1, 0.0), (71, 4, -900.0), (72, 1, None), (73, 1, 0.0), (74, 1, 99999.0), (75, 2, 35.0)]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    text = f"SELECT ?s ?c WHERE {{ ?s col:s_nationkey ?n ; col:s_acctbal ?sb OPTIONAL {{ ?c col:c_nationkey ?n ; col:c_acctbal ?cb FILTER({on}) }} }}"
    got = select(star_schema(spark, str(tmp_path), ["supplier", "customer"]), text, {"col": "urn:col:"}).withColumn("task", F.spark_partition_id()).collect()
    expected = []
    for s, n, b in suppliers:
        if b is not None:
            mine = [c for c, m, v in customers if m == n and v is not None and fits(b, v)]
            expected += [(f"urn:supplier:{s}", f"urn:customer:{c}") for c in mine] or [(f"urn:supplier:{s}", "")]
    assert sorted((r.s, r.c or "") for r in got) == sorted(expected)
    if "<= ?sb + 5" not in on:  # one supplier's partners come from more tasks than one
        assert len({r.task for r in got if r.s == "urn:supplier:0" or r.s == "urn:supplier:40"}) > 3


def _bloom_by_bits(value, key, hashes, bits):
    import hashlib
    import hmac

    out, padded = bytearray(bits // 8), f"_{value.lower()}_"
    for i in range(len(padded) - 1):
        d = hmac.new(key, padded[i : i + 2].encode(), hashlib.sha256).digest()
        a, b = int.from_bytes(d[:8], "big"), int.from_bytes(d[8:16], "big") | 1
        for j in range(hashes):
            at = (a + j * b) % bits
            out[at // 8] |= 1 << (at % 8)
    return out.hex()
