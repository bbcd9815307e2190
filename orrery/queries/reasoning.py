"""Datalog, SHACL, updates, temporal facts, graph analytics, resolution and streams, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import datalog as D
from ..operators import graph as G
from ..operators import resolution as R
from ..operators import temporal as T
from ..operators.lineage import spread
from ..operators.shacl import Validator, parse_shapes
from ..plans import algebra as A
from ..sources.quads import QuadStore
from ..streaming import views
from .base import query, rounded

COL = "urn:col:"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iri(prefix: str, c: str):
    return V.struct(0, F.concat(F.lit(prefix), F.col(c).cast("string")))


def fact(df: DataFrame, s: tuple[str, str], p: str, o) -> DataFrame:
    """Quads of one predicate of a table."""
    return df.select(iri(*s).alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(None).cast("string").alias("g")).where("s is not null and o is not null")


def number(c: str, dt: str = "integer"):
    return F.when(F.col(c).isNotNull(), V.struct(2, F.col(c).cast("string"), A.XSD + dt))


def text(c: str):
    return F.when(F.col(c).isNotNull(), V.struct(2, F.col(c), V.STRING))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """in: customer, supplier to nation to region; names of regions."""
    c, s, n, r = (read(spark, sf_dir, t) for t in ("customer", "supplier", "nation", "region"))
    out = fact(c, ("urn:customer:", "c_custkey"), "urn:in", iri("urn:nation:", "c_nationkey"))
    out = out.unionByName(fact(s, ("urn:supplier:", "s_suppkey"), "urn:in", iri("urn:nation:", "s_nationkey")))
    out = out.unionByName(fact(n, ("urn:nation:", "n_nationkey"), "urn:in", iri("urn:region:", "n_regionkey")))
    return out.unionByName(fact(r, ("urn:region:", "r_regionkey"), "urn:name", text("r_name")))


def flat(df: DataFrame) -> DataFrame:
    return df.select(F.col("s.lex").alias("s"), "p", F.col("o.lex").alias("o"))


_PLACES = "e(s, o) AS (SELECT 'urn:customer:' || c_custkey, 'urn:nation:' || c_nationkey FROM customer UNION ALL SELECT 'urn:supplier:' || s_suppkey, 'urn:nation:' || s_nationkey FROM supplier UNION ALL SELECT 'urn:nation:' || n_nationkey, 'urn:region:' || n_regionkey FROM nation)"
_TC = "?x <urn:within> ?y :- ?x <urn:in> ?y . ?x <urn:within> ?z :- ?x <urn:within> ?y, ?y <urn:in> ?z . "


@query("datalog_transitive_closure", f"WITH RECURSIVE {_PLACES}, t(s, o) AS (SELECT * FROM e UNION SELECT t.s, e.o FROM t JOIN e ON t.o = e.s) SELECT s, 'urn:within' AS p, o FROM t")
def datalog_tc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(D.infer(places(spark, sf_dir), D.parse_rules(_TC)).derived)


@query("datalog_negation", "SELECT 'urn:customer:' || c_custkey AS s, 'urn:idle' AS p, 'true' AS o FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def datalog_negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    o = o.where("o_orderpriority = '1-URGENT'")
    facts = fact(c, ("urn:customer:", "c_custkey"), A.RDF + "type", V.struct(0, F.lit("urn:Customer"))).unionByName(fact(o, ("urn:customer:", "o_custkey"), "urn:ordered", iri("urn:orders:", "o_orderkey")))
    return flat(D.infer(facts, D.parse_rules("?c <urn:active> true :- ?c <urn:ordered> ?o . ?c <urn:idle> true :- ?c a <urn:Customer>, NOT ?c <urn:active> true .")).derived.where("p = 'urn:idle'"))


@query("datalog_aggregate", "SELECT 'urn:nation:' || c_nationkey AS s, 'urn:customers' AS p, COUNT(*)::VARCHAR AS o FROM customer GROUP BY c_nationkey HAVING COUNT(*) > 60")
def datalog_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    facts = fact(c, ("urn:nation:", "c_nationkey"), "urn:has", iri("urn:customer:", "c_custkey"))
    return flat(D.infer(facts, D.parse_rules("?n <urn:customers> ?k :- COUNT(?c WHERE ?n <urn:has> ?c) = ?k, ?k > 60 .")).derived)


@query("datalog_arithmetic_guards", "SELECT 'urn:part:' || p_partkey AS s, 'urn:double' AS p, (p_size * 2)::VARCHAR AS o FROM part WHERE p_size > 45")
def datalog_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = fact(read(spark, sf_dir, "part"), ("urn:part:", "p_partkey"), "urn:size", number("p_size"))
    out = D.infer(facts, D.parse_rules("?p <urn:double> ?d :- ?p <urn:size> ?z, ?z > 45, ?d IS ?z * 2 .")).derived
    return flat(out).withColumn("o", F.col("o").cast("double").cast("bigint").cast("string"))


@query("datalog_goal_directed", f"WITH RECURSIVE {_PLACES}, t(o) AS (SELECT o FROM e WHERE s = 'urn:customer:7' UNION SELECT e.o FROM t JOIN e ON t.o = e.s) SELECT 'urn:customer:7' AS s, 'urn:within' AS p, o FROM t")
def datalog_goal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(D.infer_goal(places(spark, sf_dir), D.parse_rules(_TC), A.Triple(A.Iri("urn:customer:7"), A.Iri("urn:within"), A.Var("y"))))


@query("datalog_constraint", "SELECT 'poor supplier' AS rule, 'urn:supplier:' || s_suppkey AS s FROM supplier WHERE s_acctbal < 0")
def datalog_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = fact(read(spark, sf_dir, "supplier"), ("urn:supplier:", "s_suppkey"), "urn:balance", number("s_acctbal", "double"))
    v = D.violations(facts, D.parse_rules(':- ?s <urn:balance> ?b, ?b < 0 . @name("poor supplier")'))
    return v.select("rule", F.regexp_extract("binding", r"\?s=<([^>]*)>", 1).alias("s"))


@query("datalog_rdfs", "SELECT 'urn:customer:' || c_custkey AS s, u.o FROM customer, LATERAL (VALUES ('urn:Customer'), ('urn:Party'), ('urn:Agent')) u(o)")
def datalog_rdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = fact(read(spark, sf_dir, "customer"), ("urn:customer:", "c_custkey"), "urn:balance", number("c_acctbal", "double"))
    schema = [("urn:balance", A.RDFS + "domain", "urn:Customer"), ("urn:Customer", A.RDFS + "subClassOf", "urn:Party"), ("urn:Party", A.RDFS + "subClassOf", "urn:Agent")]
    rows = spark.createDataFrame(schema, "a string, p string, b string").select(V.struct(0, F.col("a")).alias("s"), "p", V.struct(0, F.col("b")).alias("o"), F.lit(None).cast("string").alias("g"))
    out = D.infer(facts.unionByName(rows), D.rule_set("rdfs")).derived
    return flat(out.where((F.col("p") == A.RDF + "type") & F.col("s.lex").startswith("urn:customer:"))).select("s", "o")


@query("datalog_well_founded", "SELECT 'unknown' AS truth, COUNT(*) AS n FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'true', COUNT(*) FROM nation WHERE n_nationkey % 2 = 1")
def datalog_wfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even nations win or lose against themselves (unknown); odd ones have no move against them."""
    n = read(spark, sf_dir, "nation")
    facts = fact(n, ("urn:nation:", "n_nationkey"), "urn:is", V.struct(0, F.lit("urn:N"))).unionByName(fact(n.where("n_nationkey % 2 = 0"), ("urn:nation:", "n_nationkey"), "urn:beats", iri("urn:nation:", "n_nationkey")))
    rules = D.parse_rules("?x <urn:lost> true :- ?y <urn:beats> ?x, NOT ?y <urn:lost> true . ?x <urn:safe> true :- ?x <urn:is> <urn:N>, NOT ?x <urn:lost> true .")
    true, unknown = D.well_founded(facts, rules)
    safe = lambda d, name: d.where("p = 'urn:safe'").agg(F.count("*").alias("n")).select(F.lit(name).alias("truth"), "n")
    return safe(unknown, "unknown").unionByName(safe(true, "true"))


@query("datalog_lattice_min", f"WITH RECURSIVE {_PLACES}, t(s, v) AS (SELECT 'urn:customer:' || c_custkey, c_acctbal FROM customer UNION SELECT e.o, t.v FROM t JOIN e ON e.s = t.s) SELECT s, ROUND(MIN(v), 2) AS v FROM t GROUP BY 1")
def datalog_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = flat(places(spark, sf_dir).where("p = 'urn:in'")).select("s", "o")
    v = read(spark, sf_dir, "customer").select(F.concat(F.lit("urn:customer:"), "c_custkey").alias("s"), F.col("c_acctbal").alias("v"))
    return rounded(D.lattice(e, v, "min"))


@query("datalog_noisy_or", "SELECT 'urn:nation:' || n AS s, ROUND(1 - EXP(SUM(LN(1 - 0.8 * c))), 4) AS confidence FROM (SELECT DISTINCT c_nationkey AS n, c_custkey, (c_custkey % 10) / 100.0 AS c FROM customer) GROUP BY 1")
def datalog_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    facts = fact(c, ("urn:customer:", "c_custkey"), "urn:in", iri("urn:nation:", "c_nationkey")).withColumn("confidence", F.regexp_extract("s.lex", r"(\d+)$", 1).cast("int") % 10 / 100.0)
    out = D.weighted(facts, D.parse_rules("?n <urn:known> true :- ?c <urn:in> ?n . @weight(0.8)"))
    return rounded(out.select(F.col("s.lex").alias("s"), "confidence"), 4)


@query("datalog_retract_rederive", f"WITH RECURSIVE {_PLACES}, f(s, o) AS (SELECT * FROM e WHERE NOT (s = 'urn:nation:3')), t(s, o) AS (SELECT * FROM f UNION SELECT t.s, f.o FROM t JOIN f ON t.o = f.s) SELECT s, 'urn:within' AS p, o FROM t")
def datalog_retract(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, rules = places(spark, sf_dir), D.parse_rules(_TC)
    first = D.infer(facts, rules)
    gone = facts.where("p = 'urn:in' and s.lex = 'urn:nation:3'")
    return flat(D.retract(facts, first.derived, rules, gone).derived.where("p = 'urn:within'"))


@query("datalog_hypothetical", "SELECT 'urn:supplier:' || s_suppkey AS s, 'urn:region:' || r AS o, change FROM supplier, (VALUES (0, 'went'), (99, 'came')) v(r, change) WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_nationkey = 5) AND (r = 99 OR r = (SELECT n_regionkey FROM nation WHERE n_nationkey = 5)) UNION ALL SELECT 'urn:supplier:' || s_suppkey, 'urn:region:' || n_regionkey, 'went' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey = 5 AND n_regionkey <> 0")
def datalog_hypothetical(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = places(spark, sf_dir).where("not s.lex like 'urn:customer:%'")
    moved = facts.where("p = 'urn:in' and s.lex = 'urn:nation:5'")
    came, went = D.hypothetical(facts, D.parse_rules(_TC), moved.withColumn("o", V.struct(0, F.lit("urn:region:99"))), moved)
    both = came.withColumn("change", F.lit("came")).unionByName(went.withColumn("change", F.lit("went")))
    return both.where("s.lex like 'urn:supplier:%'").select(F.col("s.lex").alias("s"), F.col("o.lex").alias("o"), "change")


@query("same_as_components", "SELECT 'urn:customer:' || c_custkey AS node, 'urn:customer:' || MIN(c_custkey::VARCHAR) OVER (PARTITION BY c_nationkey, c_mktsegment) AS canonical FROM customer WHERE (c_nationkey, c_mktsegment) IN (SELECT (c_nationkey, c_mktsegment) FROM customer GROUP BY c_nationkey, c_mktsegment HAVING COUNT(*) > 1)")
def same_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    c = read(spark, sf_dir, "customer").withColumn("nxt", F.lead("c_custkey").over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey"))).where("nxt is not null")
    out = D.same_as(fact(c, ("urn:customer:", "c_custkey"), A.OWL + "sameAs", iri("urn:customer:", "nxt")))
    return out.select(F.col("node.lex").alias("node"), F.col("canonical.lex").alias("canonical"))


# -- SHACL
def shacl(name: str, shape: str, sql: str) -> None:
    """A shape for customers: facts are nation (IRI), balance (double), segment and name (string), and orders."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
        key = ("urn:customer:", "c_custkey")
        facts = fact(c, key, A.RDF + "type", V.struct(0, F.lit("urn:Customer")))
        for p, v in (("nation", iri("urn:nation:", "c_nationkey")), ("balance", number("c_acctbal", "double")), ("segment", text("c_mktsegment")), ("name", text("c_name")), ("limit", number("c_limit", "double"))):
            facts = facts.unionByName(fact(c.withColumn("c_limit", F.lit(5000.0)), key, f"urn:{p}", v))
        facts = facts.unionByName(fact(c.where("c_acctbal > 5000"), key, "urn:rich", text("c_name"))) if "closed" in shape else facts
        home = c.withColumn("home", F.lit(3))
        facts = facts.unionByName(fact(home, key, "urn:home", iri("urn:nation:", "home")))
        if "urn:label>" in shape:
            tag = F.element_at(F.array(F.lit("fr"), F.lit("en"), F.lit("de")), F.col("c_nationkey") % 3 + 1)
            facts = facts.unionByName(fact(c.withColumn("tag", tag), key, "urn:label", V.struct(2, F.col("c_name"), A.RDF + "langString", F.col("tag"))))
        if "urn:size>" in shape or "urn:Big>" in shape:
            three = read(spark, sf_dir, "nation").where("n_nationkey = 3")
            facts = facts.unionByName(fact(three, ("urn:nation:", "n_nationkey"), "urn:size", number("n_nationkey"))).unionByName(fact(three, ("urn:nation:", "n_nationkey"), A.RDF + "type", V.struct(0, F.lit("urn:Big"))))
        if "urn:order>" in shape:
            facts = facts.unionByName(fact(o, ("urn:customer:", "o_custkey"), "urn:order", iri("urn:orders:", "o_orderkey")))
        ttl = f"@prefix sh: <{A.SH}> . @prefix xsd: <{A.XSD}> . <urn:S> a sh:NodeShape ; sh:targetClass <urn:Customer> ; {shape} ."
        store = QuadStore(spark, facts)
        return Validator(store, parse_shapes(ttl)).report().select(F.regexp_extract("focus", "<([^>]*)>", 1).alias("focus"), "constraint").distinct()

    run.__name__ = name
    query(name, sql)(run)


def _broken(what: str, where: str) -> str:
    return f"SELECT DISTINCT 'urn:customer:' || c_custkey AS focus, '{what}' AS \"constraint\" FROM customer WHERE {where}"


shacl("shacl_min_count", "sh:property [ sh:path <urn:order> ; sh:minCount 5 ]", _broken("minCount", "(SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) < 5"))
shacl("shacl_max_count", "sh:property [ sh:path <urn:order> ; sh:maxCount 15 ]", _broken("maxCount", "(SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) > 15"))
shacl("shacl_in", "sh:property [ sh:path <urn:segment> ; sh:in ('BUILDING' 'MACHINERY') ]", _broken("in", "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"))
shacl("shacl_ranges", "sh:property [ sh:path <urn:balance> ; sh:minInclusive 0 ; sh:maxExclusive 9000 ]", _broken("minInclusive", "c_acctbal < 0") + " UNION ALL " + _broken("maxExclusive", "c_acctbal >= 9000"))
shacl("shacl_pattern_length", "sh:property [ sh:path <urn:segment> ; sh:pattern '^[A-M]' ; sh:maxLength 9 ]", _broken("pattern", "NOT regexp_matches(c_mktsegment, '^[A-M]')") + " UNION ALL " + _broken("maxLength", "LENGTH(c_mktsegment) > 9"))
shacl("shacl_datatype_node_kind", "sh:property [ sh:path <urn:balance> ; sh:datatype xsd:double ; sh:nodeKind sh:Literal ] ; sh:property [ sh:path <urn:name> ; sh:datatype xsd:integer ] ; sh:property [ sh:path <urn:nation> ; sh:nodeKind sh:Literal ]", _broken("nodeKind", "true") + " UNION ALL " + _broken("datatype", "true"))
shacl("shacl_has_value", "sh:property [ sh:path <urn:nation> ; sh:hasValue <urn:nation:3> ]", _broken("hasValue", "c_nationkey <> 3"))
shacl("shacl_less_than", "sh:property [ sh:path <urn:balance> ; sh:lessThan <urn:limit> ]", _broken("lessThan", "c_acctbal >= 5000"))
shacl("shacl_disjoint_equals", "sh:property [ sh:path <urn:nation> ; sh:disjoint <urn:home> ] ; sh:property [ sh:path <urn:home> ; sh:equals <urn:nation> ]", _broken("disjoint", "c_nationkey = 3") + " UNION ALL " + _broken("equals", "c_nationkey <> 3"))
shacl("shacl_logic", "sh:property [ sh:path <urn:balance> ; sh:or ( [ sh:maxInclusive 0 ] [ sh:minInclusive 5000 ] ) ; sh:not [ sh:minInclusive 9500 ] ]", _broken("or", "c_acctbal > 0 AND c_acctbal < 5000") + " UNION ALL " + _broken("not", "c_acctbal >= 9500"))
shacl("shacl_xone_and", "sh:property [ sh:path <urn:balance> ; sh:xone ( [ sh:maxInclusive 1000 ] [ sh:minInclusive 500 ] ) ; sh:and ( [ sh:minInclusive -900 ] [ sh:maxInclusive 9900 ] ) ]", _broken("xone", "c_acctbal BETWEEN 500 AND 1000") + " UNION ALL " + _broken("and", "c_acctbal < -900 OR c_acctbal > 9900"))
shacl("shacl_closed", f"sh:closed true ; sh:ignoredProperties ( <{A.RDF}type> <urn:name> <urn:segment> <urn:nation> <urn:limit> <urn:balance> <urn:home> )", _broken("closed", "c_acctbal > 5000"))
shacl("shacl_length_exclusive", "sh:property [ sh:path <urn:segment> ; sh:minLength 9 ] ; sh:property [ sh:path <urn:balance> ; sh:minExclusive 0 ]", _broken("minLength", "LENGTH(c_mktsegment) < 9") + " UNION ALL " + _broken("minExclusive", "c_acctbal <= 0"))
shacl("shacl_less_or_equal", "sh:property [ sh:path <urn:balance> ; sh:lessThanOrEquals <urn:limit> ]", _broken("lessThanOrEquals", "c_acctbal > 5000"))
shacl("shacl_language", "sh:property [ sh:path <urn:label> ; sh:languageIn ( 'en' 'de' ) ]", _broken("languageIn", "c_nationkey % 3 = 0"))
shacl("shacl_node", "sh:property [ sh:path <urn:nation> ; sh:node [ sh:property [ sh:path <urn:size> ; sh:minCount 1 ] ] ]", _broken("node", "c_nationkey <> 3"))
shacl("shacl_qualified", "sh:property [ sh:path <urn:balance> ; sh:qualifiedValueShape [ sh:minInclusive 1000 ] ; sh:qualifiedMinCount 1 ]", _broken("qualifiedValueShape", "c_acctbal < 1000"))
shacl("shacl_class", "sh:property [ sh:path <urn:nation> ; sh:class <urn:Big> ]", _broken("class", "c_nationkey <> 3"))
shacl("shacl_path", "sh:property [ sh:path ( <urn:nation> <urn:size> ) ; sh:minCount 1 ]", _broken("minCount", "c_nationkey <> 3"))


# -- updates
@query("update_delete_insert_where", "SELECT 'urn:customer:' || c_custkey AS s, CASE WHEN c_mktsegment = 'BUILDING' THEN 'urn:new' ELSE 'urn:segment' END AS p, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSES' ELSE c_mktsegment END AS o FROM customer")
def update_modify(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = QuadStore(spark, fact(read(spark, sf_dir, "customer"), ("urn:customer:", "c_custkey"), "urn:segment", text("c_mktsegment")))
    store.update("DELETE { ?c <urn:segment> ?m } INSERT { ?c <urn:new> 'HOUSES' } WHERE { ?c <urn:segment> ?m FILTER(?m = 'BUILDING') }")
    return flat(store.quads)


@query("update_graphs", "SELECT 'urn:nation:' || n_nationkey AS s, u.g FROM nation, LATERAL (VALUES ('urn:a'), ('urn:b')) u(g) WHERE n_nationkey <> 2 UNION ALL SELECT 'urn:x', 'urn:a'")
def update_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = QuadStore(spark, fact(read(spark, sf_dir, "nation"), ("urn:nation:", "n_nationkey"), "urn:name", text("n_name")))
    store.update("COPY DEFAULT TO <urn:a> ; MOVE DEFAULT TO <urn:b> ; DELETE WHERE { GRAPH <urn:a> { <urn:nation:2> ?p ?o } } ; DELETE WHERE { GRAPH <urn:b> { <urn:nation:2> ?p ?o } } ; INSERT DATA { GRAPH <urn:a> { <urn:x> <urn:name> 'x' } } ; CLEAR GRAPH <urn:none>")
    return store.select("SELECT ?s ?g WHERE { GRAPH ?g { ?s <urn:name> ?n } }").withColumn("s", F.regexp_extract("s", "<([^>]*)>", 1))


@query("construct", "SELECT 'urn:nation:' || n_nationkey AS s, 'urn:partOf' AS p, 'urn:region:' || n_regionkey AS o FROM nation UNION ALL SELECT 'urn:region:' || n_regionkey, 'urn:has', 'urn:nation:' || n_nationkey FROM nation")
def construct(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = QuadStore(spark, places(spark, sf_dir))
    return flat(store.construct("CONSTRUCT { ?n <urn:partOf> ?r . ?r <urn:has> ?n } WHERE { ?n <urn:in> ?r . ?r <urn:name> ?x }"))


@query("describe", "SELECT 'urn:nation:4' AS s, 'urn:in' AS p, 'urn:region:' || n_regionkey AS o FROM nation WHERE n_nationkey = 4")
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(QuadStore(spark, places(spark, sf_dir)).describe("DESCRIBE <urn:nation:4>"))


@query("ask", "SELECT true AS yes, false AS no")
def ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = QuadStore(spark, places(spark, sf_dir))
    return spark.range(1).select(F.lit(store.ask("ASK { <urn:nation:4> <urn:in> ?r }")).alias("yes"), F.lit(store.ask("ASK { <urn:region:1> <urn:in> ?r }")).alias("no"))


@query("quads_generic_terms", "SELECT '<urn:region:' || n_regionkey || '>' AS r, '\"' || COUNT(*) || '\"' AS k, '\"' || SUM(n_nationkey) || '\"^^<http://www.w3.org/2001/XMLSchema#integer>' AS t FROM nation GROUP BY n_regionkey")
def quads_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    facts = fact(n, ("urn:nation:", "n_nationkey"), "urn:in", iri("urn:region:", "n_regionkey")).unionByName(fact(n, ("urn:nation:", "n_nationkey"), "urn:key", number("n_nationkey")))
    out = QuadStore(spark, facts).select("SELECT ?r (STR(COUNT(?n)) AS ?k) (SUM(?v) AS ?t) WHERE { ?n <urn:in> ?r ; <urn:key> ?v } GROUP BY ?r")
    return out.withColumn("k", F.concat(F.lit('"'), "k", F.lit('"')))


@query("export_ntriples", "SELECT '<urn:nation:' || n_nationkey || '> <urn:in> <urn:region:' || n_regionkey || '> .' AS value FROM nation UNION ALL SELECT '<urn:customer:' || c_custkey || '> <urn:in> <urn:nation:' || c_nationkey || '> .' FROM customer UNION ALL SELECT '<urn:supplier:' || s_suppkey || '> <urn:in> <urn:nation:' || s_nationkey || '> .' FROM supplier UNION ALL SELECT '<urn:region:' || r_regionkey || '> <urn:name> \"' || r_name || '\" .' FROM region")
def export_ntriples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.rdf import ntriples_lines

    return ntriples_lines(places(spark, sf_dir))


@query("json_to_triples", "SELECT 'urn:events:' || event_id AS s, 'urn:json:k' AS p, json_extract_string(props, '$.k') AS o, 'http://www.w3.org/2001/XMLSchema#integer' AS dt FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.rdf import json_rows

    e = read(spark, sf_dir, "events")
    return json_rows(e, F.concat(F.lit("urn:events:"), "event_id"), F.col("props")).select(F.col("s.lex").alias("s"), "p", F.col("o.lex").alias("o"), F.col("o.dt").alias("dt"))


# -- temporal
def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest event type as a snapshot fact."""
    e = read(spark, sf_dir, "events")
    one = e.groupBy("user_id", "ts").agg(F.min("event_type").alias("o"))
    return T.snapshots(one.select(F.col("user_id").alias("s"), F.lit("status").alias("p"), "o", F.col("ts").alias("valid_from")))


_STATUS = "f AS (SELECT user_id AS s, MIN(event_type) AS o, ts AS valid_from FROM events GROUP BY user_id, ts), g AS (SELECT s, o, valid_from, LEAD(valid_from) OVER (PARTITION BY s ORDER BY valid_from) AS valid_to FROM f)"




@query("temporal_snapshots", f"WITH {_STATUS} SELECT s, o, valid_from, valid_to FROM g")
def temporal_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status(spark, sf_dir).select("s", "o", "valid_from", "valid_to")


@query("temporal_graph_at", f"WITH {_STATUS} SELECT s, o FROM g WHERE valid_from <= TIMESTAMP '2024-01-15' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15')")
def temporal_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.at(status(spark, sf_dir), F.lit("2024-01-15").cast("timestamp_ntz")).select("s", "o")


@query("temporal_graph_diff", f"WITH {_STATUS}, a AS (SELECT s, o FROM g WHERE valid_from <= TIMESTAMP '2024-01-10' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-10')), b AS (SELECT s, o FROM g WHERE valid_from <= TIMESTAMP '2024-01-20' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-20')) SELECT s, o, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT s, o, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def temporal_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.difference(status(spark, sf_dir), F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz")).select("s", "o", "change")


@query("temporal_overlap", f"WITH {_STATUS} SELECT s, o, valid_from FROM g WHERE valid_from < TIMESTAMP '2024-01-12' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-11')")
def temporal_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.overlapping(status(spark, sf_dir), F.lit("2024-01-11").cast("timestamp_ntz"), F.lit("2024-01-12").cast("timestamp_ntz")).select("s", "o", "valid_from")


@query("temporal_sequence", "SELECT a.user_id, a.ts AS t1, b.ts AS t2 FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'view' AND b.event_type = 'purchase'")
def temporal_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return T.sequences(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "PT6H", ["user_id"], time="ts")


@query("temporal_consecutive", "SELECT DISTINCT user_id FROM (SELECT user_id, ts, LAG(ts, 2) OVER (PARTITION BY user_id ORDER BY ts) AS t FROM events WHERE event_type = 'click') WHERE ts <= t + INTERVAL 12 HOUR")
def temporal_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.consecutive(read(spark, sf_dir, "events").where("event_type = 'click'"), 3, "PT12H", ["user_id"], time="ts")


@query("allen_relations", f"WITH {_STATUS} SELECT s, COUNT(*) FILTER (valid_to <= TIMESTAMP '2024-01-15' AND valid_from < TIMESTAMP '2024-01-15') AS before, COUNT(*) FILTER (valid_from < TIMESTAMP '2024-01-15' AND valid_to > TIMESTAMP '2024-01-15' AND valid_to < TIMESTAMP '2024-01-16') AS overlaps, COUNT(*) FILTER (valid_from > TIMESTAMP '2024-01-15' AND valid_to < TIMESTAMP '2024-01-16') AS during FROM g GROUP BY s")
def allen(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = (F.lit("2024-01-15").cast("timestamp_ntz"), F.lit("2024-01-16").cast("timestamp_ntz"))
    own = (F.col("valid_from"), F.col("valid_to"))
    return status(spark, sf_dir).groupBy("s").agg(*[F.count(F.when(T.allen(r, own, day), 1)).alias(r) for r in ("before", "overlaps", "during")])


@query("as_of_join", "SELECT a.event_id, b.ts AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT user_id, MAX(event_id) AS event_id, ts FROM events WHERE event_type = 'view' GROUP BY user_id, ts) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return T.as_of(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), ["user_id"], "ts", "ts").select("event_id", F.col("match.ts").alias("last_view"))


# -- graphs
def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from customers' to suppliers' nations, of all lineitems."""
    c, o, x, s = (read(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "supplier"))
    j = x.join(o, x["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(s, x["l_suppkey"] == s["s_suppkey"])
    return j.select(F.col("c_nationkey").cast("bigint").alias("s"), F.col("s_nationkey").cast("bigint").alias("o")).distinct()


_TRADE = "e AS (SELECT DISTINCT c_nationkey::BIGINT AS s, s_nationkey::BIGINT AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"
_RANK = ", r{i} AS (SELECT n.node, 0.15 / (SELECT COUNT(*) FROM nodes) + 0.85 * (COALESCE(SUM(r.score / d.k), 0) + (SELECT COALESCE(SUM(score), 0) FROM r{j} WHERE node NOT IN (SELECT s FROM d)) / (SELECT COUNT(*) FROM nodes)) AS score FROM nodes n LEFT JOIN e ON e.o = n.node LEFT JOIN r{j} r ON r.node = e.s LEFT JOIN d ON d.s = e.s GROUP BY n.node)"


@query("pagerank_fixed", f"WITH {_TRADE}, nodes AS (SELECT s AS node FROM e UNION SELECT o FROM e), d AS (SELECT s, COUNT(*) AS k FROM e GROUP BY s), r0 AS (SELECT node, 1.0::DOUBLE / (SELECT COUNT(*) FROM nodes) AS score FROM nodes)" + "".join(_RANK.format(i=i, j=i - 1) for i in range(1, 9)) + " SELECT node, ROUND(score, 6) AS score FROM r8")
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.pagerank(trade(spark, sf_dir), max_rounds=8, tolerance=0), 6)


@query("centrality_degrees", f"WITH {_TRADE}, n AS (SELECT s AS node FROM e UNION ALL SELECT o FROM e) SELECT node, ROUND(COUNT(*)::DOUBLE / (SELECT COUNT(*) FROM n), 6) AS score FROM n GROUP BY node")
def centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.centrality(trade(spark, sf_dir), "share"), 6)


@query("connected_components", f"WITH RECURSIVE {_TRADE}, b AS (SELECT s, o FROM e UNION SELECT o, s FROM e), t(node, m) AS (SELECT s, s FROM b UNION SELECT b.o, t.m FROM t JOIN b ON b.s = t.node) SELECT node, MIN(m) AS component FROM t GROUP BY node")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.components(trade(spark, sf_dir))


@query("triangles", f"WITH {_TRADE}, u AS (SELECT DISTINCT LEAST(s, o) AS a, GREATEST(s, o) AS b FROM e WHERE s <> o) SELECT x.a, x.b, y.b AS c FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b")
def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.triangles(trade(spark, sf_dir))


@query("skos_hierarchy", "SELECT u.node, u.depth FROM nation, LATERAL (VALUES ('urn:region:' || n_regionkey, 2), ('urn:nation:' || n_nationkey, 1)) u(node, depth) WHERE n_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 11)")
def skos(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = flat(places(spark, sf_dir).where("p = 'urn:in'")).select("s", "o")
    return G.ancestors(e, F.lit("urn:customer:11"))


@query("skos_siblings", "SELECT 'urn:nation:' || n_nationkey AS node FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 1) AND n_nationkey <> 1")
def siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = flat(places(spark, sf_dir).where("p = 'urn:in'")).select("s", "o")
    return G.siblings(e, F.lit("urn:nation:1"))


# -- search, vectors, resolution
@query("full_text_search", "SELECT p_partkey, p_name, 2::BIGINT AS rank FROM part WHERE list_contains(str_split(lower(p_name), ' '), 'red') AND list_contains(str_split(lower(p_name), ' '), 'widget')")
def full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.full_text(read(spark, sf_dir, "part"), "p_name", "Red widgets").select("p_partkey", "p_name", "rank")


@query("full_text_any_but", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '\\b(red|blue)\\b') AND NOT regexp_matches(p_name, '\\bbolt\\b')")
def full_text_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.full_text(read(spark, sf_dir, "part"), "p_name", "red blue -bolt", any_term=True).select("p_partkey")


@query("cosine_top_k", "SELECT v.vec_id, ROUND(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS similarity FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id LIMIT 20")
def cosine_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").first().embedding
    return rounded(R.nearest(e, "embedding", q, 20, "vec_id").select("vec_id", "similarity"), 4)


@query("cosine_top_k_of_each", "SELECT query, id, ROUND(similarity, 4) AS similarity FROM (SELECT q.vec_id AS query, v.vec_id AS id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS similarity, ROW_NUMBER() OVER (PARTITION BY q.vec_id ORDER BY ROUND(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) DESC, v.vec_id) AS n FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0) WHERE n <= 20")
def cosine_top_k_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return rounded(R.nearest_of_each(e, "embedding", e.where("vec_id % 20 = 0"), 20, "vec_id"), 4)


@query("rank_fusion", "WITH a AS (SELECT c_custkey AS id, ROW_NUMBER() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer), b AS (SELECT o_custkey AS id, ROW_NUMBER() OVER (ORDER BY SUM(o_totalprice) DESC, o_custkey) AS rank FROM orders GROUP BY 1) SELECT id, ROUND(SUM(p), 6) AS score FROM (SELECT id, 0.5 / (60 + rank) AS p FROM a WHERE rank <= 100 UNION ALL SELECT id, 0.5 / (60 + rank) FROM b WHERE rank <= 100) GROUP BY id")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")

    def top(df: DataFrame, key: str) -> DataFrame:  # the first hundred are few: numbering them in one task is bounded
        return df.orderBy(F.desc(key), "id").limit(100).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(key), "id")))

    a = top(c.select(F.col("c_custkey").alias("id"), "c_acctbal"), "c_acctbal")
    b = top(o.groupBy(F.col("o_custkey").alias("id")).agg(F.sum("o_totalprice").alias("t")), "t")
    return rounded(R.fused([(a, 0.5), (b, 0.5)], "id"), 6)


@query("bayesian_update", "SELECT c_custkey, ROUND((p / (1 - p) * 3) / (1 + p / (1 - p) * 3), 4) AS posterior FROM (SELECT c_custkey, (c_custkey % 10) / 20.0 AS p FROM customer)")
def bayesian(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return rounded(c.select("c_custkey", R.bayes(F.col("c_custkey") % 10 / 20.0, F.lit(3.0)).alias("posterior")), 4)


@query("entity_resolution", "WITH RECURSIVE p AS (SELECT p_partkey AS k, p_brand AS b, p_size AS z FROM part), e AS (SELECT x.k AS s, y.k AS o FROM p x JOIN p y ON x.b = y.b AND x.z = y.z AND x.k <> y.k), t(node, m) AS (SELECT s, s FROM e UNION SELECT e.o, t.m FROM t JOIN e ON e.s = t.node) SELECT node, MIN(m) AS component FROM t GROUP BY node")
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.when(F.col("p_brand").isNotNull() & F.col("p_size").isNotNull(), F.struct("p_brand", "p_size"))
    return R.resolve(R.block_links(read(spark, sf_dir, "part"), "p_partkey", block), F.lit(1.0), 0.5)


@query("entity_resolution_scored", "WITH RECURSIVE p AS (SELECT p_partkey AS k, p_brand AS b, list_distinct(str_split(lower(p_name || ' ' || p_type), ' ')) AS t FROM part), e AS (SELECT x.k AS s, y.k AS o FROM p x JOIN p y ON x.b = y.b AND x.k <> y.k AND 100 * len(list_intersect(x.t, y.t)) >= 80 * len(list_distinct(list_concat(x.t, y.t)))), t(node, m) AS (SELECT s, s FROM e UNION SELECT e.o, t.m FROM t JOIN e ON e.s = t.node) SELECT node, MIN(m) AS component FROM t GROUP BY node")
def entity_resolution_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")
    return R.resolve(R.similar_links(read(spark, sf_dir, "part"), "p_partkey", F.col("p_brand"), words, 80), F.col("score"), 0.8)


@query("bloom_dice", "SELECT p_partkey, p_type = p_name AS equal FROM part")
def bloom_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters of two columns tell which rows have equal texts without the texts."""
    from ..functions.similarity import dice

    part = spread(read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name"), "p_partkey")  # a small file would be one task
    p = part.select("p_partkey", *[R.bloom_encoded(F.col(c), b"shared key").alias(c) for c in ("p_type", "p_name")])
    return p.select("p_partkey", (dice(F.col("p_type"), F.col("p_name")) == 1.0).alias("equal"))


@query("rule_mining", "SELECT 'urn:col:o_custkey' AS body, 'urn:buyer' AS head, COUNT(*) AS support, 1.0::DOUBLE AS confidence FROM orders UNION ALL SELECT 'urn:buyer', 'urn:col:o_custkey', COUNT(*), 1.0 FROM orders")
def rule_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    a = fact(o, ("urn:orders:", "o_orderkey"), COL + "o_custkey", iri("urn:customer:", "o_custkey"))
    return R.mined_rules(a.unionByName(a.withColumn("p", F.lit("urn:buyer"))))


# -- views and streams
@query("view_refresh", "SELECT 'urn:region:' || n_regionkey AS r, COUNT(*) + (n_regionkey = 0)::BIGINT AS n FROM nation GROUP BY n_regionkey")
def view_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = QuadStore(spark, places(spark, sf_dir).where("s.lex like 'urn:nation:%'"))
    view = views.sparql_view(store, "nations_by_region", "SELECT ?r (COUNT(?n) AS ?n) WHERE { ?n <urn:in> ?r } GROUP BY ?r".replace("AS ?n", "AS ?k"))
    view.refresh()
    store.update("INSERT DATA { <urn:nation:new> <urn:in> <urn:region:0> }")
    return view.refresh().select(F.regexp_extract("r", "<([^>]*)>", 1).alias("r"), F.col("k").alias("n"))


@query("write_back_rules", "SELECT 'urn:nation:' || n_nationkey AS s, 'urn:neighbour' AS p, COUNT(*) AS n FROM nation a JOIN (SELECT n_regionkey AS r FROM nation) b ON a.n_regionkey = b.r GROUP BY n_nationkey")
def write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = QuadStore(spark, places(spark, sf_dir).where("s.lex like 'urn:nation:%'"))
    rules = views.WriteBack(store)
    rules.create("near", "CONSTRUCT { ?a <urn:neighbour> ?b } WHERE { ?a <urn:in> ?r . ?b <urn:in> ?r }", "urn:derived")
    rules.run()
    return store.quads.where("g = 'urn:derived'").groupBy(F.col("s.lex").alias("s"), "p").agg(F.count("*").alias("n"))


@query("tumbling_window", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return rounded(views.tumbling(e, "ts", "1 day", ["event_type"], [F.count("*").alias("n"), F.sum("value").alias("total")]).drop("end"))


@query("session_window", "SELECT user_id, MIN(ts) AS start, COUNT(*) AS n FROM (SELECT user_id, ts, SUM(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts < LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g")
def session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sessions(read(spark, sf_dir, "events"), "ts", "2 hours", ["user_id"], [F.count("*").alias("n")]).drop("end")


@query("streaming_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")
def streaming_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read(spark, sf_dir, "events").schema

    def daily(s: DataFrame) -> DataFrame:
        s = s.withColumn("ts", F.col("ts").cast("timestamp"))
        return views.tumbling(s, "ts", "1 day", ["event_type"], [F.count("*").alias("n")], late="2 days").drop("end")

    out = views.streamed(spark, f"{sf_dir}/events.parquet*", schema, daily, mode="complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("extvp_semi_join", "SELECT 'urn:nation:' || n_nationkey AS s, 'urn:region:' || n_regionkey AS o FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def extvp(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fact(read(spark, sf_dir, "supplier").where("s_acctbal > 9000"), ("urn:nation:", "s_nationkey"), "urn:rich", V.struct(2, F.lit("true"), A.XSD + "boolean"))
    q = places(spark, sf_dir).where("s.lex like 'urn:nation:%'").unionByName(s)
    return flat(views.extvp(q, "urn:in", "urn:rich")).select("s", "o")



