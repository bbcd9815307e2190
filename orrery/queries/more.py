"""Stores, formats, rule sets, functions, temporal facts, views and resolution over the given tables: one query an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import datalog as D
from ..operators import graph as G
from ..operators import resolution as R
from ..operators import temporal as T
from ..operators.lineage import scratch
from ..plans import algebra as A
from ..sources import rdf
from ..sources.quads import QuadStore
from ..streaming import views
from .base import query, rounded
from .base import sparql as asked
from .reasoning import _PLACES, _STATUS, _TRADE, fact, flat, iri, number, places, read, status, text, trade

_IN = "SELECT 'urn:customer:' || c_custkey AS s, 'urn:in' AS p, 'urn:nation:' || c_nationkey AS o FROM customer UNION ALL SELECT 'urn:supplier:' || s_suppkey, 'urn:in', 'urn:nation:' || s_nationkey FROM supplier UNION ALL SELECT 'urn:nation:' || n_nationkey, 'urn:in', 'urn:region:' || n_regionkey FROM nation"
_ALL = _IN + " UNION ALL SELECT 'urn:region:' || r_regionkey, 'urn:name', r_name FROM region"


def bare(df: DataFrame) -> DataFrame:
    """IRIs without brackets and plain literals without quotes."""
    return df.select(*[F.regexp_replace(c, '^[<"]|[>"]$', "").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def nations(spark: SparkSession, sf_dir: str, graph: str | None = None) -> DataFrame:
    return fact(read(spark, sf_dir, "nation"), ("urn:nation:", "n_nationkey"), "urn:in", iri("urn:region:", "n_regionkey")).withColumn("g", F.lit(graph).cast("string"))


# -- formats: written, then read again
def _round_trip(lines: DataFrame, ending: str) -> DataFrame:
    spark = lines.sparkSession
    path = scratch(spark)
    lines.write.text(path)
    return rdf.read_lines(spark, path) if ending in ("nt", "nq") else rdf.read_file(spark, path, None, ending)


@query("ntriples_round_trip", _ALL)
def ntriples_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(_round_trip(rdf.ntriples_lines(places(spark, sf_dir)), "nt"))


@query("nquads_round_trip", "SELECT 'urn:nation:' || n_nationkey AS s, 'urn:in' AS p, 'urn:region:' || n_regionkey AS o, 'urn:g' AS g FROM nation")
def nquads_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _round_trip(rdf.ntriples_lines(nations(spark, sf_dir, "urn:g"), True), "nq")
    return got.select(F.col("s.lex").alias("s"), "p", F.col("o.lex").alias("o"), "g")


@query("turtle_round_trip", _ALL)
def turtle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(_round_trip(rdf.turtle_lines(places(spark, sf_dir)), "ttl"))


# -- stores
@query("pattern_lookup", "SELECT 'urn:region:' || r_regionkey AS s, 'urn:name' AS p, r_name AS o FROM region")
def pattern_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(QuadStore(spark, places(spark, sf_dir)).find(p="urn:name"))


@query("incoming_of_object", "SELECT 'urn:customer:' || c_custkey AS s FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'urn:supplier:' || s_suppkey FROM supplier WHERE s_nationkey = 3")
def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QuadStore(spark, places(spark, sf_dir)).find(o=A.Iri("urn:nation:3")).select(F.col("s.lex").alias("s"))


@query("all_nodes", f"WITH t AS ({_ALL}) SELECT COUNT(*) AS n FROM (SELECT s FROM t UNION SELECT o FROM t)")
def all_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QuadStore(spark, places(spark, sf_dir)).select("SELECT (COUNT(DISTINCT ?x) AS ?n) WHERE { ?x <urn:none>? ?y }").select(F.regexp_extract("n", r"(\d+)", 1).cast("bigint").alias("n"))


@query("rdf_patch", "SELECT 'urn:nation:' || n_nationkey AS s, 'urn:in' AS p, 'urn:region:' || n_regionkey AS o FROM nation WHERE n_nationkey <> 4 UNION ALL SELECT 'urn:nation:new', 'urn:in', 'urn:region:1'")
def rdf_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = QuadStore(spark, nations(spark, sf_dir))
    region = store.find(s=A.Iri("urn:nation:4")).first().o.lex
    store.patch(f"TX .\nD <urn:nation:4> <urn:in> <{region}> .\nA <urn:nation:new> <urn:in> <urn:region:1> .\nTC .")
    return flat(store.quads)


@query("point_in_time", "SELECT 'before' AS at, COUNT(*) AS n FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 'now', COUNT(*) FROM nation")
def point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = QuadStore(spark, nations(spark, sf_dir))
    before = store.quads.agg(F.max("sid")).first()[0]
    store.update("DELETE { ?n <urn:in> <urn:region:2> } INSERT { ?n <urn:was> <urn:region:2> } WHERE { ?n <urn:in> <urn:region:2> }")
    now = store.quads.agg(F.lit("now").alias("at"), F.count("*").alias("n"))
    store.point_in_time(before)
    return store.quads.agg(F.lit("before").alias("at"), F.count("*").alias("n")).unionByName(now)


@query("erase_subject", _ALL.replace("FROM nation", "FROM nation WHERE n_regionkey <> 1").replace("FROM region", "FROM region WHERE r_regionkey <> 1"))
def erase_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = QuadStore(spark, places(spark, sf_dir))
    store.erase("urn:region:1")
    return flat(store.quads)


@query("update_data_and_clear", "SELECT 'urn:x' AS s, 'urn:p' AS p, '2' AS o, NULL::VARCHAR AS g UNION ALL SELECT 'urn:nation:' || n_nationkey, 'urn:in', 'urn:region:' || n_regionkey, 'urn:b' FROM nation")
def update_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = QuadStore(spark, nations(spark, sf_dir))
    store.update("CREATE GRAPH <urn:b> ; ADD DEFAULT TO <urn:a> ; ADD DEFAULT TO <urn:b> ; CLEAR DEFAULT ; DROP GRAPH <urn:a> ; INSERT DATA { <urn:x> <urn:p> 1, 2 } ; DELETE DATA { <urn:x> <urn:p> 1 }")
    return store.quads.select(F.col("s.lex").alias("s"), "p", F.col("o.lex").alias("o"), "g")


@query("deduplicate", "SELECT 'urn:customer:' || c_custkey AS s, 'urn:in' AS p, 'urn:nation:' || c_nationkey AS o FROM customer")
def deduplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = fact(read(spark, sf_dir, "customer"), ("urn:customer:", "c_custkey"), "urn:in", iri("urn:nation:", "c_nationkey"))
    store = QuadStore(spark, once.unionByName(once))
    store.add(once)
    store.compact()
    return flat(store.quads)


@query("from_named_graphs", "SELECT 'urn:nation:' || n_nationkey AS n, 'urn:b' AS g FROM nation")
def from_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = QuadStore(spark, nations(spark, sf_dir, "urn:a").unionByName(nations(spark, sf_dir, "urn:b")).unionByName(nations(spark, sf_dir, "urn:c")))
    return bare(store.select("SELECT ?n ?g FROM <urn:a> FROM NAMED <urn:b> WHERE { ?n <urn:in> ?r . GRAPH ?g { ?n <urn:in> ?r } }"))


@query("path_in_graph", "SELECT 'urn:supplier:' || s_suppkey AS x, 'urn:region:' || n_regionkey AS y FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def path_in_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = places(spark, sf_dir).where("not s.lex like 'urn:customer:%'").withColumn("g", F.lit("urn:g"))
    store = QuadStore(spark, inside.unionByName(nations(spark, sf_dir, "urn:other").withColumn("o", V.struct(0, F.lit("urn:nowhere")))))
    return bare(store.select("SELECT ?x ?y WHERE { GRAPH <urn:g> { ?x <urn:in>/<urn:in>+ ?y } }"))


@query("group_by_in_graph", "SELECT g, 'urn:region:' || n_regionkey AS r, COUNT(*) AS k FROM nation, (VALUES ('urn:a'), ('urn:b')) v(g) GROUP BY ALL")
def group_in_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = QuadStore(spark, nations(spark, sf_dir, "urn:a").unionByName(nations(spark, sf_dir, "urn:b")))
    return bare(store.select("SELECT ?g ?r (COUNT(?n) AS ?k) WHERE { GRAPH ?g { ?n <urn:in> ?r } } GROUP BY ?g ?r"))


@query("confidence_of_statements", "SELECT 'urn:nation:' || n_nationkey AS n, ROUND(CASE WHEN n_nationkey % 2 = 0 THEN 0.4 ELSE 1.0 END, 2) AS c FROM nation")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = QuadStore(spark, nations(spark, sf_dir))
    even = F.regexp_extract("s.lex", r"(\d+)$", 1).cast("int") % 2 == 0
    store.confidences = store.quads.where(even).select("s", "p", "o", "g").withColumns({"model": F.lit("m"), "confidence": F.lit(0.4)})
    return rounded(bare(store.select("SELECT ?n (<http://orrery.example/fn/confidence>(?n, <urn:in>, ?r) AS ?c) WHERE { ?n <urn:in> ?r }")))


# -- rules
def _derived(spark: SparkSession, facts: DataFrame, axioms: list[tuple[str, str, str]], rules: str) -> DataFrame:
    rows = spark.createDataFrame(axioms, "a string, p string, b string").select(V.struct(0, F.col("a")).alias("s"), "p", V.struct(0, F.col("b")).alias("o"), F.lit(None).cast("string").alias("g"))
    return flat(D.infer(facts.unionByName(rows) if axioms else facts, D.rule_set(rules)).derived)


@query("rules_owl_rl", "SELECT 'urn:region:' || n_regionkey AS s, 'urn:holds' AS p, 'urn:nation:' || n_nationkey AS o FROM nation")
def owl_rl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, nations(spark, sf_dir), [("urn:holds", A.OWL + "inverseOf", "urn:in")], "owl-rl").where("p = 'urn:holds'")


@query("rules_owl_ql", "SELECT 'urn:region:' || n_regionkey AS s, 'urn:in' AS p, 'urn:nation:' || n_nationkey AS o FROM nation")
def owl_ql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, nations(spark, sf_dir), [("urn:in", A.RDF + "type", A.OWL + "SymmetricProperty")], "owl-ql").where("p = 'urn:in'")


@query("rules_owl_el", "SELECT 'urn:nation:' || n_nationkey AS s, 'urn:Place' AS o FROM nation")
def owl_el(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = nations(spark, sf_dir).unionByName(fact(read(spark, sf_dir, "region"), ("urn:region:", "r_regionkey"), A.RDF + "type", V.struct(0, F.lit("urn:Region"))))
    axioms = [("urn:Place", A.OWL + "someValuesFrom", "urn:Region"), ("urn:Place", A.OWL + "onProperty", "urn:in")]
    return _derived(spark, facts, axioms, "owl-el").where("o = 'urn:Place' and s like 'urn:nation:%'").select("s", "o")


def _broader(spark: SparkSession, sf_dir: str, p: str = "broader") -> DataFrame:
    return places(spark, sf_dir).where("p = 'urn:in'").withColumn("p", F.lit(A.SKOS + p))


@query("rules_skos", _IN.replace("SELECT 'urn:customer:' || c_custkey AS s, 'urn:in' AS p, 'urn:nation:' || c_nationkey AS o", "SELECT 'urn:nation:' || c_nationkey AS s, 'urn:customer:' || c_custkey AS o").replace("SELECT 'urn:supplier:' || s_suppkey, 'urn:in', 'urn:nation:' || s_nationkey", "SELECT 'urn:nation:' || s_nationkey, 'urn:supplier:' || s_suppkey").replace("SELECT 'urn:nation:' || n_nationkey, 'urn:in', 'urn:region:' || n_regionkey", "SELECT 'urn:region:' || n_regionkey, 'urn:nation:' || n_nationkey"))
def skos_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, _broader(spark, sf_dir), [], "skos").where(F.col("p") == A.SKOS + "narrower").select("s", "o")


@query("rules_skos_transitive", f"WITH RECURSIVE {_PLACES}, t(s, o) AS (SELECT * FROM e UNION SELECT t.s, e.o FROM t JOIN e ON t.o = e.s) SELECT s, o FROM t")
def skos_transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, _broader(spark, sf_dir), [], "skos-transitive").where(F.col("p") == A.SKOS + "broaderTransitive").select("s", "o")


@query("rules_dcterms", "SELECT 'urn:region:' || n_regionkey AS s, 'urn:nation:' || n_nationkey AS o FROM nation")
def dcterms(spark: SparkSession, sf_dir: str) -> DataFrame:
    part_of = nations(spark, sf_dir).withColumn("p", F.lit("http://purl.org/dc/terms/isPartOf"))
    return _derived(spark, part_of, [], "dcterms").where("p = 'http://purl.org/dc/terms/hasPart'").select("s", "o")


@query("rules_foaf", "SELECT DISTINCT 'urn:customer:' || c_custkey AS s, u.o FROM customer, (VALUES ('http://xmlns.com/foaf/0.1/Person'), ('http://xmlns.com/foaf/0.1/Agent')) u(o) UNION SELECT DISTINCT 'urn:nation:' || c_nationkey, u.o FROM customer, (VALUES ('http://xmlns.com/foaf/0.1/Person'), ('http://xmlns.com/foaf/0.1/Agent')) u(o)")
def foaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    knows = fact(read(spark, sf_dir, "customer"), ("urn:customer:", "c_custkey"), "http://xmlns.com/foaf/0.1/knows", iri("urn:nation:", "c_nationkey"))
    return _derived(spark, knows, [], "foaf").where(F.col("p") == A.RDF + "type").select("s", "o")


@query("rules_schema", "SELECT 'urn:region:' || n_regionkey AS s, 'urn:nation:' || n_nationkey AS o FROM nation")
def schema_org(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = nations(spark, sf_dir).withColumn("p", F.lit("https://schema.org/containedInPlace"))
    return _derived(spark, inside, [], "schema").where("p = 'https://schema.org/containsPlace'").select("s", "o")


@query("rules_skosxl", "SELECT 'urn:region:' || r_regionkey AS s, r_name AS o FROM region")
def skosxl(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, xl = read(spark, sf_dir, "region"), "http://www.w3.org/2008/05/skos-xl#"
    facts = fact(r, ("urn:region:", "r_regionkey"), xl + "prefLabel", iri("urn:label:", "r_regionkey")).unionByName(fact(r, ("urn:label:", "r_regionkey"), xl + "literalForm", text("r_name")))
    return _derived(spark, facts, [], "skosxl").where(F.col("p") == A.SKOS + "prefLabel").select("s", "o")


@query("datalog_demand", f"WITH RECURSIVE {_PLACES}, t(s, o) AS (SELECT * FROM e UNION SELECT t.s, e.o FROM t JOIN e ON t.o = e.s) SELECT s, o FROM t")
def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = D.parse_rules("?x <urn:within> ?y :- ?x <urn:in> ?y . ?x <urn:within> ?z :- ?x <urn:within> ?y, ?y <urn:in> ?z . ?x <urn:unasked> ?y :- ?x <urn:within> ?y .")
    return flat(D.infer_demand(places(spark, sf_dir), rules, [A.Triple(A.Var("x"), A.Iri("urn:within"), A.Var("y"))]).derived).select("s", "o")


@query("datalog_aggregates", "SELECT 'urn:nation:' || c_nationkey AS s, 'urn:' || w AS p, ROUND(v, 2) AS o FROM (SELECT c_nationkey, UNNEST(['total', 'least', 'most', 'mean']) AS w, UNNEST([SUM(c_acctbal), MIN(c_acctbal), MAX(c_acctbal), AVG(c_acctbal)]) AS v FROM customer GROUP BY c_nationkey)")
def aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = fact(read(spark, sf_dir, "customer").withColumn("b", F.concat_ws(" ", "c_custkey", "c_acctbal")), ("urn:nation:", "c_nationkey"), "urn:balance", number("c_acctbal", "double"))
    rules = " ".join(f"?n <urn:{w}> ?k :- {f}(?b WHERE ?n <urn:balance> ?b) = ?k ." for w, f in (("total", "SUM"), ("least", "MIN"), ("most", "MAX"), ("mean", "AVG")))
    return rounded(flat(D.infer(facts, D.parse_rules(rules)).derived).withColumn("o", F.col("o").cast("double")))


@query("datalog_lattice_max", f"WITH RECURSIVE {_PLACES}, t(s, v) AS (SELECT 'urn:customer:' || c_custkey, c_acctbal FROM customer UNION SELECT e.o, t.v FROM t JOIN e ON e.s = t.s) SELECT s, ROUND(MAX(v), 2) AS v FROM t GROUP BY 1")
def lattice_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = flat(places(spark, sf_dir).where("p = 'urn:in'")).select("s", "o")
    v = read(spark, sf_dir, "customer").select(F.concat(F.lit("urn:customer:"), "c_custkey").alias("s"), F.col("c_acctbal").alias("v"))
    return rounded(D.lattice(e, v, "max"))


# -- hierarchies
@query("skos_descendants", "SELECT 'urn:nation:' || n_nationkey AS node, 1 AS depth FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'urn:customer:' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 UNION ALL SELECT 'urn:supplier:' || s_suppkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1")
def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.descendants(flat(places(spark, sf_dir).where("p = 'urn:in'")).select("s", "o"), F.lit("urn:region:1"))


@query("skos_related", "SELECT 'urn:region:' || n_regionkey AS node FROM nation WHERE n_nationkey = 4")
def related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.related(_broader(spark, sf_dir, "related").where("not s.lex like 'urn:customer:%' and not s.lex like 'urn:supplier:%'"), V.struct(0, F.lit("urn:nation:4"))).select(F.col("node.lex").alias("node"))


@query("skos_labels", "SELECT 'urn:nation:' || n_nationkey AS node, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS label FROM nation")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, key, p = read(spark, sf_dir, "nation"), ("urn:nation:", "n_nationkey"), A.SKOS + "prefLabel"
    plain = fact(n, key, p, text("n_name"))
    english = fact(n.where("n_nationkey % 2 = 0").withColumn("x", F.lower("n_name")), key, p, V.struct(2, F.col("x"), A.RDF + "langString", "en"))
    return G.labels(plain.unionByName(english))


@query("centrality_in_out", f"WITH {_TRADE} SELECT o AS node, 'in' AS metric, COUNT(*)::DOUBLE AS score FROM e GROUP BY o UNION ALL SELECT s, 'out', COUNT(*) FROM e GROUP BY s")
def in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = trade(spark, sf_dir)
    return G.centrality(e, "in").withColumn("metric", F.lit("in")).unionByName(G.centrality(e, "out").withColumn("metric", F.lit("out"))).select("node", "metric", "score")


# -- temporal
@query("temporal_within", f"WITH {_STATUS} SELECT s, o, valid_from FROM g WHERE valid_from >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY")
def within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.within(status(spark, sf_dir), F.lit("2024-01-20").cast("timestamp_ntz"), "P7D").select("s", "o", "valid_from")


@query("temporal_retract", f"WITH {_STATUS} SELECT s, o, valid_from, CASE WHEN valid_to IS NULL AND s % 2 = 0 THEN TIMESTAMP '2030-01-01' ELSE valid_to END AS valid_to FROM g")
def retracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = status(spark, sf_dir)
    return T.retracted(facts, facts.where("s % 2 = 0"), F.lit("2030-01-01").cast("timestamp_ntz")).select("s", "o", "valid_from", "valid_to")


@query("temporal_longer_than", f"WITH {_STATUS} SELECT s, o, valid_from FROM g WHERE valid_to > valid_from + INTERVAL 12 HOUR")
def longer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.longer_than(status(spark, sf_dir), "PT12H").select("s", "o", "valid_from")


# -- functions
asked("functions_geometry", "SELECT ?p (geof:sfWithin(?g, 'POLYGON((10.5 -1, 20.5 -1, 20.5 1, 10.5 1, 10.5 -1))') AS ?in) (geof:distance(?g, 'POINT(0 0)') AS ?d) WHERE { ?p col:p_size ?z BIND(CONCAT('POINT(', STR(?z), ' 0)') AS ?g) }", "SELECT 'urn:part:' || p_partkey AS p, p_size BETWEEN 11 AND 20 AS \"in\", p_size::DOUBLE AS d FROM part", "part")
asked("functions_constructors", "SELECT ?r (DATATYPE(STRDT(?n, xsd:token)) AS ?t) (STR(IRI(CONCAT('urn:x:', ?n))) AS ?i) (STRLEN(STRUUID()) AS ?u) (STRSTARTS(STR(UUID()), 'urn:uuid:') AS ?v) (ISBLANK(BNODE()) AS ?b) ((RAND() < 1.0) AS ?x) ((YEAR(NOW()) > 2000) AS ?y) WHERE { ?r col:r_name ?n }", "SELECT 'urn:region:' || r_regionkey AS r, 'http://www.w3.org/2001/XMLSchema#token' AS t, 'urn:x:' || r_name AS i, 36::BIGINT AS u, true AS v, true AS b, true AS x, true AS y FROM region", "region")
asked("functions_sign", "SELECT ?c (-?b AS ?m) (+?b AS ?p) WHERE { ?c col:c_acctbal ?b }", "SELECT 'urn:customer:' || c_custkey AS c, ROUND(-c_acctbal, 2) AS m, ROUND(c_acctbal, 2) AS p FROM customer", "customer")
asked("functions_trigram", "SELECT ?p (fn:trigram_similarity(?t, ?t) AS ?same) (fn:fuzzy_match(?t, 'zzqx') AS ?none) WHERE { ?p col:p_type ?t }", "SELECT 'urn:part:' || p_partkey AS p, 1.0::DOUBLE AS same, 0.0::DOUBLE AS none FROM part", "part")


@query("approximate_distinct", "SELECT l_returnflag AS f, true AS near FROM lineitem GROUP BY l_returnflag")
def approximate_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HyperLogLog counts of distinct orders lie within a tenth of the exact ones (its own error is 5 % a standard deviation at most)."""
    # a sketch of repeated values is that of the distinct ones; over both at once, Spark keeps a sketch for each pair
    pairs = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("f"), "l_orderkey").distinct()
    x = pairs.groupBy("f").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("a"), F.count("l_orderkey").alias("n"))
    return x.select("f", (F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n")).alias("near"))


# -- views, streams, resolution
@query("sliding_window", "SELECT s AS start, event_type, COUNT(*) AS n FROM (SELECT event_type, UNNEST([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS s FROM events) GROUP BY 1, 2")
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sliding(read(spark, sf_dir, "events"), "ts", "1 day", "12 hours", ["event_type"], [F.count("*").alias("n")]).drop("end")


@query("change_capture", "SELECT 'delete' AS op, 'urn:in' AS p, COUNT(*) AS n FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'insert', 'urn:was', COUNT(*) FROM nation WHERE n_regionkey = 2")
def change_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = QuadStore(spark, nations(spark, sf_dir))
    store.update("DELETE { ?n <urn:in> <urn:region:2> } INSERT { ?n <urn:was> <urn:region:2> } WHERE { ?n <urn:in> <urn:region:2> }")
    return views.changes(store).groupBy("op", "p").agg(F.count("*").alias("n"))


@query("conflict_winners", "SELECT 'urn:nation:' || n_nationkey AS s, 'urn:region:' || n_regionkey AS o FROM nation")
def conflict_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = nations(spark, sf_dir)
    other = told.withColumn("o", V.struct(0, F.lit("urn:region:other")))
    both = told.withColumn("rank", F.lit(1)).unionByName(other.withColumn("rank", F.lit(2)))
    return views.winners(both, [F.col("rank")]).select(F.col("s.lex").alias("s"), F.col("o.lex").alias("o"))


@query("datalog_view", f"WITH RECURSIVE {_PLACES}, t(s, o) AS (SELECT * FROM e UNION SELECT t.s, e.o FROM t JOIN e ON t.o = e.s) SELECT s, o FROM t")
def datalog_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = QuadStore(spark, places(spark, sf_dir))
    rules = D.parse_rules("?x <urn:within> ?y :- ?x <urn:in> ?y . ?x <urn:within> ?z :- ?x <urn:within> ?y, ?y <urn:in> ?z .")
    return flat(views.datalog_view(store, "within", rules).refresh().where("p = 'urn:within'")).select("s", "o")


@query("cluster_evaluation", "WITH c AS (SELECT c_nationkey AS f, c_nationkey % 5 AS g, COUNT(*) AS n FROM customer GROUP BY ALL), f AS (SELECT f, SUM(n) AS s FROM c GROUP BY f), g AS (SELECT g, SUM(n) AS s FROM c GROUP BY g), t AS (SELECT SUM(n * (n - 1) / 2) AS tp, (SELECT SUM(s * (s - 1) / 2) FROM f) AS nf, (SELECT SUM(s * (s - 1) / 2) FROM g) AS ng, SUM(n * n / f.s) / SUM(n) AS bp, SUM(n * n / g.s) / SUM(n) AS br FROM c JOIN f ON c.f = f.f JOIN g ON c.g = g.g) SELECT ROUND(tp / nf, 4) AS \"precision\", ROUND(tp / ng, 4) AS recall, ROUND(bp, 4) AS b3_precision, ROUND(br, 4) AS b3_recall, ROUND(2 * bp * br / (bp + br), 4) AS b3_f1 FROM t")
def cluster_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    found, gold = c.select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("component")), c.select(F.col("c_custkey").alias("node"), (F.col("c_nationkey") % 5).alias("component"))
    return rounded(R.evaluated(found, gold).select("precision", "recall", "b3_precision", "b3_recall", "b3_f1"), 4)


# -- relational mappings and results as text
_MAPPING = """@prefix rr: <http://www.w3.org/ns/r2rml#> .
<urn:map:nation> rr:logicalTable [ rr:tableName "nation" ] ; rr:subjectMap [ rr:template "urn:nation:{n_nationkey}" ; rr:class <urn:Nation> ] ;
  rr:predicateObjectMap [ rr:predicate <urn:name> ; rr:objectMap [ rr:column "n_name" ] ] , [ rr:predicate <urn:key> ; rr:objectMap [ rr:column "n_nationkey" ] ] ,
    [ rr:predicate <urn:in> ; rr:objectMap [ rr:parentTriplesMap <urn:map:region> ; rr:joinCondition [ rr:child "n_regionkey" ; rr:parent "r_regionkey" ] ] ] .
<urn:map:region> rr:logicalTable [ rr:tableName "region" ] ; rr:subjectMap [ rr:template "urn:region:{r_regionkey}" ; rr:graph <urn:g> ] ;
  rr:predicateObjectMap [ rr:predicate <urn:label> ; rr:objectMap [ rr:template "region {r_name}" ; rr:termType rr:Literal ; rr:language "en" ] ] .
<urn:map:customer> rr:logicalTable [ rr:tableName "customer" ] ; rr:subjectMap [ rr:template "urn:customer:{c_custkey}" ] ;
  rr:predicateObjectMap [ rr:predicate <urn:in> ; rr:objectMap [ rr:template "urn:nation:{c_nationkey}" ] ] ."""


@query("r2rml_mapping", "SELECT 'urn:nation:' || n_nationkey AS s, u.p, u.o, u.dt, NULL::VARCHAR AS g FROM nation, LATERAL (VALUES ('http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'urn:Nation', ''), ('urn:name', n_name, 'http://www.w3.org/2001/XMLSchema#string'), ('urn:key', n_nationkey::VARCHAR, 'http://www.w3.org/2001/XMLSchema#integer'), ('urn:in', 'urn:region:' || n_regionkey, '')) u(p, o, dt) UNION ALL SELECT 'urn:region:' || r_regionkey, 'urn:label', 'region ' || r_name, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString', 'urn:g' FROM region UNION ALL SELECT 'urn:customer:' || c_custkey, 'urn:in', 'urn:nation:' || c_nationkey, '', NULL FROM customer")
def r2rml_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.r2rml import Mapping

    got = Mapping(_MAPPING).quads(lambda name: read(spark, sf_dir, name))
    dt = F.when(F.col("o.dt") == V.STRING, A.XSD + "string").otherwise(F.col("o.dt"))
    return got.select(F.col("s.lex").alias("s"), "p", F.col("o.lex").alias("o"), dt.alias("dt"), "g")


@query("results_csv", "SELECT 'urn:customer:' || c_custkey || ',' || c_name || ',' || c_nationkey || ',\"a, \"\"b\"\"\"' AS value FROM customer")
def results_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.results import csv_lines

    c = read(spark, sf_dir, "customer")
    return csv_lines(c.select(F.concat(F.lit("<urn:customer:"), "c_custkey", F.lit(">")).alias("c"), F.concat(F.lit('"'), "c_name", F.lit('"@en')).alias("n"), F.col("c_nationkey"), F.lit('a, "b"').alias("x")))


@query("results_tsv", "SELECT '<urn:customer:' || c_custkey || '>' || chr(9) || c_name || chr(9) || 'a\\tb' AS value FROM customer")
def results_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.results import tsv_lines

    c = read(spark, sf_dir, "customer")
    return tsv_lines(c.select(F.concat(F.lit("<urn:customer:"), "c_custkey", F.lit(">")).alias("c"), "c_name", F.lit("a\tb").alias("x")))
