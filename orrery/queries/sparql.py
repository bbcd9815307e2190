"""SPARQL over the relational tables seen as a graph, by operator."""

from __future__ import annotations

from .base import sparql as q

# -- scans, filters, expressions
q("scan_predicate", "SELECT ?s ?name WHERE { ?s col:c_name ?name }", "SELECT 'urn:customer:' || c_custkey AS s, c_name AS name FROM customer", "customer")
q("scan_all_predicates", "SELECT ?s ?p (STR(?o) AS ?v) WHERE { ?s ?p ?o }", """
  SELECT 'urn:region:' || r_regionkey AS s, u.p, u.v FROM region, LATERAL (VALUES ('urn:col:r_regionkey', r_regionkey::VARCHAR), ('urn:col:r_name', r_name), ('http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'urn:class:region')) u(p, v)""", "region")
q("scan_subject", "SELECT ?p (STR(?o) AS ?v) WHERE { n:7 ?p ?o }", """
  SELECT u.p, u.v FROM nation, LATERAL (VALUES ('urn:col:n_nationkey', n_nationkey::VARCHAR), ('urn:col:n_name', n_name), ('urn:col:n_regionkey', 'urn:region:' || n_regionkey), ('http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'urn:class:nation')) u(p, v) WHERE n_nationkey = 7""", "nation")
q("scan_object", "SELECT ?s ?p WHERE { ?s ?p r:2 }", "SELECT 'urn:nation:' || n_nationkey AS s, 'urn:col:n_regionkey' AS p FROM nation WHERE n_regionkey = 2", "nation region")
q("sparql_group_by", "SELECT ?seg (COUNT(?o) AS ?n) (SUM(?t) AS ?total) WHERE { ?o col:o_custkey ?c ; col:o_totalprice ?t . ?c col:c_mktsegment ?seg } GROUP BY ?seg", "SELECT c_mktsegment AS seg, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1", "orders customer")
q("filter_range", "SELECT ?o ?t WHERE { ?o col:o_totalprice ?t FILTER(?t >= 100000 && ?t < 150000) }", "SELECT 'urn:orders:' || o_orderkey AS o, ROUND(o_totalprice, 2) AS t FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 150000", "orders")
q("filter_in", "SELECT ?o WHERE { ?o col:o_orderpriority ?p ; col:o_orderstatus ?st FILTER(?p IN ('1-URGENT', '2-HIGH') && ?st NOT IN ('F')) }", "SELECT 'urn:orders:' || o_orderkey AS o FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F')", "orders")
q("filter_or_not", "SELECT ?c WHERE { ?c col:c_acctbal ?b ; col:c_mktsegment ?m FILTER(?b < -500 || !(?m = 'BUILDING' || ?b < 9000)) }", "SELECT 'urn:customer:' || c_custkey AS c FROM customer WHERE c_acctbal < -500 OR NOT (c_mktsegment = 'BUILDING' OR c_acctbal < 9000)", "customer")
q("filter_error_is_false", "SELECT ?c WHERE { ?c col:c_name ?n ; col:c_acctbal ?b FILTER(?n + 1 > 0 || ?b > 9900) }", "SELECT 'urn:customer:' || c_custkey AS c FROM customer WHERE c_acctbal > 9900", "customer")
q("filter_dates", "SELECT ?o ?d WHERE { ?o col:o_orderdate ?d FILTER(?d >= xsd:dateTime('1997-01-01T00:00:00') && ?d < xsd:dateTime('1997-02-01T00:00:00')) }", "SELECT 'urn:orders:' || o_orderkey AS o, o_orderdate AS d FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-02-01'", "orders")
q("extend_bind", "SELECT ?l ?net WHERE { ?x col:l_orderkey ?l ; col:l_extendedprice ?p ; col:l_discount ?d BIND(?p * (1 - ?d) AS ?net) }", "SELECT 'urn:orders:' || l_orderkey AS l, ROUND(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem", "lineitem", 4)
q("if_coalesce", "SELECT ?c ?k (COALESCE(?nothing, ?m, 'none') AS ?v) WHERE { ?c col:c_acctbal ?b ; col:c_mktsegment ?m BIND(IF(?b < 0, 'debt', IF(?b < 5000, 'some', 'much')) AS ?k) }", "SELECT 'urn:customer:' || c_custkey AS c, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'much' END AS k, c_mktsegment AS v FROM customer", "customer")
q("bound_optional", "SELECT ?c (BOUND(?o) AS ?has) WHERE { ?c a class:customer OPTIONAL { ?o col:o_custkey ?c ; col:o_totalprice ?t FILTER(?t > 250000) } }", "SELECT 'urn:customer:' || c_custkey AS c, o_orderkey IS NOT NULL AS has FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) ON o_custkey = c_custkey", "customer orders")
q("arithmetic", "SELECT ?p (?z + 1 AS ?a) (?z - 0.5 AS ?b) (?z * 2 AS ?c) (?z / 4 AS ?d) (?r / 0 AS ?e) (-?z AS ?f) WHERE { ?p col:p_size ?z ; col:p_retailprice ?r }", "SELECT 'urn:part:' || p_partkey AS p, p_size::BIGINT + 1 AS a, p_size - 0.5::DOUBLE AS b, p_size::BIGINT * 2 AS c, ROUND(p_size / 4.0::DOUBLE, 2) AS d, CAST(NULL AS DOUBLE) AS e, -p_size::BIGINT AS f FROM part", "part")

# -- joins
q("bgp_star", "SELECT ?o ?st ?t ?p WHERE { ?o col:o_orderstatus ?st ; col:o_totalprice ?t ; col:o_orderpriority ?p }", "SELECT 'urn:orders:' || o_orderkey AS o, o_orderstatus AS st, ROUND(o_totalprice, 2) AS t, o_orderpriority AS p FROM orders", "orders")
q("bgp_chain", "SELECT ?l ?rn WHERE { ?x col:l_orderkey ?l ; col:l_quantity 49.0e0 . ?l col:o_custkey ?c . ?c col:c_nationkey ?n . ?n col:n_regionkey ?r . ?r col:r_name ?rn }", "SELECT 'urn:orders:' || l_orderkey AS l, r_name AS rn FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_quantity = 49", "lineitem orders customer nation region")
q("bgp_snowflake", "SELECT ?nn (SUM(?p * (1 - ?d)) AS ?rev) WHERE { ?x col:l_orderkey ?o ; col:l_suppkey ?s ; col:l_extendedprice ?p ; col:l_discount ?d . ?o col:o_custkey ?c . ?c col:c_nationkey ?n . ?s col:s_nationkey ?n . ?n col:n_name ?nn } GROUP BY ?nn", "SELECT n_name AS nn, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS rev FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1", "lineitem orders customer supplier nation")
q("bgp_constant_object", "SELECT ?c WHERE { ?c col:c_nationkey n:3 ; col:c_mktsegment 'BUILDING' }", "SELECT 'urn:customer:' || c_custkey AS c FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING'", "customer nation")
q("bgp_repeated_variable", "SELECT ?s WHERE { ?s col:r_name ?x ; col:r_name ?x }", "SELECT 'urn:region:' || r_regionkey AS s FROM region", "region")
q("bgp_cartesian", "SELECT ?a ?b WHERE { ?x col:r_name ?a . ?y col:n_name ?b }", "SELECT r_name AS a, n_name AS b FROM region, nation", "region nation")
q("bgp_value_join", "SELECT ?a ?b WHERE { ?a col:p_size ?z ; col:p_brand ?br . ?b col:p_size ?z ; col:p_brand ?br FILTER(?a != ?b && ?z < 3) }", "SELECT 'urn:part:' || a.p_partkey AS a, 'urn:part:' || b.p_partkey AS b FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey WHERE a.p_size < 3", "part")
q("optional", "SELECT ?c ?o WHERE { ?c col:c_mktsegment 'MACHINERY' OPTIONAL { ?o col:o_custkey ?c ; col:o_orderstatus 'P' } }", "SELECT 'urn:customer:' || c_custkey AS c, 'urn:orders:' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE c_mktsegment = 'MACHINERY'", "customer orders")
q("optional_filter_scope", "SELECT ?s ?c WHERE { ?s col:s_nationkey ?n ; col:s_acctbal ?sb OPTIONAL { ?c col:c_nationkey ?n ; col:c_acctbal ?cb FILTER(?cb > ?sb + 9000) } }", "SELECT 'urn:supplier:' || s_suppkey AS s, 'urn:customer:' || c_custkey AS c FROM supplier LEFT JOIN customer ON c_nationkey = s_nationkey AND c_acctbal > s_acctbal + 9000", "supplier customer")
q("optional_twice_null_join", "SELECT ?n ?x WHERE { ?n a class:nation OPTIONAL { ?x col:s_nationkey ?n ; col:s_acctbal ?b FILTER(?b > 8000) } OPTIONAL { ?x col:s_nationkey ?n ; col:s_acctbal ?d FILTER(?d > 2000) } }", """
  SELECT 'urn:nation:' || n_nationkey AS n, 'urn:supplier:' || COALESCE(a.s_suppkey, b.s_suppkey) AS x FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 8000) a ON a.s_nationkey = n_nationkey
  LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 2000) b ON b.s_nationkey = n_nationkey AND (a.s_suppkey IS NULL OR a.s_suppkey = b.s_suppkey)""", "nation supplier")
q("minus", "SELECT ?c WHERE { ?c a class:customer MINUS { ?o col:o_custkey ?c ; col:o_totalprice ?t FILTER(?t > 200000) } }", "SELECT 'urn:customer:' || c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", "customer orders")
q("minus_no_shared_variable", "SELECT ?r WHERE { ?r a class:region MINUS { ?x col:n_name ?y } }", "SELECT 'urn:region:' || r_regionkey AS r FROM region", "region nation")
q("exists", "SELECT ?c WHERE { ?c col:c_mktsegment 'FURNITURE' FILTER EXISTS { ?o col:o_custkey ?c ; col:o_orderpriority '1-URGENT' } }", "SELECT 'urn:customer:' || c_custkey AS c FROM customer WHERE c_mktsegment = 'FURNITURE' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')", "customer orders")
q("not_exists_correlated", "SELECT ?s ?b WHERE { ?s col:s_acctbal ?b ; col:s_nationkey ?n FILTER NOT EXISTS { ?z col:s_nationkey ?n ; col:s_acctbal ?zb FILTER(?zb > ?b) } }", "SELECT 'urn:supplier:' || s_suppkey AS s, ROUND(s_acctbal, 2) AS b FROM supplier a WHERE NOT EXISTS (SELECT 1 FROM supplier z WHERE z.s_nationkey = a.s_nationkey AND z.s_acctbal > a.s_acctbal)", "supplier nation")
q("exists_under_or", "SELECT ?n WHERE { ?n col:n_name ?nn FILTER(?nn = 'NATION_1' || EXISTS { ?s col:s_nationkey ?n ; col:s_acctbal ?b FILTER(?b > 9000) }) }", "SELECT 'urn:nation:' || n_nationkey AS n FROM nation WHERE n_name = 'NATION_1' OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)", "nation supplier")
q("lateral_top2", "SELECT ?n ?s ?b WHERE { ?n a class:nation LATERAL { SELECT ?n ?s ?b WHERE { ?s col:s_nationkey ?n ; col:s_acctbal ?b } ORDER BY DESC(?b) LIMIT 2 } }", "SELECT 'urn:nation:' || n_nationkey AS n, 'urn:supplier:' || s_suppkey AS s, ROUND(s_acctbal, 2) AS b FROM nation, LATERAL (SELECT * FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_acctbal DESC LIMIT 2)", "nation supplier")
q("triangle_join", "SELECT DISTINCT ?c ?s ?n WHERE { ?x col:l_orderkey ?o ; col:l_suppkey ?s . ?o col:o_custkey ?c . ?c col:c_nationkey ?n . ?s col:s_nationkey ?n }", "SELECT DISTINCT 'urn:customer:' || c_custkey AS c, 'urn:supplier:' || s_suppkey AS s, 'urn:nation:' || c_nationkey AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey", "lineitem orders customer supplier nation")
q("values_join", "SELECT ?c ?m ?w WHERE { VALUES (?m ?w) { ('BUILDING' 1) ('MACHINERY' 2) (UNDEF 3) } ?c col:c_mktsegment ?m ; col:c_acctbal ?b FILTER(?b > 9500) }", "SELECT 'urn:customer:' || c_custkey AS c, c_mktsegment AS m, w FROM customer JOIN (VALUES ('BUILDING', 1::BIGINT), ('MACHINERY', 2), (NULL, 3)) v(m, w) ON v.m IS NULL OR v.m = c_mktsegment WHERE c_acctbal > 9500", "customer")

# -- aggregates
q("count_star", "SELECT (COUNT(*) AS ?n) WHERE { ?x col:l_quantity ?q }", "SELECT COUNT(*) AS n FROM lineitem", "lineitem")
q("count_distinct", "SELECT ?f (COUNT(DISTINCT ?p) AS ?n) (COUNT(?p) AS ?k) WHERE { ?x col:l_returnflag ?f ; col:l_partkey ?p } GROUP BY ?f", "SELECT l_returnflag AS f, COUNT(DISTINCT l_partkey) AS n, COUNT(l_partkey) AS k FROM lineitem GROUP BY 1", "lineitem part")
q("count_distinct_star", "SELECT (COUNT(DISTINCT *) AS ?n) WHERE { ?x col:l_returnflag ?f ; col:l_linestatus ?s . }", "SELECT COUNT(*) AS n FROM (SELECT DISTINCT * FROM lineitem)", "lineitem")
q("aggregate_all", "SELECT ?f ?s (SUM(?q) AS ?sq) (AVG(?p) AS ?ap) (MIN(?p) AS ?mn) (MAX(?p) AS ?mx) (COUNT(*) AS ?n) WHERE { ?x col:l_returnflag ?f ; col:l_linestatus ?s ; col:l_quantity ?q ; col:l_extendedprice ?p } GROUP BY ?f ?s", "SELECT l_returnflag AS f, l_linestatus AS s, ROUND(SUM(l_quantity), 2) AS sq, ROUND(AVG(l_extendedprice), 2) AS ap, ROUND(MIN(l_extendedprice), 2) AS mn, ROUND(MAX(l_extendedprice), 2) AS mx, COUNT(*) AS n FROM lineitem GROUP BY 1, 2", "lineitem")
q("sum_distinct", "SELECT ?b (SUM(DISTINCT ?z) AS ?t) (AVG(DISTINCT ?z) AS ?a) WHERE { ?p col:p_brand ?b ; col:p_size ?z } GROUP BY ?b", "SELECT p_brand AS b, SUM(DISTINCT p_size)::BIGINT AS t, ROUND(AVG(DISTINCT p_size), 2) AS a FROM part GROUP BY 1", "part")
q("having", "SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o col:o_custkey ?c } GROUP BY ?c HAVING(COUNT(?o) > 14)", "SELECT 'urn:customer:' || o_custkey AS c, COUNT(*) AS n FROM orders GROUP BY 1 HAVING COUNT(*) > 14", "orders customer")
q("group_by_expression", "SELECT ?y (COUNT(*) AS ?n) WHERE { ?o col:o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT YEAR(o_orderdate)::BIGINT AS y, COUNT(*) AS n FROM orders GROUP BY 1", "orders")
q("group_without_keys_empty", "SELECT (COUNT(*) AS ?n) (SUM(?z) AS ?t) WHERE { ?p col:p_size ?z FILTER(?z > 1000) }", "SELECT COUNT(*) AS n, COALESCE(SUM(p_size), 0)::BIGINT AS t FROM part WHERE p_size > 1000", "part")
q("sample_group_concat", "SELECT ?r (GROUP_CONCAT(?n; SEPARATOR='|') AS ?names) (SAMPLE(?n) AS ?one) WHERE { ?x col:n_regionkey ?r ; col:n_name ?n } GROUP BY ?r", "SELECT 'urn:region:' || n_regionkey AS r, STRING_AGG(n_name, '|' ORDER BY n_name) AS names, MIN(n_name) AS one FROM nation GROUP BY 1", "nation region")
q("median_mode", "SELECT ?b (MEDIAN(?z) AS ?m) (MODE(?t) AS ?k) WHERE { ?p col:p_brand ?b ; col:p_size ?z ; col:p_type ?t } GROUP BY ?b", "SELECT b, m, (SELECT p_type FROM part WHERE p_brand = b GROUP BY 1 ORDER BY COUNT(*) DESC, p_type LIMIT 1) AS k FROM (SELECT p_brand AS b, MEDIAN(p_size)::DOUBLE AS m FROM part GROUP BY 1)", "part")
q("aggregate_of_aggregate", "SELECT (MAX(?n) AS ?most) (AVG(?n) AS ?mean) WHERE { { SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o col:o_custkey ?c } GROUP BY ?c } }", "SELECT MAX(n) AS most, ROUND(AVG(n), 2) AS mean FROM (SELECT COUNT(*) AS n FROM orders GROUP BY o_custkey)", "orders customer")

# -- order, limit, distinct, set operations
q("order_limit", "SELECT ?o ?t WHERE { ?o col:o_totalprice ?t } ORDER BY DESC(?t) ?o LIMIT 25", "SELECT 'urn:orders:' || o_orderkey AS o, ROUND(o_totalprice, 2) AS t FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "orders")
q("order_offset", "SELECT ?n WHERE { ?x col:n_name ?n } ORDER BY ?n OFFSET 10 LIMIT 5", "SELECT n_name AS n FROM nation ORDER BY 1 LIMIT 5 OFFSET 10", "nation")
q("order_unbound_first", "SELECT ?c ?o WHERE { ?c col:c_nationkey n:1 OPTIONAL { ?o col:o_custkey ?c ; col:o_totalprice ?t FILTER(?t > 200000) } } ORDER BY ?o ?c LIMIT 20", "SELECT 'urn:customer:' || c_custkey AS c, 'urn:orders:' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 WHERE c_nationkey = 1 ORDER BY o_orderkey NULLS FIRST, c_custkey LIMIT 20", "customer orders nation")
q("order_by_expression", "SELECT ?p WHERE { ?p col:p_size ?z ; col:p_retailprice ?r } ORDER BY (?r / ?z) ?p LIMIT 10", "SELECT 'urn:part:' || p_partkey AS p FROM part ORDER BY p_retailprice / p_size, p_partkey LIMIT 10", "part")
q("distinct", "SELECT DISTINCT ?b ?z WHERE { ?p col:p_brand ?b ; col:p_size ?z }", "SELECT DISTINCT p_brand AS b, p_size::BIGINT AS z FROM part", "part")
q("distinct_ordered", "SELECT DISTINCT ?m WHERE { ?c col:c_mktsegment ?m } ORDER BY DESC(?m) LIMIT 3", "SELECT DISTINCT c_mktsegment AS m FROM customer ORDER BY 1 DESC LIMIT 3", "customer")
q("subquery_limit", "SELECT ?c ?n ?t WHERE { { SELECT ?c (SUM(?p) AS ?t) WHERE { ?o col:o_custkey ?c ; col:o_totalprice ?p } GROUP BY ?c ORDER BY DESC(?t) LIMIT 10 } ?c col:c_name ?n }", "SELECT 'urn:customer:' || c AS c, c_name AS n, ROUND(t, 2) AS t FROM (SELECT o_custkey AS c, SUM(o_totalprice) AS t FROM orders GROUP BY 1 ORDER BY 2 DESC LIMIT 10) JOIN customer ON c = c_custkey", "orders customer")
q("union_bag", "SELECT ?x WHERE { { ?c col:c_nationkey ?x } UNION { ?s col:s_nationkey ?x } }", "SELECT 'urn:nation:' || c_nationkey AS x FROM customer UNION ALL SELECT 'urn:nation:' || s_nationkey FROM supplier", "customer supplier nation")
q("union_missing_variables", "SELECT ?n ?cb ?sb WHERE { { ?c col:c_nationkey ?n ; col:c_acctbal ?cb FILTER(?cb > 9800) } UNION { ?s col:s_nationkey ?n ; col:s_acctbal ?sb FILTER(?sb > 9000) } }", "SELECT 'urn:nation:' || c_nationkey AS n, ROUND(c_acctbal, 2) AS cb, NULL::DOUBLE AS sb FROM customer WHERE c_acctbal > 9800 UNION ALL SELECT 'urn:nation:' || s_nationkey, NULL, ROUND(s_acctbal, 2) FROM supplier WHERE s_acctbal > 9000", "customer supplier nation")

# -- property paths
q("path_sequence", "SELECT ?c ?rn WHERE { ?c col:c_nationkey/col:n_regionkey/col:r_name ?rn }", "SELECT 'urn:customer:' || c_custkey AS c, r_name AS rn FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", "customer nation region")
q("path_inverse", "SELECT ?r ?n WHERE { ?r ^col:n_regionkey ?n }", "SELECT 'urn:region:' || n_regionkey AS r, 'urn:nation:' || n_nationkey AS n FROM nation", "nation region")
q("path_alternative_bag", "SELECT ?n ?x WHERE { ?x (col:c_nationkey|col:s_nationkey) ?n }", "SELECT 'urn:nation:' || c_nationkey AS n, 'urn:customer:' || c_custkey AS x FROM customer UNION ALL SELECT 'urn:nation:' || s_nationkey, 'urn:supplier:' || s_suppkey FROM supplier", "customer supplier nation")
q("path_same_region", "SELECT ?a ?b WHERE { ?a col:n_regionkey/^col:n_regionkey ?b }", "SELECT 'urn:nation:' || a.n_nationkey AS a, 'urn:nation:' || b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey", "nation region")
_EDGES = "edges(s, o) AS (SELECT 'urn:customer:' || c_custkey, 'urn:nation:' || c_nationkey FROM customer UNION SELECT 'urn:nation:' || n_nationkey, 'urn:region:' || n_regionkey FROM nation UNION SELECT 'urn:supplier:' || s_suppkey, 'urn:nation:' || s_nationkey FROM supplier)"
q("path_plus", "SELECT ?a ?b WHERE { ?a (col:c_nationkey|col:n_regionkey|col:s_nationkey)+ ?b }", f"WITH RECURSIVE {_EDGES}, t(s, o) AS (SELECT s, o FROM edges UNION SELECT t.s, e.o FROM t JOIN edges e ON t.o = e.s) SELECT s AS a, o AS b FROM t", "customer nation region supplier")
q("path_plus_from_constant", "SELECT ?b WHERE { <urn:customer:5> (col:c_nationkey|col:n_regionkey)+ ?b }", f"WITH RECURSIVE {_EDGES}, t(s, o) AS (SELECT s, o FROM edges WHERE s = 'urn:customer:5' UNION SELECT t.s, e.o FROM t JOIN edges e ON t.o = e.s) SELECT o AS b FROM t", "customer nation region")
q("path_plus_to_constant", "SELECT ?a WHERE { ?a (col:c_nationkey|col:n_regionkey|col:s_nationkey)+ r:3 }", f"WITH RECURSIVE {_EDGES}, t(s, o) AS (SELECT s, o FROM edges UNION SELECT t.s, e.o FROM t JOIN edges e ON t.o = e.s) SELECT s AS a FROM t WHERE o = 'urn:region:3'", "customer nation region supplier")
q("path_undirected_plus", "SELECT ?b WHERE { <urn:nation:0> (col:n_regionkey|^col:n_regionkey)+ ?b }", "WITH RECURSIVE e(s, o) AS (SELECT 'urn:nation:' || n_nationkey, 'urn:region:' || n_regionkey FROM nation UNION SELECT 'urn:region:' || n_regionkey, 'urn:nation:' || n_nationkey FROM nation), t(o) AS (SELECT o FROM e WHERE s = 'urn:nation:0' UNION SELECT e.o FROM t JOIN e ON t.o = e.s) SELECT o AS b FROM t", "nation region")
q("path_star_constant", "SELECT ?b WHERE { n:4 col:n_regionkey* ?b }", "SELECT 'urn:nation:4' AS b UNION SELECT 'urn:region:' || n_regionkey FROM nation WHERE n_nationkey = 4", "nation region")
q("path_optional", "SELECT ?b WHERE { n:4 col:n_regionkey? ?b }", "SELECT 'urn:nation:4' AS b UNION SELECT 'urn:region:' || n_regionkey FROM nation WHERE n_nationkey = 4", "nation region")
q("path_negated", "SELECT ?a (STR(?b) AS ?v) WHERE { ?a !(rdf:type|col:n_name|col:n_nationkey|col:r_name|col:r_regionkey) ?b }", "SELECT 'urn:nation:' || n_nationkey AS a, 'urn:region:' || n_regionkey AS v FROM nation", "nation region")

# -- scalar functions
q("functions_string", """SELECT ?c (STRLEN(?n) AS ?len) (SUBSTR(?n, 3, 5) AS ?sub) (UCASE(?n) AS ?up) (LCASE(?m) AS ?low) (CONCAT(?m, '-', ?n) AS ?cat) (REPLACE(?n, '[0-9]+', '#') AS ?rep) (STRBEFORE(?n, '#') AS ?bef) (STRAFTER(?n, '_') AS ?aft) (CONTAINS(?m, 'IN') AS ?has) (STRSTARTS(?m, 'BU') AS ?beg) (STRENDS(?m, 'RE') AS ?end) (REGEX(?m, '^[a-f]', 'i') AS ?rx) (ENCODE_FOR_URI(CONCAT(?m, ' &/')) AS ?enc)
  WHERE { ?c col:c_name ?n ; col:c_mktsegment ?m }""", """SELECT 'urn:customer:' || c_custkey AS c, LENGTH(c_name)::BIGINT AS len, SUBSTRING(c_name, 3, 5) AS sub, UPPER(c_name) AS up, LOWER(c_mktsegment) AS low, c_mktsegment || '-' || c_name AS cat, REGEXP_REPLACE(c_name, '[0-9]+', '#', 'g') AS rep,
  CASE WHEN STRPOS(c_name, '#') > 0 THEN SUBSTRING(c_name, 1, STRPOS(c_name, '#') - 1) ELSE '' END AS bef, CASE WHEN STRPOS(c_name, '_') > 0 THEN SUBSTRING(c_name, STRPOS(c_name, '_') + 1) ELSE '' END AS aft, CONTAINS(c_mktsegment, 'IN') AS has, STARTS_WITH(c_mktsegment, 'BU') AS beg, c_mktsegment LIKE '%RE' AS "end", REGEXP_MATCHES(c_mktsegment, '^[a-fA-F]') AS rx, c_mktsegment || '%20%26%2F' AS enc FROM customer""", "customer")
q("functions_hash", "SELECT ?n (MD5(?n) AS ?m) (SHA1(?n) AS ?a) (SHA256(?n) AS ?b) WHERE { ?x col:n_name ?n }", "SELECT n_name AS n, MD5(n_name) AS m, SHA1(n_name) AS a, SHA256(n_name) AS b FROM nation", "nation")
q("functions_hash_long", "SELECT (STRLEN(SHA384(?n)) AS ?a) (STRLEN(SHA512(?n)) AS ?b) WHERE { ?x col:n_name ?n }", "SELECT 96::BIGINT AS a, 128::BIGINT AS b FROM nation", "nation")
q("functions_numeric", "SELECT ?c (ABS(?b) AS ?a) (CEIL(?b) AS ?ce) (FLOOR(?b) AS ?fl) (ROUND(?b) AS ?ro) WHERE { ?c col:c_acctbal ?b }", "SELECT 'urn:customer:' || c_custkey AS c, ROUND(ABS(c_acctbal), 2) AS a, CEIL(c_acctbal) AS ce, FLOOR(c_acctbal) AS fl, FLOOR(c_acctbal + 0.5) AS ro FROM customer", "customer")
q("functions_datetime", "SELECT ?e (YEAR(?t) AS ?y) (MONTH(?t) AS ?m) (DAY(?t) AS ?d) (HOURS(?t) AS ?h) (MINUTES(?t) AS ?mi) (FLOOR(SECONDS(?t)) AS ?s) WHERE { ?e col:ts ?t }", "SELECT 'urn:events:' || event_id AS e, YEAR(ts)::BIGINT AS y, MONTH(ts)::BIGINT AS m, DAY(ts)::BIGINT AS d, HOUR(ts)::BIGINT AS h, MINUTE(ts)::BIGINT AS mi, SECOND(ts)::DOUBLE AS s FROM events", "events")
q("functions_term", "SELECT ?c (ISIRI(?c) AS ?i) (ISLITERAL(?n) AS ?l) (ISNUMERIC(?b) AS ?u) (ISBLANK(?n) AS ?k) (STR(?x) AS ?s) (DATATYPE(?b) AS ?dt) (LANG(?n) AS ?la) (SAMETERM(?n, ?n) AS ?st) WHERE { ?c col:c_name ?n ; col:c_acctbal ?b ; col:c_nationkey ?x }", "SELECT 'urn:customer:' || c_custkey AS c, true AS i, true AS l, true AS u, false AS k, 'urn:nation:' || c_nationkey AS s, 'http://www.w3.org/2001/XMLSchema#double' AS dt, '' AS la, true AS st FROM customer", "customer nation")
q("functions_lang", "SELECT ?x (LANG(?t) AS ?l) (LANGMATCHES(LANG(?t), 'en') AS ?m) (STR(?t) AS ?s) WHERE { ?x col:r_name ?n BIND(STRLANG(?n, 'EN-us') AS ?t) }", "SELECT 'urn:region:' || r_regionkey AS x, 'en-us' AS l, true AS m, r_name AS s FROM region", "region")
q("functions_cast", "SELECT ?p (xsd:integer(?r) AS ?i) (xsd:string(?z) AS ?s) (xsd:double(?z) AS ?d) (xsd:boolean(?z) AS ?b) (xsd:integer('x') AS ?bad) (xsd:dateTime('2020-02-03T04:05:06') AS ?t) WHERE { ?p col:p_retailprice ?r ; col:p_size ?z }", "SELECT 'urn:part:' || p_partkey AS p, TRUNC(p_retailprice)::BIGINT AS i, p_size::VARCHAR AS s, p_size::DOUBLE AS d, p_size <> 0 AS b, NULL::BIGINT AS bad, TIMESTAMP '2020-02-03 04:05:06' AS t FROM part", "part")
q("functions_similarity", "SELECT ?a ?b (fn:levenshtein(?x, ?y) AS ?d) (fn:levenshtein_less_equal(?x, ?y, 2) AS ?w) (fn:jaro_winkler(?x, ?y) AS ?j) WHERE { ?a col:n_name ?x . ?b col:n_name ?y FILTER(STR(?x) < STR(?y)) }", "SELECT 'urn:nation:' || a.n_nationkey AS a, 'urn:nation:' || b.n_nationkey AS b, LEVENSHTEIN(a.n_name, b.n_name) AS d, LEAST(LEVENSHTEIN(a.n_name, b.n_name), 3) AS w, ROUND(JARO_WINKLER_SIMILARITY(a.n_name, b.n_name), 2) AS j FROM nation a JOIN nation b ON a.n_name < b.n_name", "nation")
q("functions_token_set", "SELECT ?a (fn:token_set_ratio(?x, ?y) AS ?r) WHERE { ?a col:p_type ?x ; col:p_name ?y }", "SELECT 'urn:part:' || p_partkey AS a, ROUND(LEN(LIST_INTERSECT(LIST_DISTINCT(STR_SPLIT(LOWER(p_type), ' ')), LIST_DISTINCT(STR_SPLIT(LOWER(p_name), ' ')))) / LEN(LIST_DISTINCT(STR_SPLIT(LOWER(p_type) || ' ' || LOWER(p_name), ' ')))::DOUBLE, 2) AS r FROM part", "part")
q("functions_allen", "SELECT ?a ?b (fn:before(?s, ?e, ?t, ?u) AS ?x1) (fn:meets(?s, ?e, ?t, ?u) AS ?x2) (fn:overlaps(?s, ?e, ?t, ?u) AS ?x3) (fn:during(?s, ?e, ?t, ?u) AS ?x4) (fn:finishes(?s, ?e, ?t, ?u) AS ?x5) (fn:starts(?s, ?e, ?t, ?u) AS ?x6) (fn:equals(?s, ?e, ?t, ?u) AS ?x7) WHERE { ?l col:l_shipdate ?s ; col:l_orderkey ?a . ?a col:o_orderdate ?t . BIND(?t AS ?u) BIND(?s AS ?e) BIND(?a AS ?b) }", "SELECT 'urn:orders:' || o_orderkey AS a, 'urn:orders:' || o_orderkey AS b, l_shipdate < o_orderdate AS x1, l_shipdate = o_orderdate AS x2, false AS x3, false AS x4, false AS x5, false AS x6, l_shipdate = o_orderdate AS x7 FROM lineitem JOIN orders ON l_orderkey = o_orderkey", "lineitem orders")
