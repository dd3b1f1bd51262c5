"""Registered graph queries over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quadloom.catalog import BASE, mapped_engine, quad_engine
from quadloom.errors import ParseError, QueryError
from quadloom.plans.render import query_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _finish(df: DataFrame, casts: dict[str, str], rounds: dict[str, int]) -> DataFrame:
    for c, t in casts.items():
        df = df.withColumn(c, F.col(c).try_cast(t))
    for c, n in rounds.items():
        df = df.withColumn(c, F.round(F.col(c).cast("double"), n))
    return df


def _add(name: str, text: str, sql: str | None = None, casts: dict[str, str] | None = None, rounds: dict[str, int] | None = None, quads: bool = False) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        engine = (quad_engine if quads else mapped_engine)(spark, d)
        return _finish(engine.select(text), casts or {}, rounds or {})

    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


_LINES = "?l a :LineItem ; "

# star and link patterns
_add(
    "revenue_by_nation",
    "SELECT ?nation (SUM(?p * (1 - ?x)) AS ?revenue) { ?l :order ?o ; :extendedPrice ?p ; :discount ?x . ?o :customer ?c . ?c :nation ?n . ?n :name ?nation } GROUP BY ?nation ORDER BY DESC(?revenue)",
    "SELECT n_name AS nation, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    rounds={"revenue": 2},
)
_add("bgp_star", "SELECT ?name ?brand ?size { ?p a :Part ; :name ?name ; :brand ?brand ; :size ?size FILTER(?size > 45) }", "SELECT p_name AS name, p_brand AS brand, CAST(p_size AS BIGINT) AS size FROM part WHERE p_size > 45")
_add("bgp_fk_join", "SELECT ?c ?r { ?x a :Customer ; :name ?c ; :nation/:region ?g . ?g :name ?r }", "SELECT c_name AS c, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
_add(
    "bgp_var_predicate",
    f"SELECT ?p (COUNT(*) AS ?n) {{ ?s ?p ?o FILTER(STRSTARTS(STR(?s), '{BASE}nation/')) }} GROUP BY ?p",
    f"SELECT '{BASE}v#name' AS p, count(*) AS n FROM nation UNION ALL SELECT '{BASE}v#region', count(*) FROM nation UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', count(*) FROM nation",
)
_add("bgp_constant_object", "SELECT ?name { ?x a :Nation ; :name ?name ; :region d:region/1 }".replace("d:region/1", f"<{BASE}region/1>"), "SELECT n_name AS name FROM nation WHERE n_regionkey = 1")
_add("bgp_constant_subject", f"SELECT ?n ?b {{ <{BASE}customer/7> :name ?n ; :balance ?b }}", "SELECT c_name AS n, c_acctbal AS b FROM customer WHERE c_custkey = 7")
_add(
    "bgp_chain",
    "SELECT ?n (COUNT(*) AS ?k) { ?l a :LineItem ; :supplier ?s ; :part ?p . ?s :nation ?t . ?t :name ?n . ?p :size ?z FILTER(?z < 10) } GROUP BY ?n",
    "SELECT n_name AS n, count(*) AS k FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey JOIN nation ON s_nationkey = n_nationkey WHERE p_size < 10 GROUP BY 1",
)
_add("cartesian_product", "SELECT ?a ?b { ?x a :Region ; :name ?a . ?y a :Region ; :name ?b FILTER(?a < ?b) }", "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b WHERE a.r_name < b.r_name")
_add("theta_join", "SELECT ?a ?b { ?x a :Supplier ; :balance ?p ; :name ?a . ?y a :Supplier ; :balance ?q ; :name ?b FILTER(?p > 9000 && ?q < -500) }", "SELECT a.s_name AS a, b.s_name AS b FROM supplier a, supplier b WHERE a.s_acctbal > 9000 AND b.s_acctbal < -500")
# filters and expressions
_add("filter_numeric", "SELECT ?s ?b { ?c a :Customer ; :segment ?s ; :balance ?b FILTER(?b > 5000 && ?b <= 6000) }", "SELECT c_mktsegment AS s, c_acctbal AS b FROM customer WHERE c_acctbal > 5000 AND c_acctbal <= 6000")
_add("filter_string", "SELECT ?n { ?p a :Part ; :name ?n FILTER(CONTAINS(?n, 'l r') && STRSTARTS(LCASE(UCASE(?n)), 's') && STRENDS(?n, 'ing') || CONTAINS(?n, 'blue') && STRENDS(?n, 'bolt')) }", "SELECT p_name AS n FROM part WHERE contains(p_name, 'l r') AND starts_with(lower(upper(p_name)), 's') AND ends_with(p_name, 'ing') OR contains(p_name, 'blue') AND ends_with(p_name, 'bolt')")
_add("filter_regex", "SELECT ?n { ?c a :Customer ; :name ?n FILTER(REGEX(?n, '0[13]$', 'i')) }", "SELECT c_name AS n FROM customer WHERE regexp_matches(c_name, '0[13]$', 'i')")
_add("filter_in", "SELECT ?s (COUNT(*) AS ?n) { ?c a :Customer ; :segment ?s FILTER(?s IN ('BUILDING', 'MACHINERY')) } GROUP BY ?s", "SELECT c_mktsegment AS s, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1")
_add("filter_not_in", "SELECT ?s (COUNT(*) AS ?n) { ?c a :Customer ; :segment ?s FILTER(?s NOT IN ('BUILDING', 'MACHINERY')) } GROUP BY ?s", "SELECT c_mktsegment AS s, count(*) AS n FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') GROUP BY 1")
_add("filter_logic", "SELECT (COUNT(*) AS ?n) { ?p a :Part ; :size ?s ; :price ?r FILTER(!(?s > 10) || (?r >= 1500 && ?s != 20)) }", "SELECT count(*) AS n FROM part WHERE NOT (p_size > 10) OR (p_retailprice >= 1500 AND p_size <> 20)")
_add("filter_date", "SELECT (COUNT(*) AS ?n) { ?o a :Order ; :date ?d FILTER(?d < '1996-01-01T00:00:00'^^xsd:dateTime) }", "SELECT count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'")
_add("bind_arith", "SELECT ?n ?x ?y { ?p a :Part ; :name ?n ; :price ?r ; :size ?s BIND(?r * 2 + ?s AS ?x) BIND(-?s AS ?y) FILTER(?s < 3) }", "SELECT p_name AS n, round(p_retailprice * 2 + p_size, 4) AS x, CAST(-p_size AS BIGINT) AS y FROM part WHERE p_size < 3", rounds={"x": 4})
_add("arith_division", "SELECT ?s ?q { ?p a :Part ; :size ?s BIND(?s / 4 AS ?q) }", "SELECT CAST(p_size AS BIGINT) AS s, round(p_size / 4.0, 6) AS q FROM part", rounds={"q": 6})
_add("if_coalesce", "SELECT ?n ?k ?v { ?p a :Part ; :name ?n ; :size ?s BIND(IF(?s > 25, 'large', 'small') AS ?k) BIND(COALESCE(?zz, ?s) AS ?v) }", "SELECT p_name AS n, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS k, CAST(p_size AS BIGINT) AS v FROM part", casts={"v": "bigint"})
_add("ebv", "SELECT (COUNT(*) AS ?n) { ?p a :Part ; :size ?s ; :name ?m FILTER(?s && ?m) }", "SELECT count(*) AS n FROM part WHERE p_size <> 0 AND p_name <> ''")
_add("bound_test", "SELECT ?k (COUNT(*) AS ?n) { ?d a :Document OPTIONAL { ?d :party ?p } BIND(BOUND(?p) AS ?k) } GROUP BY ?k", "SELECT party IS NOT NULL AS k, count(*) AS n FROM documents GROUP BY 1")
_add("select_expr", "SELECT ?n (?b * 2 AS ?x) (?x + 1 AS ?y) { ?s a :Supplier ; :name ?n ; :balance ?b }", "SELECT s_name AS n, round(s_acctbal * 2, 4) AS x, round(s_acctbal * 2 + 1, 4) AS y FROM supplier", rounds={"x": 4, "y": 4})
# optional, union, minus, exists
_add("optional_single", "SELECT ?d ?p { ?x a :Document ; :source ?d OPTIONAL { ?x :party ?p } }", "SELECT source AS d, party AS p FROM documents")
_add("optional_multi", "SELECT (COUNT(*) AS ?n) (COUNT(?o) AS ?m) { ?c a :Customer OPTIONAL { ?o a :Order ; :customer ?c ; :status 'F' } }", "SELECT count(*) AS n, count(o_orderkey) AS m FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON o_custkey = c_custkey")
_add("optional_filter", "SELECT (COUNT(*) AS ?n) (COUNT(?t) AS ?m) { ?c a :Customer ; :balance ?b OPTIONAL { ?o :customer ?c ; :total ?t FILTER(?t > ?b * 40) } }", "SELECT count(*) AS n, count(o_totalprice) AS m FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 40")
_add("optional_nested", "SELECT (COUNT(*) AS ?n) (COUNT(?o) AS ?m) (COUNT(?l) AS ?k) { ?c a :Customer ; :segment 'BUILDING' OPTIONAL { ?o :customer ?c ; :status 'O' OPTIONAL { ?l :order ?o ; :returnFlag 'N' } } }", "SELECT count(*) AS n, count(o_orderkey) AS m, count(l_orderkey) AS k FROM customer LEFT JOIN (SELECT * FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'N') ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O') ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
_add("union_bag", "SELECT ?n { { ?c a :Customer ; :name ?n ; :balance ?b FILTER(?b > 9000) } UNION { ?c a :Customer ; :name ?n ; :segment 'BUILDING' } }", "SELECT c_name AS n FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
_add("minus", "SELECT ?n { ?c a :Customer ; :name ?n MINUS { ?o :customer ?c ; :status 'P' } }", "SELECT c_name AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
_add("exists", "SELECT ?n { ?c a :Customer ; :name ?n ; :balance ?b FILTER EXISTS { ?o :customer ?c ; :total ?t FILTER(?t > 40 * ?b) } }", "SELECT c_name AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 40 * c_acctbal)")
_add("not_exists", "SELECT ?n { ?c a :Customer ; :name ?n FILTER NOT EXISTS { ?o :customer ?c ; :priority '1-URGENT' } }", "SELECT c_name AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
_add("exists_value", "SELECT ?e (COUNT(*) AS ?n) { ?c a :Customer BIND(EXISTS { ?o :customer ?c ; :status 'P' } AS ?e) } GROUP BY ?e", "SELECT c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS e, count(*) AS n FROM customer GROUP BY 1")
_add("values_join", "SELECT ?r ?n { VALUES ?r { 'ASIA' 'EUROPE' } ?g :name ?r . ?x :region ?g ; :name ?n }", "SELECT r_name AS r, n_name AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')")
_add("values_undef", "SELECT ?s ?t (COUNT(*) AS ?n) { ?c a :Customer ; :segment ?s BIND('x' AS ?t) VALUES (?s ?t) { ('BUILDING' UNDEF) (UNDEF 'x') (UNDEF 'y') } } GROUP BY ?s ?t", "SELECT c_mktsegment AS s, 'x' AS t, count(*) * CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END AS n FROM customer GROUP BY c_mktsegment")
_add("subquery", "SELECT ?n ?k { ?c a :Customer ; :name ?n { SELECT ?c (COUNT(?o) AS ?k) { ?o :customer ?c } GROUP BY ?c HAVING(COUNT(?o) > 15) } }", "SELECT c_name AS n, k FROM customer JOIN (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1 HAVING count(*) > 15) ON o_custkey = c_custkey")
_add("subquery_limit", "SELECT ?n (COUNT(?o) AS ?k) { { SELECT ?c ?n { ?c a :Customer ; :name ?n } ORDER BY ?n LIMIT 20 } ?o :customer ?c } GROUP BY ?n", "SELECT c_name AS n, count(*) AS k FROM (SELECT * FROM customer ORDER BY c_name LIMIT 20) JOIN orders ON o_custkey = c_custkey GROUP BY 1")
# aggregates and modifiers
_add("count_all", f"SELECT (COUNT(*) AS ?n) {{ {_LINES}:quantity ?q }}", "SELECT count(*) AS n FROM lineitem")
_add("count_distinct", "SELECT (COUNT(DISTINCT ?c) AS ?n) (COUNT(DISTINCT ?s) AS ?m) { ?o :customer ?c ; :status ?s }", "SELECT count(DISTINCT o_custkey) AS n, count(DISTINCT o_orderstatus) AS m FROM orders")
_add("sum_avg", f"SELECT ?f ?s (SUM(?q) AS ?sum_qty) (AVG(?d) AS ?avg_disc) (COUNT(*) AS ?n) {{ {_LINES}:returnFlag ?f ; :lineStatus ?s ; :quantity ?q ; :discount ?d }} GROUP BY ?f ?s", "SELECT l_returnflag AS f, l_linestatus AS s, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY 1, 2", rounds={"sum_qty": 2, "avg_disc": 6})
_add("min_max", "SELECT ?s (MIN(?b) AS ?lo) (MAX(?b) AS ?hi) { ?c a :Customer ; :segment ?s ; :balance ?b } GROUP BY ?s", "SELECT c_mktsegment AS s, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1")
_add("group_concat", "SELECT ?r (GROUP_CONCAT(?n; SEPARATOR=',') AS ?names) { ?x a :Nation ; :name ?n ; :region/:name ?r } GROUP BY ?r", "SELECT r_name AS r, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
_add("sample", "SELECT ?r (SAMPLE(?n) AS ?one) { ?x a :Nation ; :name ?n ; :region/:name ?r } GROUP BY ?r", "SELECT r_name AS r, min(n_name) AS one FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
_add("having", "SELECT ?b (COUNT(*) AS ?n) { ?p a :Part ; :brand ?b } GROUP BY ?b HAVING(COUNT(*) > 60)", "SELECT p_brand AS b, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 60")
_add("multi_having", "SELECT ?b (COUNT(*) AS ?n) (AVG(?s) AS ?m) { ?p a :Part ; :brand ?b ; :size ?s } GROUP BY ?b HAVING(?n > 50) (AVG(?s) > 20)", "SELECT p_brand AS b, count(*) AS n, round(avg(p_size), 6) AS m FROM part GROUP BY 1 HAVING count(*) > 50 AND avg(p_size) > 20", rounds={"m": 6})
_add("group_expr", "SELECT ?k (COUNT(*) AS ?n) { ?o a :Order ; :date ?d } GROUP BY (YEAR(?d) AS ?k)", "SELECT CAST(year(o_orderdate) AS BIGINT) AS k, count(*) AS n FROM orders GROUP BY 1")
_add("aggregate_expr", "SELECT ?s (SUM(?t) / COUNT(*) + 1 AS ?x) { ?o a :Order ; :status ?s ; :total ?t } GROUP BY ?s", "SELECT o_orderstatus AS s, round(sum(o_totalprice) / count(*) + 1, 3) AS x FROM orders GROUP BY 1", rounds={"x": 3})
_add("implicit_group_empty", "SELECT (COUNT(*) AS ?n) (SUM(?b) AS ?t) { ?c a :Customer ; :balance ?b FILTER(?b > 1000000) }", "SELECT count(*) AS n, coalesce(sum(c_acctbal), 0.0) AS t FROM customer WHERE c_acctbal > 1000000")
_add("order_limit_offset", "SELECT ?n ?b { ?c a :Customer ; :name ?n ; :balance ?b } ORDER BY DESC(?b) ?n LIMIT 10 OFFSET 5", "SELECT c_name AS n, c_acctbal AS b FROM customer ORDER BY c_acctbal DESC, c_name LIMIT 10 OFFSET 5")
_add("distinct", "SELECT DISTINCT ?s ?p { ?o a :Order ; :status ?s ; :priority ?p }", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders")
_add("reduced", "SELECT REDUCED ?b { ?p a :Part ; :brand ?b }", "SELECT DISTINCT p_brand AS b FROM part")
# functions
_add("str_funcs", "SELECT ?n (STRLEN(?n) AS ?l) (UCASE(?n) AS ?u) (SUBSTR(?n, 3, 4) AS ?s) (STR(?c) AS ?i) { ?c a :Supplier ; :name ?n }", f"SELECT s_name AS n, length(s_name) AS l, upper(s_name) AS u, substr(s_name, 3, 4) AS s, '{BASE}supplier/' || s_suppkey AS i FROM supplier")
_add("substr_before_after", "SELECT ?n (STRBEFORE(?n, '#') AS ?b) (STRAFTER(?n, '#') AS ?a) { ?c a :Customer ; :name ?n }", "SELECT c_name AS n, CASE WHEN contains(c_name, '#') THEN split_part(c_name, '#', 1) ELSE '' END AS b, CASE WHEN contains(c_name, '#') THEN substr(c_name, instr(c_name, '#') + 1) ELSE '' END AS a FROM customer")
_add("concat_replace", "SELECT (CONCAT(?n, '-', ?b) AS ?c) (REPLACE(?n, '([0-9])', '<$1>') AS ?r) { ?p a :Part ; :name ?n ; :brand ?b }", "SELECT p_name || '-' || p_brand AS c, regexp_replace(p_name, '([0-9])', '<\\1>', 'g') AS r FROM part")
_add("encode_uri", "SELECT ?n (ENCODE_FOR_URI(?n) AS ?e) { ?x a :Region ; :name ?n }", "SELECT r_name AS n, url_encode(r_name) AS e FROM region")
_add("hash_funcs", "SELECT (MD5(?n) AS ?m) (SHA1(?n) AS ?s) (SHA256(?n) AS ?t) { ?x a :Nation ; :name ?n }", "SELECT md5(n_name) AS m, sha1(n_name) AS s, sha256(n_name) AS t FROM nation")
_add("date_parts", "SELECT ?y ?m ?d (COUNT(*) AS ?n) { ?o a :Order ; :date ?t BIND(YEAR(?t) AS ?y) BIND(MONTH(?t) AS ?m) BIND(DAY(?t) AS ?d) } GROUP BY ?y ?m ?d", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d, count(*) AS n FROM orders GROUP BY 1, 2, 3")
_add("math_round", "SELECT ?b (ABS(?b) AS ?a) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) (ROUND(?b) AS ?r) { ?s a :Supplier ; :balance ?b }", "SELECT s_acctbal AS b, abs(s_acctbal) AS a, ceil(s_acctbal) AS c, floor(s_acctbal) AS f, floor(s_acctbal + 0.5) AS r FROM supplier")
_add("casts", "SELECT ?k (xsd:integer(?b) AS ?i) (xsd:string(?z) AS ?s) (xsd:double(?z) AS ?d) (xsd:boolean(?z) AS ?t) { ?p a :Part ; :name ?k ; :price ?b ; :size ?z }", "SELECT p_name AS k, CAST(trunc(p_retailprice) AS BIGINT) AS i, CAST(p_size AS VARCHAR) AS s, CAST(p_size AS DOUBLE) AS d, p_size <> 0 AS t FROM part")
_add("term_tests", "SELECT (COUNT(*) AS ?n) { ?p a :Part ; :name ?m ; :size ?s FILTER(isIRI(?p) && isLiteral(?m) && !isBlank(?p) && isNumeric(?s) && !isNumeric(?m) && sameTerm(?m, ?m)) }", "SELECT count(*) AS n FROM part")
_add("datatype_lang", "SELECT ?t (COUNT(*) AS ?n) { ?p a :Part ; :size ?s ; :name ?m BIND(CONCAT(STR(DATATYPE(?s)), LANG(?m)) AS ?t) } GROUP BY ?t", "SELECT 'http://www.w3.org/2001/XMLSchema#integer' AS t, count(*) AS n FROM part")
_add(
    "lang_dir",
    "SELECT ?n (LANG(?x) AS ?l) (LANGDIR(?x) AS ?d) (hasLANG(?x) AS ?h) (hasLANGDIR(?y) AS ?k) (STR(?x) AS ?t) (STR(DATATYPE(?z)) AS ?u) (isLiteral(?y) && LANG(?y) = 'de' AS ?v) { ?c a :Customer ; :name ?n BIND(STRLANGDIR(?n, 'ar', 'rtl') AS ?x) BIND(STRLANG(?n, 'de') AS ?y) BIND(STRDT(?n, xsd:token) AS ?z) }",
    "SELECT c_name AS n, 'ar' AS l, 'rtl' AS d, true AS h, false AS k, c_name AS t, 'http://www.w3.org/2001/XMLSchema#token' AS u, true AS v FROM customer",
)
_add("iri_func", "BASE <http://e.example/a/b/c> SELECT ?n (STR(IRI(CONCAT('../', ENCODE_FOR_URI(?n)))) AS ?i) (STR(URI(CONCAT('./x/../', ENCODE_FOR_URI(?n), '/.'))) AS ?j) (STR(IRI('d')) AS ?k) { ?c a :Customer ; :name ?n }", "SELECT c_name AS n, 'http://e.example/a/' || url_encode(c_name) AS i, 'http://e.example/a/b/' || url_encode(c_name) || '/' AS j, 'http://e.example/a/b/d' AS k FROM customer")
_add("bnode_func", "SELECT (COUNT(*) AS ?n) (COUNT(DISTINCT ?z) AS ?m) { ?c a :Customer ; :name ?k BIND(BNODE(?k) AS ?x) BIND(BNODE(?k) AS ?y) BIND(BNODE() AS ?z) FILTER(?x = ?y && isBlank(?x) && ?z != ?x) }", "SELECT count(*) AS n, count(*) AS m FROM customer")
_add("triple_func", "SELECT (STR(SUBJECT(?t)) AS ?s) (STR(PREDICATE(?t)) AS ?p) (STR(OBJECT(?t)) AS ?o) (isTRIPLE(?t) AS ?k) { ?c a :Customer ; :name ?n BIND(TRIPLE(?c, :name, ?n) AS ?t) }", f"SELECT '{BASE}customer/' || c_custkey AS s, '{BASE}v#name' AS p, c_name AS o, true AS k FROM customer")
_add("random_funcs", "SELECT (COUNT(*) AS ?n) (COUNT(DISTINCT ?u) AS ?m) { ?c a :Customer BIND(RAND() AS ?r) BIND(STRUUID() AS ?u) BIND(UUID() AS ?v) FILTER(?r >= 0 && ?r < 1 && STRLEN(?u) = 36 && isIRI(?v) && STRSTARTS(STR(?v), 'urn:uuid:')) }", "SELECT count(*) AS n, count(*) AS m FROM customer")
_add("now_func", "SELECT (COUNT(*) AS ?n) { ?o a :Order ; :date ?d FILTER(NOW() > ?d && NOW() = NOW()) }", "SELECT count(*) AS n FROM orders WHERE o_orderdate < now()::TIMESTAMP")
_add("casts_more", "SELECT ?k (xsd:decimal(?b) AS ?d) (xsd:float(?z) AS ?f) (STR(xsd:date(?t)) AS ?y) (STR(xsd:dateTime(CONCAT(STR(xsd:date(?t)), 'T00:00:00'))) AS ?m) { ?o a :Order ; :total ?b ; :date ?t ; :priority ?k BIND(YEAR(?t) AS ?z) }", "SELECT o_orderpriority AS k, round(o_totalprice, 2) AS d, CAST(year(o_orderdate) AS DOUBLE) AS f, strftime(o_orderdate, '%Y-%m-%d') AS y, strftime(o_orderdate, '%Y-%m-%dT00:00:00') AS m FROM orders", rounds={"d": 2, "f": 2})
# syntax
_add("nested_group", "SELECT ?n { ?c a :Customer ; :name ?n { ?c :segment ?s FILTER(?s = 'BUILDING' && !BOUND(?n)) } }", "SELECT c_name AS n FROM customer WHERE c_mktsegment = 'BUILDING'")
_add("prologue", f"VERSION '1.2' BASE <{BASE}> PREFIX w: <v#> SELECT ?n {{ ?x w:region <region/2> ; w:name ?n }}", "SELECT n_name AS n FROM nation WHERE n_regionkey = 2")
_add("bnode_pattern", "SELECT ?n (COUNT(*) AS ?k) { _:c a :Customer ; :nation [ :name ?n ] } GROUP BY ?n", "SELECT n_name AS n, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
_add("property_lists", "SELECT ?a ?b ?s { ?c a :Customer ; :name ?a ; :segment ?s , 'BUILDING' ; :nation [ a :Nation ; :region [ :name ?b ] ] }", "SELECT c_name AS a, r_name AS b, c_mktsegment AS s FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment = 'BUILDING'")
_add("escapes", f"PREFIX n: <{BASE}nation\u002F> SELECT ?n {{ ?c a :Customer ; :nation n:\u0033 ; :n\u0061me ?n FILTER(STRSTARTS(?n, \"\\u0043ust\") && !CONTAINS(?n, '\\t')) }}", "SELECT c_name AS n FROM customer WHERE c_nationkey = 3")
# conditions on outer variables, keys that can be unbound, hidden order
_add("exists_nested_union", "SELECT ?n { ?c a :Customer ; :name ?n ; :balance ?b FILTER EXISTS { { ?o :customer ?c ; :total ?t FILTER(?t > 40 * ?b) } UNION { ?o :customer ?c ; :status 'P' } } }", "SELECT c_name AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND (o_totalprice > 40 * c_acctbal OR o_orderstatus = 'P'))")
_add("exists_nested_group", "SELECT ?n { ?c a :Customer ; :name ?n ; :nation ?m ; :balance ?b FILTER NOT EXISTS { ?m :region ?r { ?s a :Supplier ; :nation ?m ; :balance ?x FILTER(?x > ?b) } } }", "SELECT c_name AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > c_acctbal)")
_add("optional_unbound_key", "SELECT (COUNT(*) AS ?n) (COUNT(?k) AS ?m) (SUM(?k) AS ?t) { ?d a :Document OPTIONAL { ?d :party ?p } OPTIONAL { SELECT ?p (COUNT(*) AS ?k) { ?e a :Document ; :party ?p ; :agenda ?a } GROUP BY ?p } }", "WITH k AS (SELECT party, count(*) AS k FROM documents WHERE party IS NOT NULL AND agenda_item IS NOT NULL GROUP BY 1) SELECT count(*) AS n, count(k) AS m, CAST(coalesce(sum(k), 0) AS BIGINT) AS t FROM documents d LEFT JOIN k ON d.party IS NULL OR d.party = k.party")
_add("minus_unbound_key", "SELECT ?s (COUNT(*) AS ?n) { ?d a :Document ; :source ?s OPTIONAL { ?d :party ?p } MINUS { SELECT ?p { ?e :party ?p } GROUP BY ?p HAVING(COUNT(*) > 60) } } GROUP BY ?s", "SELECT source AS s, count(*) AS n FROM documents WHERE party IS NULL OR party NOT IN (SELECT party FROM documents WHERE party IS NOT NULL GROUP BY 1 HAVING count(*) > 60) GROUP BY 1")
_add("distinct_hidden_order", "SELECT DISTINCT ?s { ?o a :Order ; :status ?s ; :total ?t } ORDER BY DESC(?t) LIMIT 2", "SELECT s FROM (SELECT o_orderstatus AS s, max(o_totalprice) AS t FROM orders GROUP BY 1 ORDER BY 2 DESC LIMIT 2)")
# paths
_add("path_seq", "SELECT ?n (COUNT(*) AS ?k) { ?o a :Order ; :customer/:nation/:name ?n } GROUP BY ?n", "SELECT n_name AS n, count(*) AS k FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
_add("path_alt", "SELECT ?v (COUNT(*) AS ?k) { ?x a :Nation ; (:name|:region/:name) ?v } GROUP BY ?v", "SELECT v, count(*) AS k FROM (SELECT n_name AS v FROM nation UNION ALL SELECT r_name FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY 1")
_add("path_inverse", "SELECT ?r (COUNT(*) AS ?k) { ?x a :Region ; :name ?r ; ^:region/^:nation ?c . ?c a :Customer } GROUP BY ?r", "SELECT r_name AS r, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
_REISSUES = "WITH RECURSIVE e AS (SELECT doc_id AS s, reissue_of AS o FROM documents WHERE reissue_of IS NOT NULL), p AS (SELECT s, o FROM e UNION SELECT p.s, e.o FROM p JOIN e ON p.o = e.s)"
_add("path_plus", "SELECT ?a ?b { ?a :reissueOf+ ?b }", f"{_REISSUES} SELECT '{BASE}doc/' || s AS a, '{BASE}doc/' || o AS b FROM p")
_add("path_star", "SELECT ?a (COUNT(?b) AS ?n) { ?a :reissueOf ?x . ?a :reissueOf* ?b } GROUP BY ?a", f"{_REISSUES} SELECT '{BASE}doc/' || s AS a, count(*) + 1 AS n FROM p GROUP BY s")
_add("path_opt", f"SELECT ?b {{ <{BASE}nation/3> :region? ?b }}", f"SELECT '{BASE}nation/3' AS b UNION ALL SELECT '{BASE}region/' || n_regionkey FROM nation WHERE n_nationkey = 3")
_add("path_range", "SELECT ?a ?b { ?a :reissueOf{1,2} ?b }", "WITH e AS (SELECT doc_id AS s, reissue_of AS o FROM documents WHERE reissue_of IS NOT NULL) " + f"SELECT '{BASE}doc/' || s AS a, '{BASE}doc/' || o AS b FROM (SELECT s, o FROM e UNION SELECT x.s, y.o FROM e x JOIN e y ON x.o = y.s)")
_add("path_neg_inverse", f"SELECT ?v {{ <{BASE}region/1> !(:name|^:name|rdf:type|^rdf:type) ?v }}", f"SELECT '{BASE}nation/' || n_nationkey AS v FROM nation WHERE n_regionkey = 1")
_add("path_neg", f"SELECT ?v {{ <{BASE}nation/3> !(:name|rdf:type) ?v }}", f"SELECT '{BASE}region/' || n_regionkey AS v FROM nation WHERE n_nationkey = 3")

# stored quads: graphs, dynamic terms
_SET = "(SELECT DISTINCT g, s, p, o FROM quads)"
_add("graph_var", "SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?s parl:keyword ?o } } GROUP BY ?g", f"SELECT g.v AS g, count(*) AS n FROM {_SET} WHERE p = 'parl:keyword' AND g IS NOT NULL GROUP BY 1", quads=True)
_add("graph_fixed", "SELECT ?s ?o { GRAPH <http://parl.example/desk/west> { ?s parl:keyword ?o } }", f"SELECT s.v AS s, o.v AS o FROM {_SET} WHERE p = 'parl:keyword' AND g.v = 'http://parl.example/desk/west'", quads=True)
_add("graph_var_join", "SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?s parl:keyword ?o . ?s a ?t } } GROUP BY ?g", f"SELECT a.g.v AS g, count(*) AS n FROM {_SET} a JOIN {_SET} b ON a.g = b.g AND a.s = b.s WHERE a.p = 'parl:keyword' AND b.p = 'rdf:type' GROUP BY 1", quads=True)
_add("default_graph", "SELECT ?p (COUNT(*) AS ?n) { ?s ?p ?o } GROUP BY ?p", f"SELECT p, count(*) AS n FROM {_SET} WHERE g IS NULL GROUP BY 1", quads=True)
_add("from_named", "SELECT ?g ?s ?o FROM NAMED <http://parl.example/desk/west> FROM NAMED <http://parl.example/desk/press> { GRAPH ?g { ?s dcterms:subject ?o } }", f"SELECT g.v AS g, s.v AS s, o.v AS o FROM {_SET} WHERE p = 'dcterms:subject' AND g.v IN ('http://parl.example/desk/west', 'http://parl.example/desk/press')", quads=True)
_add("from_merge", "SELECT ?p (COUNT(*) AS ?n) FROM <http://parl.example/desk/west> FROM <http://parl.example/desk/press> { ?s ?p ?o } GROUP BY ?p", "SELECT p, count(*) AS n FROM (SELECT DISTINCT s, p, o FROM quads WHERE g.v IN ('http://parl.example/desk/west', 'http://parl.example/desk/press')) GROUP BY 1", quads=True)
_add("dynamic_sum", "SELECT ?s (SUM(xsd:decimal(?o)) AS ?t) { GRAPH ?g { ?s parl:attendance ?o } FILTER(REGEX(?o, '^[0-9]+[.][0-9]+$')) } GROUP BY ?s", f"SELECT s.v AS s, round(sum(CAST(o.v AS DOUBLE)), 4) AS t FROM {_SET} WHERE p = 'parl:attendance' AND g IS NOT NULL AND o.dt = 'xsd:string' AND regexp_matches(o.v, '^[0-9]+[.][0-9]+$') GROUP BY 1", rounds={"t": 4}, quads=True)
_add("dynamic_numeric_filter", "SELECT ?s ?o { GRAPH ?g { ?s parl:termsServed ?o } FILTER(?o > 5) }", f"SELECT s.v AS s, o.v AS o FROM {_SET} WHERE p = 'parl:termsServed' AND g IS NOT NULL AND o.dt = 'xsd:integer' AND regexp_matches(o.v, '^[+-]?[0-9]+$') AND CAST(o.v AS BIGINT) > 5", quads=True)
_add("lang_filter", "SELECT ?l (COUNT(*) AS ?n) { GRAPH ?g { ?s rdfs:label ?o } FILTER(LANGMATCHES(LANG(?o), '*')) BIND(LANG(?o) AS ?l) } GROUP BY ?l", f"SELECT o.lang AS l, count(*) AS n FROM {_SET} WHERE p = 'rdfs:label' AND g IS NOT NULL AND o.k = 2 AND coalesce(o.lang, '') <> '' GROUP BY 1", quads=True)
_add("kind_counts", "SELECT ?k (COUNT(*) AS ?n) { ?s ?p ?o BIND(IF(isIRI(?o), 'iri', IF(isBlank(?o), 'blank', 'literal')) AS ?k) } GROUP BY ?k", f"SELECT CASE o.k WHEN 1 THEN 'iri' WHEN 0 THEN 'blank' ELSE 'literal' END AS k, count(*) AS n FROM {_SET} WHERE g IS NULL GROUP BY 1", quads=True)
_add("quad_star", "SELECT (COUNT(*) AS ?n) { ?s a parl:Speech ; parl:inSitting ?t ; parl:keyword ?k }", f"SELECT count(*) AS n FROM {_SET} a JOIN {_SET} b ON a.s = b.s JOIN {_SET} c ON a.s = c.s WHERE a.g IS NULL AND b.g IS NULL AND c.g IS NULL AND a.p = 'rdf:type' AND a.o.v = 'parl:Speech' AND b.p = 'parl:inSitting' AND c.p = 'parl:keyword'", quads=True)
_ZONED = "^[0-9]{4}-[0-9]{2}-[012][0-8]T[01][0-9]:[0-9]{2}:[0-9]{2}([+-][0-9]{2}:[0-9]{2}|Z)$"
_add(
    "time_parts",
    f"SELECT ?s (STR(?o) AS ?v) (HOURS(?o) AS ?h) (MINUTES(?o) AS ?m) (SECONDS(?o) AS ?c) (TZ(?o) AS ?z) (STR(TIMEZONE(?o)) AS ?t) {{ GRAPH ?g {{ ?s parl:startedAt ?o }} FILTER(DATATYPE(?o) = xsd:dateTime && REGEX(STR(?o), '{_ZONED}') && YEAR(?o) > 0) }}",
    "WITH t AS (SELECT DISTINCT g, s.v AS s, o.v AS v FROM quads WHERE g IS NOT NULL AND p = 'parl:startedAt' AND o.dt = 'xsd:dateTime' AND regexp_matches(o.v, '" + _ZONED + "') AND substr(o.v, 9, 2) <> '00' AND substr(o.v, 6, 2) BETWEEN '01' AND '12' AND substr(o.v, 15, 2) < '60' AND substr(o.v, 18, 2) < '60') "
    "SELECT s, v, CAST(substr(v, 12, 2) AS BIGINT) AS h, CAST(substr(v, 15, 2) AS BIGINT) AS m, CAST(substr(v, 18, 2) AS DOUBLE) AS c, substr(v, 20) AS z, "
    "CASE WHEN substr(v, 20) IN ('Z', '+00:00', '-00:00') THEN 'PT0S' ELSE CASE WHEN substr(v, 20, 1) = '-' THEN '-' ELSE '' END || 'PT' || CASE WHEN substr(v, 21, 2) = '00' THEN '' ELSE CAST(CAST(substr(v, 21, 2) AS INT) AS VARCHAR) || 'H' END || CASE WHEN substr(v, 24, 2) = '00' THEN '' ELSE CAST(CAST(substr(v, 24, 2) AS INT) AS VARCHAR) || 'M' END END AS t FROM t",
    rounds={"c": 6}, casts={"h": "bigint", "m": "bigint"}, quads=True,
)


def rejected_queries(spark: SparkSession, d: str) -> DataFrame:
    """Queries that are refused before anything runs."""
    engine, rows = mapped_engine(spark, d), []
    for text in _REFUSED:
        try:
            engine.parse(text)
            rows.append((text, False))
        except (ParseError, QueryError):
            rows.append((text, True))
    return spark.createDataFrame(rows, "query string, refused boolean")


_REFUSED = [
    "SELECT (SUM(COUNT(?x)) AS ?n) { ?x :p ?y }", "SELECT ?y (COUNT(?x) AS ?n) { ?x :p ?y }", "SELECT * { ?x :p ?y } GROUP BY ?y", "SELECT (1 AS ?x) { ?x :p ?y }",
    "SELECT ?x { ?x :p _:b OPTIONAL { ?x :q _:b } }", "SELECT ?x { BIND(1 AS ?x) ?x :p ?y BIND(2 AS ?y) }", "INSERT DATA { :a :b :c }",
]
QUERIES["rejected_queries"] = rejected_queries
ORACLES["rejected_queries"] = " UNION ALL ".join("SELECT '" + q.replace("'", "''") + "' AS query, true AS refused" for q in _REFUSED)


def rendered_query(spark: SparkSession, d: str) -> DataFrame:
    """A query parsed, written as text again, and that text run."""
    engine = mapped_engine(spark, d)
    text = "SELECT ?s (COUNT(*) AS ?n) { { ?c a :Customer ; :segment ?s ; :balance ?b FILTER(?b * 2 > 5000 || !(?b < 9)) } UNION { ?c a :Customer ; :segment ?s MINUS { ?o :customer/:nation ?z ; :customer ?c } } OPTIONAL { ?c :nation ?m FILTER EXISTS { ?m :region ?r } } } GROUP BY ?s HAVING(COUNT(*) > 3)"
    return engine.select(query_text(engine.parse(text)))


QUERIES["rendered_query"] = rendered_query
ORACLES["rendered_query"] = "SELECT s, count(*) AS n FROM (SELECT c_mktsegment AS s FROM customer WHERE c_acctbal * 2 > 5000 OR NOT (c_acctbal < 9) UNION ALL SELECT c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) GROUP BY 1 HAVING count(*) > 3"
