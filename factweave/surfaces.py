"""More registered queries: predicates and functions one by one, point reads, trees, views over a log, transactions,
policies, standing queries and the builder; each over whole tables, with its SQL."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import edn
from .builder import Param, entities, rule
from .operators.pull import pull_frame
from .plans.compiler import run_query
from .policy import Policy, Principal, Rule
from .shapes import field, identity, shape
from .sources.scratch import shared_dir
from .streaming.frames import follow, frames
from .streaming.live import Live, Replica, changes
from .transactions import Connection, Store, TxError

Query = Callable[[SparkSession, str], DataFrame]
#: name -> (query, SQL)
ALL: dict[str, tuple[Query, str]] = {}


def add(name: str, query: Query, sql: str) -> None:
    ALL[name] = query, sql


def asked(*names: str, text, more: Callable[[DataFrame], DataFrame] = lambda df: df, **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .catalog import tables

        inputs = options.get("inputs", ())
        return more(run_query(tables(spark, sf_dir, *names), text, *inputs, functions=options.get("functions"), budget=options.get("budget", 1_572_864)).df)

    return run


def over(*names: str):
    """A query that takes the database of some tables."""

    def wrap(f: Callable) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from .catalog import tables

            return f(tables(spark, sf_dir, *names))

        return run

    return wrap


def rounded(*columns: str):
    return lambda df: df.select(*[F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns])


def texts(**columns: str):
    """Lists as text, for a comparison that doesn't depend on how lists are held."""
    return lambda df: df.select(*[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) if c in columns else F.col(c) for c in df.columns])


# predicates and functions

_NUMBERS = "[?n :nation/nationkey ?k] [(- ?k 12) ?x]"
for _name, _test, _sql in [
    ("even", "(even? ?x)", "x % 2 = 0"),
    ("odd", "(odd? ?x)", "x % 2 <> 0"),
    ("zero", "(zero? ?x)", "x = 0"),
    ("pos", "(pos? ?x)", "x > 0"),
    ("neg", "(neg? ?x)", "x < 0"),
    ("equal", "(= ?x 3)", "x = 3"),
    ("between", "(<= -2 ?x 4)", "x BETWEEN -2 AND 4"),
    ("number", "(number? ?x)", "true"),
    ("not_string", "(!= ?x \"3\")", "true"),
]:
    add(f"pred_{_name}", asked("nation", text=f"[:find ?x :where {_NUMBERS} [{_test}]]"), f"SELECT x FROM (SELECT n_nationkey::BIGINT - 12 AS x FROM nation) WHERE {_sql}")
for _name, _test, _sql in [
    ("starts_with", '(starts-with? ?s "red")', "starts_with(p_name, 'red')"),
    ("ends_with", '(ends-with? ?s "bolt")', "ends_with(p_name, 'bolt')"),
    ("includes", '(includes? ?s "e w")', "contains(p_name, 'e w')"),
    ("blank", "(blank? ?s)", "trim(p_name) = ''"),
    ("re_find", '(re-find? "^b.*t$" ?s)', "regexp_matches(p_name, '^b.*t$')"),
    ("re_matches", '(re-matches? "b[a-z]+ [a-z]{4}" ?s)', "regexp_full_match(p_name, 'b[a-z]+ [a-z]{4}')"),
    ("string", "(string? ?s)", "true"),
    ("boolean", "(boolean? ?s)", "false"),
    ("some", "(some? ?s)", "p_name IS NOT NULL"),
]:
    add(f"pred_{_name}", asked("part", text=f"[:find ?s :where [?p :part/name ?s] [{_test}]]"), f"SELECT DISTINCT p_name AS s FROM part WHERE {_sql}")
add("pred_blank", asked("part", text='[:find ?s ?w :where [?p :part/name ?s] [(split ?s "[a-z]+") [?w ...]] [(blank? ?w)]]'), "SELECT DISTINCT p_name AS s, unnest(['', ' ']) AS w FROM part")
add("pred_kinds", asked(text='[:find ?s ?kind :where [(ground [true "x" 3 2.5]) [?x ...]] (or-join [?x ?kind] (and [(boolean? ?x)] [(ground "truth") ?kind]) (and [(string? ?x)] [(ground "text") ?kind]) (and [(number? ?x)] [(ground "number") ?kind])) [(str ?x) ?s]]'), "SELECT s, kind FROM (VALUES ('true', 'truth'), ('x', 'text'), ('3', 'number'), ('2.5', 'number')) v(s, kind)")
add("pred_truth", asked("nation", text='[:find ?name ?flag :where [?n :nation/name ?name] [?n :nation/nationkey ?k] (or-join [?k ?flag] (and [(< ?k 9)] [(ground true) ?flag] [(true? ?flag)]) (and [(>= ?k 9)] [(ground false) ?flag] [(false? ?flag)]))]'), "SELECT n_name AS name, n_nationkey < 9 AS flag FROM nation")
add("pred_nil", asked("nation", text='[:find ?name :where [?n :nation/name ?name] [?n :nation/nationkey ?k] (or-join [?k ?v] (and [(< ?k 4)] [(ground [nil]) [?v ...]]) (and [(>= ?k 4)] [(identity ?k) ?v])) [(nil? ?v)]]'), "SELECT n_name AS name FROM nation WHERE n_nationkey < 4")
add("temporal_range", asked("orders", text='[:find ?p (as (count ?o) ?n) :where [?o :orders/orderdate ?d] [(<= #inst "1996-03-01T00:00:00Z" ?d)] [(< ?d #inst "1997-01-01T00:00:00Z")] [?o :orders/orderpriority ?p]]'), "SELECT o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1")
add("fn_arithmetic", asked("nation", text="[:find ?x ?a ?b ?c ?d ?e :where [?n :nation/nationkey ?k] [(- ?k 12) ?x] [(+ ?x ?k 1) ?a] [(* ?x -3) ?b] [(abs ?x) ?c] [(dec ?x) ?d] [(- ?x) ?e]]"), "SELECT x, x + k + 1 AS a, x * -3 AS b, abs(x) AS c, x - 1 AS d, -x AS e FROM (SELECT n_nationkey::BIGINT AS k, n_nationkey::BIGINT - 12 AS x FROM nation)")
add("fn_extremes", asked("nation", text="[:find ?k ?lo ?hi :where [?n :nation/nationkey ?k] [(min ?k 7) ?lo] [(max ?k 7 9) ?hi]]"), "SELECT n_nationkey::BIGINT AS k, least(n_nationkey, 7)::BIGINT AS lo, greatest(n_nationkey, 7, 9)::BIGINT AS hi FROM nation")
add("fn_case_trim", asked("part", text='[:find ?up ?t :where [?p :part/name ?s] [(upper-case ?s) ?up] [(str "  " ?s " ") ?wide] [(trim ?wide) ?t]]'), "SELECT DISTINCT upper(p_name) AS up, p_name AS t FROM part")
add("fn_number_text", asked(text='[:find ?s :where [(ground [1.0e21 -2.5e-7 0.00025 98765432.25 0.5 40.0 123456789012345680000.0]) [?x ...]] [(str ?x) ?s]]'), "SELECT s FROM (VALUES ('1e+21'), ('-2.5e-7'), ('0.00025'), ('98765432.25'), ('0.5'), ('40'), ('123456789012345680000')) v(s)")
add("fn_code_units", asked(text='[:find ?s ?n :where [(ground ["abc" "a\U0001F40B" "é中"]) [?s ...]] [(count ?s) ?n]]'), "SELECT s, n::BIGINT AS n FROM (VALUES ('abc', 3), ('a\U0001F40B', 3), ('é中', 2)) v(s, n)")
add("fn_split_groups", asked("nation", text='[:find ?name ?w :where [?n :nation/name ?name] [(split ?name "(_)") [?w ...]]]'), "SELECT n_name AS name, unnest(['NATION', '_', split_part(n_name, '_', 2)]) AS w FROM nation")
add("fn_re_seq", asked("part", text='[:find ?s ?w :where [?p :part/name ?s] [(re-seq "[a-z]{4,}" ?s) [?w ...]]]'), "SELECT DISTINCT p_name AS s, unnest(regexp_extract_all(p_name, '[a-z]{4,}')) AS w FROM part")
add("fn_join", asked("part", text='[:find ?s ?j :where [?p :part/name ?s] [(split ?s " ") ?ws] [(join "-" ?ws) ?j]]'), "SELECT DISTINCT p_name AS s, replace(p_name, ' ', '-') AS j FROM part")
add("fn_vector", asked("nation", text="[:find ?k ?x :where [?n :nation/nationkey ?k] [(vector ?k 11) [?x ...]] [(> ?x 10)]]"), "SELECT DISTINCT k, x FROM (SELECT n_nationkey::BIGINT AS k, unnest([n_nationkey::BIGINT, 11]) AS x FROM nation) WHERE x > 10")
add("fn_tuple", asked("nation", text="[:find ?a ?b :where [?n :nation/nationkey ?k] [?n :nation/name ?name] [(tuple ?name ?k) ?t] [(untuple ?t) [?a ?b]]]"), "SELECT n_name AS a, n_nationkey::BIGINT AS b FROM nation")
add("fn_random_range", asked("nation", text="[:find ?k ?in ?past :where [?n :nation/nationkey ?k] [(rand-int 5) ?r] [(min ?r 0) ?in] [(rand) ?u] [(quot ?u 1) ?v] [(now) ?t] [(max ?v 0.0) ?past]]"), "SELECT n_nationkey::BIGINT AS k, 0::BIGINT AS in, 0::DOUBLE AS past FROM nation")
add("column_function", asked("nation", text="[:find ?name ?r ?m :where [?n :nation/name ?name] [?n :nation/nationkey ?k] [(mirrored ?name) ?r] [(tripled ?k) ?m]]", functions={"mirrored": F.reverse, "tripled": lambda c: c * 3}), "SELECT n_name AS name, reverse(n_name) AS r, 3 * n_nationkey::BIGINT AS m FROM nation")
add("table_function", asked("nation", text="[:find ?name ?d :where [?n :nation/name ?name] [(digits ?name) [?d ...]]]", functions={"digits": (lambda s: [int(c) for c in s if c.isdigit()], "array<bigint>")}), "SELECT DISTINCT n_name AS name, unnest(regexp_extract_all(n_name, '[0-9]'))::BIGINT AS d FROM nation")

# inputs, literals, shapes

add("inputs_tuple", asked("nation", text="[:find ?name :in [?a ?b] :where [?n :nation/nationkey ?k] [(<= ?a ?k ?b)] [?n :nation/name ?name]]", inputs=([4, 9],)), "SELECT n_name AS name FROM nation WHERE n_nationkey BETWEEN 4 AND 9")
add("inputs_collection", asked("nation", text="[:find ?name :in [?k ...] :where [?n :nation/nationkey ?k] [?n :nation/name ?name]]", inputs=([2, 3, 5, 99],)), "SELECT n_name AS name FROM nation WHERE n_nationkey IN (2, 3, 5, 99)")
add("inputs_mixed_kinds", asked("nation", text="[:find ?name ?s :in [?x ...] :where [?n :nation/name ?name] (or-join [?n ?x] [?n :nation/nationkey ?x] [?n :nation/name ?x]) [(str ?x) ?s]]", inputs=([4, "NATION_6", True],)), "SELECT n_name AS name, CASE WHEN n_nationkey = 4 THEN '4' ELSE n_name END AS s FROM nation WHERE n_nationkey = 4 OR n_name = 'NATION_6'")
add("ground_strings", asked("region", text='[:find ?name :where [(ground ["ASIA" "EUROPE" "ATLANTIS"]) [?name ...]] [_ :region/name ?name]]'), "SELECT r_name AS name FROM region WHERE r_name IN ('ASIA', 'EUROPE', 'ATLANTIS')")
add("ground_relation", asked(text='[:find ?a ?b :where [(ground [["x" 1] ["y" 2.5]]) [[?a ?b]]]]'), "SELECT a, b::DOUBLE AS b FROM (VALUES ('x', 1.0), ('y', 2.5)) v(a, b)")
add("find_collection", asked("nation", text="[:find [?name ...] :where [?n :nation/name ?name]]"), "SELECT n_name AS name FROM nation")
add("find_tuple", asked("nation", text="[:find [?name ?k] :where [?n :nation/nationkey ?k] [(= ?k 17)] [?n :nation/name ?name]]"), "SELECT n_name AS name, n_nationkey::BIGINT AS k FROM nation WHERE n_nationkey = 17")
add("find_scalar", asked("orders", text="[:find (count ?o) . :where [?o :orders/orderkey]]"), "SELECT count(*) AS count_o FROM orders")
add("find_keys", asked("region", text="[:find ?k ?n :keys id title :where [?r :region/regionkey ?k] [?r :region/name ?n]]"), "SELECT r_regionkey::BIGINT AS id, r_name AS title FROM region")
add("json_query", asked("region", text={"find": ["?n"], "where": [["?r", ":region/name", "?n"], [["re-find?", {"const": "A$"}, "?n"]]], "order": ["?n"]}), "SELECT r_name AS n FROM region WHERE regexp_matches(r_name, 'A$')")
add("repeated_variable", asked("nation", text="[:find ?k :where [?n :nation/nationkey ?k] [?n :nation/regionkey ?k]]"), "SELECT n_nationkey::BIGINT AS k FROM nation WHERE n_nationkey = n_regionkey")
add("attribute_by_variable", asked("nation", text='[:find ?name :where [?n ?a "NATION_3"] [?n :nation/name ?name]]'), "SELECT n_name AS name FROM nation WHERE n_name = 'NATION_3'")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .catalog import tables

    both = {"$": tables(spark, sf_dir, "nation"), "$r": tables(spark, sf_dir, "region")}
    return run_query(both, "[:find ?n ?r :in $ $r :where [?x :nation/regionkey ?k] [?x :nation/name ?n] [$r ?y :region/regionkey ?k] [$r ?y :region/name ?r]]").df


add("named_sources", _sources, "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")

# aggregates and order

_SIZES = ":with ?p :where [?p :part/brand ?brand] [?p :part/size ?s]]"
add("agg_mean", asked("part", text=f"[:find ?brand (as (avg ?s) ?mean) (as (variance ?s) ?var) (as (stddev ?s) ?dev) {_SIZES}", more=rounded("mean", "var", "dev")), "SELECT p_brand AS brand, round(avg(p_size), 6) AS mean, round(var_pop(p_size), 6) AS var, round(stddev_pop(p_size), 6) AS dev FROM part GROUP BY 1")
add("agg_smallest_n", asked("part", text=f"[:find ?brand (as (min 3 ?s) ?low) (as (max 2 ?s) ?high) {_SIZES}", more=texts(low="", high="")), "SELECT p_brand AS brand, array_to_string(list_slice(list_sort(list(DISTINCT p_size)), 1, 3), ',') AS low, array_to_string(list_slice(list_reverse_sort(list(DISTINCT p_size)), 1, 2), ',') AS high FROM part GROUP BY 1")
add("agg_distinct", asked("part", text=f"[:find ?brand (as (distinct ?s) ?all) {_SIZES}", more=texts(all="")), "SELECT p_brand AS brand, array_to_string(list_sort(list(DISTINCT p_size)), ',') AS all FROM part GROUP BY 1")
add("agg_sample_sizes", asked("part", text=f"[:find ?brand (as (sample 2 ?s) ?some) (as (rand 3 ?s) ?draws) (as (rand 0 ?s) ?none) (as (min ?s) ?lo) (as (max ?s) ?hi) {_SIZES}", more=lambda df: df.select("brand", F.size(F.array_distinct("some")).cast("bigint").alias("some"), F.size("draws").cast("bigint").alias("draws"), F.size("none").cast("bigint").alias("none"), F.forall("draws", lambda x: x.between(F.col("lo"), F.col("hi"))).alias("known"))), "SELECT p_brand AS brand, least(2, count(DISTINCT p_size)) AS some, 3::BIGINT AS draws, 0::BIGINT AS none, true AS known FROM part GROUP BY 1")
add("agg_nulls_count", asked("nation", text="[:find (as (count ?v) ?n) (as (count-distinct ?v) ?d) (as (sum ?v) ?s) :with ?n :where [?n :nation/nationkey ?k] (or-join [?k ?v] (and [(< ?k 20)] [(rem ?k 3) ?v]) (and [(>= ?k 20)] [(ground [nil]) [?v ...]]))]"), "SELECT count(*) AS n, count(DISTINCT v) + 1 AS d, sum(v)::BIGINT AS s FROM (SELECT CASE WHEN n_nationkey < 20 THEN n_nationkey % 3 END AS v FROM nation)")
add("order_of_groups", asked("customer", text="[:find ?m (as (count ?c) ?n) :where [?c :customer/mktsegment ?m] :order [[?n :desc] ?m] :limit 3]"), "SELECT c_mktsegment AS m, count(*) AS n FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
_EMPTY = "[:find ?name ?v :where [?n :nation/name ?name] [?n :nation/nationkey ?k] (or-join [?k ?v] (and [(< ?k 22)] [(identity ?k) ?v]) (and [(>= ?k 22)] [(ground [nil]) [?v ...]])) :order [[?v %s] ?name] :limit 6]"
_EMPTY_SQL = "SELECT n_name AS name, CASE WHEN n_nationkey < 22 THEN n_nationkey END::BIGINT AS v FROM nation ORDER BY 2 %s, 1 LIMIT 6"
add("order_empty_first", asked("nation", text=_EMPTY % ":asc :first"), _EMPTY_SQL % "ASC NULLS FIRST")
add("order_empty_last", asked("nation", text=_EMPTY % ":desc"), _EMPTY_SQL % "DESC NULLS LAST")
add("order_mixed_kinds", asked(text='[:find ?s :where [(ground [true "b" 3 "a" -1.5 false #inst "2001-01-01T00:00:00Z"]) [?x ...]] [(str ?x) ?s] :order [[?x :asc]] :offset 1 :limit 4]'), "SELECT s FROM (VALUES ('3'), ('a'), ('b'), ('false')) v(s)")
add("order_unselected", asked("supplier", text="[:find ?name :where [?s :supplier/name ?name] [?s :supplier/acctbal ?b] :order [[?b :desc] ?name] :limit 7]"), "SELECT s_name AS name FROM supplier ORDER BY s_acctbal DESC, s_name LIMIT 7")

# joins, optional parts, rules

add("optional_binding", asked("documents", "labels", text="[:find ?id ?q :where [?d :documents/doc_id ?id] (or-join [?d ?q] (and [?l :labels/doc_id ?d] [?l :labels/quality ?q]) (and (not-join [?d] [?l :labels/doc_id ?d] [?l :labels/quality _]) [(ground [nil]) [?q ...]]))]"), "SELECT d.doc_id AS id, quality::BIGINT AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
add("not_nested", asked("customer", "orders", text='[:find ?name :where [?c :customer/name ?name] (not-join [?c] [?o :orders/custkey ?c] (not [?o :orders/orderstatus "F"]))]'), "SELECT DISTINCT c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'F')")
add("or_of_kinds", asked("nation", text='[:find ?name ?s :where [?n :nation/name ?name] [?n :nation/nationkey ?k] (or-join [?k ?name ?v] (and [(< ?k 5)] [(identity ?k) ?v]) (and [(>= ?k 5)] [(identity ?name) ?v])) [(str ?v) ?s]]'), "SELECT n_name AS name, CASE WHEN n_nationkey < 5 THEN n_nationkey::VARCHAR ELSE n_name END AS s FROM nation")
add("rule_mutual", asked("nation", text="[:find ?k :rules [[(even ?n) [?n :nation/nationkey 0]] [(even ?n) [?n :nation/nationkey ?k] [(- ?k 1) ?j] [?m :nation/nationkey ?j] (odd ?m)] [(odd ?n) [?n :nation/nationkey ?k] [(- ?k 1) ?j] [?m :nation/nationkey ?j] (even ?m)]] :where (odd ?n) [?n :nation/nationkey ?k]]"), "SELECT n_nationkey::BIGINT AS k FROM nation WHERE n_nationkey % 2 = 1")
add("rule_constant", asked("nation", "region", text='[:find ?name :rules [[(in ?n ?r) [?n :nation/regionkey ?x] [?x :region/name ?r]]] :where (in ?n "ASIA") [?n :nation/name ?name]]'), "SELECT n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
add("rule_negated", asked("customer", "orders", text='[:find ?name :rules [[(urgent ?c) [?o :orders/custkey ?c] [?o :orders/orderpriority "1-URGENT"]]] :where [?c :customer/name ?name] (not (urgent ?c))]'), "SELECT DISTINCT c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
# orders of one customer, each linked to the next of the same priority: a recursion over a large table
add("rule_chain", asked("orders", text='[:find ?k (as (count ?o) ?n) :rules [[(near ?x ?y) [?x :orders/custkey ?c] [?y :orders/custkey ?c] [?x :orders/orderpriority ?p] [?y :orders/orderpriority ?p] [?x :orders/orderkey ?a] [?y :orders/orderkey ?b] [(< ?a ?b)]] [(after ?x ?y) (near ?x ?y)] [(after ?x ?y) (after ?x ?z) (near ?z ?y)]] :where (after ?x ?o) [?x :orders/custkey ?k]]', budget=None), "SELECT x.o_custkey AS k, count(DISTINCT y.o_orderkey) AS n FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey AND x.o_orderpriority = y.o_orderpriority AND x.o_orderkey < y.o_orderkey GROUP BY 1")

# point reads over tables

_E = f"({1 << 36} + n_nationkey)::BIGINT"
add("datoms_of_attribute", over("nation")(lambda db: db.datoms(a="nation/name").select("e", F.col("v_str").alias("v"))), f"SELECT {_E} AS e, n_name AS v FROM nation")
add("datoms_of_entity", over("nation")(lambda db: db.datoms(e=[":nation/nationkey", 6]).select("e", F.coalesce("v_str", F.col("v_long").cast("string")).alias("v"))), f"SELECT {_E} AS e, unnest([n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR]) AS v FROM nation WHERE n_nationkey = 6 UNION SELECT {_E}, n_nationkey::VARCHAR FROM nation WHERE n_nationkey = 6")
add("datoms_of_value", over("nation")(lambda db: db.datoms(a="nation/name", v="NATION_9").select("e")), f"SELECT {_E} AS e FROM nation WHERE n_name = 'NATION_9'")
add("seek_many", over("nation")(lambda db: db.seek_many(db.spark.createDataFrame([(k, (1 << 36) + e, db.schema.attr("nation/name").id) for k, e in enumerate((3, 11, 3, 400))], "place bigint, e bigint, a bigint")).select("place", F.col("v_str").alias("v"))), "SELECT place::BIGINT AS place, n_name AS v FROM (VALUES (0, 3), (1, 11), (2, 3), (3, 400)) k(place, key) LEFT JOIN nation ON n_nationkey = key")
add("first_datom", over("nation")(lambda db: db.spark.createDataFrame([(db.first(a="nation/name")["v_str"],)], "v string")), "SELECT n_name AS v FROM nation ORDER BY n_nationkey LIMIT 1")
add("estimate", over("nation")(lambda db: db.spark.createDataFrame([(db.estimate("nation/name"), db.estimate())], "names bigint, all_facts bigint")), "SELECT count(*) AS names, 3 * count(*) AS all_facts FROM nation")
add("entity_read", over("nation")(lambda db: db.spark.createDataFrame([(k, str(v)) for k, v in db.entity([":nation/nationkey", 8]).items() if k != "db/id"], "attribute string, value string")), "SELECT unnest(['nation/nationkey', 'nation/name', 'nation/regionkey']) AS attribute, unnest([n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR]) AS value FROM nation WHERE n_nationkey = 8")
add("exists", over("nation")(lambda db: db.spark.createDataFrame([(k, db.exists((1 << 36) + k), db.is_tx((1 << 42) + k)) for k in (0, 24, 25)], "k bigint, found boolean, tx boolean")), "SELECT k::BIGINT AS k, k IN (SELECT n_nationkey FROM nation) AS found, true AS tx FROM (VALUES (0), (24), (25)) v(k)")
add("membership", over("nation", "region")(lambda db: db.members("region").select((F.col("e") % (1 << 36)).alias("key"))), "SELECT r_regionkey::BIGINT AS key FROM region")

# trees


def _ids(db, table: str) -> DataFrame:
    return db.members(table)


def _pulled(table: str, pattern, pick: Callable[[], list], *names: str) -> Query:
    return over(table, *names)(lambda db: pull_frame(db, _ids(db, table), pattern).select(*pick()))


_T = lambda *path: F.col("tree." + ".".join(f"`{p}`" for p in path))
_JOINED = lambda field, inner: F.array_join(F.transform(_T(field), lambda x: x[inner].cast("string")), ",")
add("pull_attributes", _pulled("region", "[:region/name (:region/regionkey :as key) (default :region/motto \"none\") :db/id]", lambda: [_T("region/name").alias("name"), _T("key").alias("key"), _T("region/motto").alias("motto"), (_T("db/id") % (1 << 36)).alias("id")]), "SELECT r_name AS name, r_regionkey::BIGINT AS key, 'none' AS motto, r_regionkey::BIGINT AS id FROM region")
add("pull_nested", _pulled("customer", "[:customer/name {:customer/nationkey [:nation/name {:nation/regionkey [:region/name]}]}]", lambda: [_T("customer/name").alias("name"), _T("customer/nationkey", "nation/name").alias("nation"), _T("customer/nationkey", "nation/regionkey", "region/name").alias("region")], "nation", "region"), "SELECT c_name AS name, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
add("pull_reverse", _pulled("region", "[:region/name {:nation/_regionkey [:nation/name]}]", lambda: [_T("region/name").alias("name"), _JOINED("nation/_regionkey", "nation/name").alias("nations")], "nation"), "SELECT r_name AS name, string_agg(n_name, ',' ORDER BY n_nationkey) AS nations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
add("pull_where_order_limit", _pulled("nation", '[:nation/name {[:customer/_nationkey :where [["gt" :customer/acctbal 0] ["eq" :customer/mktsegment "BUILDING"]] :order [[:customer/acctbal :desc]] :offset 1 :limit 2] [:customer/name]}]', lambda: [_T("nation/name").alias("name"), F.coalesce(_JOINED("customer/_nationkey", "customer/name"), F.lit("")).alias("best")], "customer"), "SELECT n_name AS name, coalesce(string_agg(c_name, ',' ORDER BY rn), '') AS best FROM nation LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING') c ON c_nationkey = n_nationkey AND rn BETWEEN 2 AND 3 GROUP BY 1")
add("pull_wildcard", over("region")(lambda db: pull_frame(db, _ids(db, "region"), "[*]").select((_T("db/id") % (1 << 36)).alias("id"), F.element_at(F.col("tree").getField("*"), "region/name")["vs"][0]["v_str"].alias("name"), F.element_at(F.col("tree").getField("*"), "region/regionkey")["vs"][0]["v_long"].alias("key"))), "SELECT r_regionkey::BIGINT AS id, r_name AS name, r_regionkey::BIGINT AS key FROM region")
add("pull_in_find", asked("region", "nation", text="[:find ?n (as (pull ?r [:region/name]) ?tree) :where [?x :nation/name ?n] [?x :nation/regionkey ?r]]", more=lambda df: df.select("n", F.col("tree.`region/name`").alias("region"))), "SELECT n_name AS n, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")


def _ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, each with a reference to the one of twice its key (modulo 7): cycles and tails."""
    from .sources.views import Tables

    frame = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey < 7").select(F.col("n_nationkey").alias("key"), (F.col("n_nationkey") * 2 % 7).alias("next"))
    db = Tables(spark, {"ring": frame}, {"ring": "key"}, {"ring": {"next": "ring"}})
    trees = pull_frame(db, _ids(db, "ring"), "[:ring/key {:ring/next ...}]")
    hop = lambda n: "tree." + "`ring/next`." * n
    # the third reference of a cycle of three comes back to the start: its id alone
    return trees.select(F.col("tree.`ring/key`").alias("key"), F.col(hop(1) + "`ring/key`").alias("one"), F.col(hop(2) + "`ring/key`").alias("two"), (F.col(hop(3) + "`db/id`") % (1 << 36)).alias("back"))


add("pull_recursion", _ring, "SELECT k AS key, CASE WHEN k > 0 THEN k * 2 % 7 END AS one, CASE WHEN k > 0 THEN k * 4 % 7 END AS two, CASE WHEN k > 0 THEN k END AS back FROM (SELECT n_nationkey::BIGINT AS k FROM nation WHERE n_nationkey < 7)")

# the builder


def _built(*names: str, make: Callable, **params) -> Query:
    return over(*names)(lambda db: make().compile(db, **params).df)


add("builder_where", _built("customer", make=lambda: entities("customer").where("acctbal", ">", Param("least")).where("mktsegment", "=", "BUILDING").select("name"), least=9000.0), "SELECT DISTINCT c_name AS name FROM customer WHERE c_acctbal > 9000 AND c_mktsegment = 'BUILDING'")
add("builder_follow", _built("customer", "nation", make=lambda: entities("customer").where("acctbal", "<", -900).follow("nationkey", "nation").select("name")), "SELECT DISTINCT n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < -900")
add("builder_backlink", _built("nation", "supplier", make=lambda: entities("nation").where("name", "=", "NATION_4").backlink(":supplier/nationkey").select("name")), "SELECT s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_4'")
add("builder_some_none_every", _built("customer", "orders", make=lambda: entities("customer").some(":orders/custkey", lambda o: o.where("orderpriority", "=", "1-URGENT")).none(":orders/custkey", lambda o: o.where("orderpriority", "=", "5-LOW")).every(":orders/custkey", lambda o: o.where("totalprice", ">", 0)).select("name")), "SELECT c_name AS name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '5-LOW') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT o_totalprice > 0)")
add("builder_either", _built("part", make=lambda: entities("part").either(lambda p: p.where("size", "=", 7), lambda p: p.where("brand", "in", ["Brand#3", "Brand#4"])).select(key="partkey")), "SELECT p_partkey AS key FROM part WHERE p_size = 7 OR p_brand IN ('Brand#3', 'Brand#4')")
add("builder_aggregate", _built("part", make=lambda: entities("part").has("size").aggregate("n", "count").aggregate("total", "sum", "size").aggregate("kinds", "count-distinct", "size").aggregate("low", "min", "size")), "SELECT count(*) AS n, sum(p_size)::BIGINT AS total, count(DISTINCT p_size) AS kinds, min(p_size)::BIGINT AS low FROM part")
add("builder_order_path", _built("customer", "nation", make=lambda: entities("customer").has("acctbal").select("name", nation="nationkey.:nation/name", bal="acctbal").order_by("nation").order_by("bal", "desc").order_by("name").limit(30)), "SELECT c_name AS name, n_name AS nation, c_acctbal AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey ORDER BY 2, 3 DESC, 1 LIMIT 30")
add("builder_when", _built("nation", make=lambda: entities("nation").has("name").when(True, lambda q: q.where("nationkey", "<", 5)).when(False, lambda q: q.where("nationkey", ">", 900)).stage(lambda q: q.select("name"))), "SELECT n_name AS name FROM nation WHERE n_nationkey < 5")


def _page(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .catalog import tables

    db = tables(spark, sf_dir, "supplier")
    asked_ = entities("supplier").has("name").select("name", "acctbal").order_by("acctbal", "desc").order_by("name")
    _, cursor = asked_.page(db, 8)
    rows, _ = asked_.page(db, 8, cursor)
    return spark.createDataFrame([(r["name"], r["acctbal"]) for r in rows], "name string, acctbal double")


_RICH = entities("customer").where("mktsegment", "=", Param("segment")).where("acctbal", ">", 8000).select("name")
add("builder_open", _built("customer", "nation", make=lambda: entities("nation").open(_RICH, segment="BUILDING").follow("nationkey", "nation").select("name")), "SELECT DISTINCT n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 8000")
add("builder_refine", _built("customer", "nation", make=lambda: _RICH.refine(lambda c: c.follow("nationkey", "nation").where("nationkey", "<", 9)), segment="MACHINERY"), "SELECT DISTINCT c_name AS name FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 8000 AND c_nationkey < 9")
add("builder_enrich", _built("customer", "nation", make=lambda: _RICH.order_by("name").limit(3).logic().enrich("acctbal", home="nationkey.:nation/name"), segment="HOUSEHOLD"), "SELECT c_name AS name, c_acctbal AS acctbal, n_name AS home FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'HOUSEHOLD' AND c_acctbal > 8000")
add("builder_rows", over("orders", "customer", "nation")(lambda db: entities("orders").where("orderpriority", "=", "1-URGENT").where("orderstatus", "=", "O").mark("o").follow("custkey", "customer").where("acctbal", "<", 0).rows(order={"id": "o.orderkey", "price": "o.totalprice"}, who="name", land={"name": "nationkey.:nation/name"}).compile(db).df.toDF("id", "price", "who", "land")), "SELECT o_orderkey AS id, o_totalprice AS price, c_name AS who, n_name AS land FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' AND c_acctbal < 0")
add("builder_gate", _built("nation", make=lambda: entities("nation").has("name").when(Param("below", kind="long"), lambda q: q.where("nationkey", "<", Param("below"))).when(Param("like"), lambda q: q.where("name", "=", Param("like"))).select("name"), below=6), "SELECT n_name AS name FROM nation WHERE n_nationkey < 6")
add("builder_rule", _built("customer", "nation", "region", make=lambda: entities("customer").where("acctbal", "<", -950).call(rule("area", "customer", lambda c: c.follow("nationkey", "nation").follow("regionkey", "region")), ns="region").select("name")), "SELECT DISTINCT r_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal < -950")
_HOME = shape(id=identity(), name=field("customer/name"), land=field("customer/nationkey").select(name=field("nation/name")), motto=field("customer/motto").or_default("none"), orders=field("orders/_custkey").select(price=field("orders/totalprice")).with_(order=[[":orders/totalprice", ":desc"]], limit=2))
add("builder_shape", over("customer", "nation", "orders")(lambda db: entities("customer").where("acctbal", ">", 9500).shaped(_HOME).compile(db).df.select((F.col("tree.`db/id`") % (1 << 36)).alias("id"), F.col("tree.name").alias("name"), F.col("tree.land.name").alias("land"), F.col("tree.motto").alias("motto"), F.array_max(F.col("tree.orders.price")).alias("best"))), "SELECT c_custkey AS id, c_name AS name, n_name AS land, 'none' AS motto, max(o_totalprice) AS best FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 9500 GROUP BY ALL")
add("builder_page", _page, "SELECT s_name AS name, s_acctbal AS acctbal FROM supplier ORDER BY s_acctbal DESC, s_name LIMIT 8 OFFSET 8")

# logs: views, transactions, storage, policies, standing queries


def _events(spark: SparkSession, sf_dir: str):
    from .catalog import event_log

    return event_log(spark, sf_dir)


_STATE = "(SELECT user_id, event_type, event_id % 5 <> 0 AS op, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn, event_id FROM events WHERE user_id IS NOT NULL)"
_EARLY = _STATE.replace("FROM events WHERE", "FROM events WHERE event_id <= 600 AND")
add("get_else_default", lambda spark, sf_dir: run_query(_events(spark, sf_dir), '[:find ?e ?t :where [?e :user/value ?v] [(> ?v 90)] [(get-else $ ?e :user/type "gone") ?t]]').df, f"WITH t AS (SELECT user_id, event_type FROM {_STATE} WHERE rn = 1 AND op), v AS (SELECT user_id, value FROM (SELECT user_id, value, event_id % 5 <> 0 AS op, row_number() OVER (PARTITION BY user_id, value ORDER BY event_id DESC) AS rn FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL) WHERE rn = 1 AND op AND value > 90) SELECT DISTINCT v.user_id AS e, coalesce(event_type, 'gone') AS t FROM v LEFT JOIN t ON v.user_id = t.user_id")
add("get_else_other_kind", lambda spark, sf_dir: run_query(_events(spark, sf_dir), "[:find ?e ?s :where [?e :user/value ?v] [(> ?v 90)] [(get-else $ ?e :user/type -1) ?t] [(str ?t) ?s]]").df, ALL["get_else_default"][1].replace("AS t FROM v", "AS s FROM v").replace("'gone'", "'-1'"))
add("missing_attribute", lambda spark, sf_dir: run_query(_events(spark, sf_dir).as_of(600), "[:find ?e :where [?e :user/value ?v] [(missing? $ ?e :user/type)]]").df, f"WITH t AS (SELECT user_id FROM {_EARLY} WHERE rn = 1 AND op) SELECT DISTINCT user_id AS e FROM (SELECT user_id, event_id % 5 <> 0 AS op, row_number() OVER (PARTITION BY user_id, value ORDER BY event_id DESC) AS rn FROM events WHERE event_id <= 600 AND user_id IS NOT NULL AND value IS NOT NULL) WHERE rn = 1 AND op AND user_id NOT IN (SELECT user_id FROM t)")
add("transaction_of_fact", lambda spark, sf_dir: run_query(_events(spark, sf_dir), "[:find ?e ?type ?t :where [?e :user/type ?type ?tx] [(- ?tx %d) ?t] [(> ?t 9000)]]" % (1 << 42)).df, f"SELECT user_id AS e, event_type AS type, event_id AS t FROM {_STATE} WHERE rn = 1 AND op AND event_id > 9000")
add("cross_view", lambda spark, sf_dir: run_query({"$": _events(spark, sf_dir), "$old": _events(spark, sf_dir).as_of(5000)}, "[:find ?e ?type :in $ $old :where [?e :user/type ?type] (not [$old ?e :user/type ?type])]").df, f"SELECT user_id AS e, event_type AS type FROM {_STATE} WHERE rn = 1 AND op EXCEPT SELECT user_id, event_type FROM {_STATE.replace('user_id IS NOT NULL', 'user_id IS NOT NULL AND event_id <= 5000')} WHERE rn = 1 AND op")


def _overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .catalog import event_log

    db = event_log(spark, sf_dir)
    old = db.log.where("t <= 6000")
    later = db.log.where("t > 6000")
    from dataclasses import replace

    return run_query(replace(db, log=old).overlaid(later), "[:find ?e ?type :where [?e :user/type ?type]]").df


add("overlay_view", _overlay, f"SELECT user_id AS e, event_type AS type FROM {_STATE} WHERE rn = 1 AND op")

_NATION_SCHEMA = [{":db/ident": ":land/code", ":db/valueType": ":db.type/long", ":db/unique": ":db.unique/identity"}, {":db/ident": ":land/title", ":db/valueType": ":db.type/string"}, {":db/ident": ":land/near", ":db/valueType": ":db.type/ref", ":db/cardinality": ":db.cardinality/many"}, {":db/ident": ":land/parts", ":db/valueType": ":db.type/ref", ":db/cardinality": ":db.cardinality/many", ":db/isComponent": True}]
_WHO = "[:find ?c ?t :where [?x :land/code ?c] [?x :land/title ?t]]"


def _lands(spark: SparkSession, sf_dir: str, path: str | None = None) -> Connection:
    """The nations as a database of its own, each near the next; written by transactions."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()  # the 25 nations
    conn = Connection(spark, now=lambda: 1, path=path)
    conn.transact(_NATION_SCHEMA)
    conn.transact([{":db/id": f"n{r.n_nationkey}", ":land/code": r.n_nationkey, ":land/title": edn.Const(r.n_name), ":land/near": [f"n{(r.n_nationkey + 1) % len(rows)}"]} for r in rows])
    return conn


def _store(spark: SparkSession, sf_dir: str) -> tuple[Store, Connection]:
    path = f"{shared_dir(spark)}/lands-{uuid.uuid4().hex}"
    conn = _lands(spark, sf_dir, path)
    return Store(spark, path), conn


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    conn = _lands(spark, sf_dir)
    conn.transact([{":land/code": 3, ":land/title": "third"}, {":land/code": 100, ":land/title": "new", ":land/_near": [":land/code", 3]}])
    return run_query(conn.db(), "[:find ?c ?t ?from :where [?x :land/code ?c] [?x :land/title ?t] [?y :land/near ?x] [?y :land/code ?from]]").df


def _retracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    conn = _lands(spark, sf_dir)
    conn.transact([[":db/retract", [":land/code", 1], ":land/title"], [":db/retractEntity", [":land/code", 2]], [":db/add", [":land/code", 4], ":land/title", edn.Const("four")], [":db/retract", [":land/code", 5], ":land/title", edn.Const("no such title")]])
    return run_query(conn.db(), _WHO).df


def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    conn = _lands(spark, sf_dir)
    conn.transact([[":db/retract", [":land/code", 7], ":land/code", 7], [":db/add", [":land/code", 8], ":land/code", 7]])
    return run_query(conn.db(), _WHO).df


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    conn = _lands(spark, sf_dir)
    conn.transact([{":db/id": [":land/code", 0], ":land/parts": [{":land/code": 200, ":land/title": "isle", ":land/parts": [{":land/code": 201, ":land/title": "rock"}]}]}, [":db/add", [":land/code", 9], ":land/near", [":land/code", 0]]])
    conn.transact([[":db/retractEntity", [":land/code", 0]]])
    return run_query(conn.db(), "[:find ?c ?t ?n :where [?x :land/code ?c] [?x :land/title ?t] [?x :land/near ?y] [?y :land/code ?n]]").df


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, conn = _store(spark, sf_dir)
    first = conn.transact([[":db/add", [":land/code", 1], ":land/title", edn.Const("once")]], "client-1")
    again = store.connect().transact([[":db/add", [":land/code", 1], ":land/title", edn.Const("twice")]], "client-1")
    return spark.createDataFrame([(first.t == again.t, store.connect().db().entity([":land/code", 1])["land/title"])], "same boolean, title string")


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, conn = _store(spark, sf_dir)
    conn.transact_many([[[":db/add", [":land/code", k], ":land/title", edn.Const(f"g{k}")]] for k in range(3)])
    return run_query(store.connect(conn.t).db(), _WHO).df


def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, conn = _store(spark, sf_dir)
    store.compact()
    conn.transact([[":db/add", [":land/code", 6], ":land/title", edn.Const("six")]])
    store.compact()
    store.retain(1)
    return run_query(store.connect().db(), _WHO).df


def _rooted(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, conn = _store(spark, sf_dir)
    root = store.compact()
    conn.transact([[":db/add", [":land/code", 6], ":land/title", edn.Const("six")]])
    store.compact()
    return run_query(store.at_root(root), _WHO).df


def _from_datoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_query(Connection.from_datoms(spark, _lands(spark, sf_dir).log()).db(), _WHO).df


def _followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, conn = _store(spark, sf_dir)
    replica = Replica(store)
    reports = [conn.transact([[":db/add", [":land/code", k], ":land/title", edn.Const(f"r{k}")]]) for k in range(4)]
    order = [reports[0], reports[0], reports[2], reports[1], reports[3]]
    said = [replica.offer(r.t, r.datoms) for r in order]
    assert said == ["applied", "duplicate", "filled", "duplicate", "applied"], said
    return run_query(replica.db(conn.t), _WHO).df


def _framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, conn = _store(spark, sf_dir)
    replica = Replica(store)
    start = conn.t
    for k in range(3):
        conn.transact([[":db/add", [":land/code", k], ":land/title", edn.Const(f"f{k}")]])
    said = follow(replica, frames(store, start))
    assert said == ["hello", "applied", "applied", "applied"], said
    return run_query(replica.db(conn.t), _WHO).df


def _reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    onward = rule("onward", "land", lambda x: x.follow("near"), lambda x: x.follow("near").call(onward))
    return entities("land").where("code", "=", 20).call(onward).select("code").compile(_lands(spark, sf_dir).db()).df


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, conn = _store(spark, sf_dir)
    seen: list = []
    live = Live(store, _WHO, emit=lambda rows, t: seen.append(rows))
    at = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    live.start(spark, at, once=True).awaitTermination()
    conn.transact([[":db/add", [":land/code", 2], ":land/title", edn.Const("two")]])
    live.start(spark, at, once=True).awaitTermination()
    return spark.createDataFrame([(c, t, len(seen)) for c, t in seen[-1]], "c bigint, t string, results int")


_POLICY = [Rule("allow", "read", "land", ("class", "reader")), Rule("deny", "read", "land/title", ("eq", "land/code", 5)), Rule("deny", "read", "land/near")]


def _fed(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, conn = _store(spark, sf_dir)
    reader = Principal(classes=frozenset({"reader"}))
    t = conn.t
    conn.transact([[":db/add", [":land/code", 1], ":land/title", edn.Const("seen")]])
    conn.transact([[":db/add", [":land/code", 1], ":land/near", [":land/code", 9]]])
    conn.transact([[":db/retract", [":land/code", 5], ":land/code", 5]])  # its title comes into view
    feed = changes(store, t, now=lambda db: Policy(_POLICY).readable(db, reader))
    kinds = [next((k for k in ("skip", "resync") if x.get(k)), "datoms") for x in feed]
    return spark.createDataFrame([(x["t"] - t, k) for x, k in zip(feed, kinds)], "t bigint, kind string")


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    conn = _lands(spark, sf_dir)
    own = Policy([Rule("allow", "create", "land", ("eq", "land/near", ("principal", "id"))), Rule("allow", "add", "land/title", ("eq", "land/near", ("principal", "id")))], presets={"land/near": ("principal", "id")})
    who = Principal(id=conn.db().entid([":land/code", 6]))
    conn.transact([{":land/code": 300, ":land/title": "granted"}], policy=own, who=who)  # made near the principal
    conn.transact([[":db/add", [":land/code", 5], ":land/title", edn.Const("mine")]], policy=own, who=who)
    refused = 0
    for ops in ([[":db/add", [":land/code", 9], ":land/title", edn.Const("theirs")]], [[":db/retractEntity", [":land/code", 5]]], [{":land/code": 301, ":land/near": [[":land/code", 1]]}]):
        try:
            conn.transact(ops, policy=own, who=who)
        except TxError:
            refused += 1
    return run_query(conn.db(), "[:find ?c ?t :where [?x :land/code ?c] [?x :land/title ?t]]").df.withColumn("refused", F.lit(refused))


def _allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = Policy(_POLICY).readable(_lands(spark, sf_dir).db(), Principal(classes=frozenset({"reader"})))
    return run_query(view, "[:find ?c ?t :where [?x :land/code ?c] [(get-else $ ?x :land/title \"hidden\") ?t] (not [?x :land/near _])]").df


def _instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    conn = _lands(spark, sf_dir)
    conn._now = lambda: int(dt.datetime(2020, 2, 2, tzinfo=dt.timezone.utc).timestamp() * 1000)
    conn.transact([[":db/add", [":land/code", 1], ":land/title", edn.Const("dated")]])
    return run_query(conn.db(), '[:find ?t ?at :where [?x :land/title ?t ?tx] [?tx :db/txInstant ?i] [(> ?i #inst "2019-01-01T00:00:00Z")] [(str ?i) ?at]]').df


_NATIONS = "SELECT n_nationkey::BIGINT AS c, {} AS t FROM nation"
add("tx_upsert", _upsert, "SELECT c, t, f AS from FROM (SELECT n_nationkey::BIGINT AS c, CASE WHEN n_nationkey = 3 THEN 'third' ELSE n_name END AS t, ((n_nationkey + 24) % 25)::BIGINT AS f FROM nation UNION ALL SELECT 100, 'new', 3)")
add("tx_retract", _retracted, _NATIONS.format("CASE WHEN n_nationkey = 4 THEN 'four' ELSE n_name END") + " WHERE n_nationkey NOT IN (1, 2)")
add("tx_unique_moves", _moved, "SELECT CASE WHEN n_nationkey = 8 THEN 7 ELSE n_nationkey END::BIGINT AS c, n_name AS t FROM nation WHERE n_nationkey <> 7")
add("tx_components", _components, "SELECT n_nationkey::BIGINT AS c, n_name AS t, (n_nationkey + 1)::BIGINT AS n FROM nation WHERE n_nationkey BETWEEN 1 AND 23")
add("tx_replay", _replayed, "SELECT true AS same, 'once' AS title")
add("tx_group", _grouped, _NATIONS.format("CASE WHEN n_nationkey < 3 THEN 'g' || n_nationkey ELSE n_name END"))
add("tx_instant", _instant, "SELECT 'dated' AS t, '2020-02-02T00:00:00.000Z' AS at")
add("store_compact", _compacted, _NATIONS.format("CASE WHEN n_nationkey = 6 THEN 'six' ELSE n_name END"))
add("store_old_root", _rooted, _NATIONS.format("n_name"))
add("store_from_datoms", _from_datoms, _NATIONS.format("n_name"))
add("replica_follow", _followed, _NATIONS.format("CASE WHEN n_nationkey < 4 THEN 'r' || n_nationkey ELSE n_name END"))
add("replica_frames", _framed, _NATIONS.format("CASE WHEN n_nationkey < 3 THEN 'f' || n_nationkey ELSE n_name END"))
add("builder_rule_recursive", _reached, "SELECT n_nationkey::BIGINT AS code FROM nation")
add("live_latest", _live, "SELECT n_nationkey::BIGINT AS c, CASE WHEN n_nationkey = 2 THEN 'two' ELSE n_name END AS t, 2 AS results FROM nation")
add("change_feed", _fed, "SELECT t::BIGINT AS t, kind FROM (VALUES (1, 'datoms'), (2, 'skip'), (3, 'resync')) v(t, kind)")
add("policy_write", _written, "SELECT n_nationkey::BIGINT AS c, CASE WHEN n_nationkey = 5 THEN 'mine' ELSE n_name END AS t, 3 AS refused FROM nation UNION ALL SELECT 300, 'granted', 3")
add("policy_read", _allowed, _NATIONS.format("CASE WHEN n_nationkey = 5 THEN 'hidden' ELSE n_name END"))
