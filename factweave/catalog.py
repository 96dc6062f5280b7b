"""The engine's registered queries: Datalog over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .plans.compiler import BUDGET, run_query
from .sources.views import DATOMS, Attribute, Facts, Schema, Tables
from .surfaces import ALL as SURFACES

PREFIX = {"region": "r_", "nation": "n_", "customer": "c_", "supplier": "s_", "part": "p_", "orders": "o_", "lineitem": "l_"}
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "labels": "doc_id", "pages": "page_id", "benchmark": "item_id"}
REFS = {"nation": {"n_regionkey": "region"}, "customer": {"c_nationkey": "nation"}, "supplier": {"s_nationkey": "nation"}, "orders": {"o_custkey": "customer"}, "lineitem": {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}, "labels": {"doc_id": "documents"}}


_SCHEMAS: dict[tuple, StructType] = {}


def _frame(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; its schema is read from the files once as long as they don't change."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    known = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at)
    stamp = path, known.getModificationTime(), known.getLen()
    if stamp not in _SCHEMAS:
        _SCHEMAS[stamp] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[stamp]).parquet(path)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> Tables:
    """The named tables as one database. Rows of lineitem have no key of their own; their place in the file stands in."""
    frames = {n: _frame(spark, f"{sf_dir}/{n}.parquet") for n in names}
    place = F.pmod(F.xxhash64(F.col("_metadata.file_path")), F.lit(512)) * F.lit(1 << 27) + F.col("_metadata.row_index")
    keys = {n: KEYS.get(n, place) for n in names}
    refs = {n: {c: t for c, t in REFS.get(n, {}).items() if t in frames} for n in names}
    return Tables(spark, frames, keys, refs, lambda table, column: column.removeprefix(PREFIX.get(table, "")))


def ask(*names: str, text, **more) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        inputs = more.get("inputs", ())
        return run_query(tables(spark, sf_dir, *names), text, *inputs, functions=more.get("functions"), budget=more.get("budget", BUDGET)).df

    return run


def event_log(spark: SparkSession, sf_dir: str) -> Facts:
    """Events as facts: each adds a type and a value to its user's, or takes them away, in the order of event ids."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    schema = Schema({"user/type": Attribute("user/type", 1001, "string", True), "user/value": Attribute("user/value", 1002, "double", True)}, {"user/type": 1001, "user/value": 1002})
    empty = lambda kind: F.lit(None).cast(kind)

    def facts(attr: int, vt: int, number, word):
        return ev.where("user_id is not null").select(F.col("user_id").cast("bigint").alias("e"), F.lit(attr).cast("bigint").alias("a"), F.lit(vt).cast("tinyint").alias("vt"), empty("bigint").alias("v_long"), number.alias("v_double"), word.alias("v_str"), empty("boolean").alias("v_bool"), empty("binary").alias("v_bytes"), F.col("event_id").alias("t"), (F.col("event_id") % 5 != 0).alias("op"))

    log = facts(1001, 3, empty("double"), F.col("event_type")).unionByName(facts(1002, 2, F.col("value"), empty("string")).where("v_double is not null")).select(*DATOMS.fieldNames())
    return Facts(spark, log, schema)


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_query(event_log(spark, sf_dir).history(), "[:find ?op (as (count ?e) ?n) :with ?tx :where [?e :user/type _ ?tx ?op]]").df


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_query(event_log(spark, sf_dir), "[:find ?e ?type :where [?e :user/type ?type]]").df


def _as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_query(event_log(spark, sf_dir).as_of(4000), "[:find ?e ?type :where [?e :user/type ?type]]").df


_CURRENT = "SELECT user_id AS e, event_type AS type FROM (SELECT user_id, event_type, max(event_id) AS t FROM events WHERE user_id IS NOT NULL{} GROUP BY ALL) WHERE t % 5 <> 0"
_FLAG = '[:find ?cn (as (count ?o) ?n) :where [?o :orders/custkey ?c] [?c :customer/mktsegment "BUILDING"] [?c :customer/nationkey ?nat] [?nat :nation/name ?cn]]'


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask("orders", "customer", "nation", text=_FLAG)(spark, sf_dir)


#: name -> (query, SQL or None)
_ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "flagship_join": (flagship, "SELECT n_name AS cn, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1"),
    "pattern_scan": (ask("customer", text="[:find ?name ?bal :where [?c :customer/name ?name] [?c :customer/acctbal ?bal]]"), "SELECT DISTINCT c_name AS name, c_acctbal AS bal FROM customer WHERE c_name IS NOT NULL AND c_acctbal IS NOT NULL"),
    "pattern_const": (ask("customer", text='[:find ?name :where [?c :customer/mktsegment "BUILDING"] [?c :customer/name ?name]]'), "SELECT DISTINCT c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "lookup_ref": (ask("nation", "customer", text="[:find ?name :where [?c :customer/nationkey [:nation/nationkey 7]] [?c :customer/name ?name]]"), "SELECT DISTINCT c_name AS name FROM customer WHERE c_nationkey = 7"),
    "join_3clause": (ask("customer", "nation", "region", text="[:find ?name ?nn ?rn :where [?c :customer/name ?name] [?c :customer/nationkey ?n] [?n :nation/name ?nn] [?n :nation/regionkey ?r] [?r :region/name ?rn]]"), "SELECT DISTINCT c_name AS name, n_name AS nn, r_name AS rn FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "reverse_ref": (ask("supplier", "nation", text='[:find ?sn :where [?n :nation/name ?nn] [?s :supplier/nationkey ?n] [?s :supplier/name ?sn] [(< ?nn "NATION_2")]]'), "SELECT DISTINCT s_name AS sn FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name < 'NATION_2'"),
    "attr_variable": (ask("nation", "region", text="[:find (as (count ?e) ?n) :with ?a :where [?e ?a _]]"), "SELECT (SELECT 4 * count(*) FROM nation) + (SELECT 2 * count(*) FROM region) AS n"),
    "theta_pred": (ask("part", text='[:find ?a ?b :where [?x :part/brand "Brand#11"] [?x :part/size ?sx] [?x :part/partkey ?a] [?y :part/brand "Brand#11"] [?y :part/size ?sy] [?y :part/partkey ?b] [(< ?sx ?sy)]]', budget=None), "SELECT DISTINCT x.p_partkey AS a, y.p_partkey AS b FROM part x JOIN part y ON x.p_size < y.p_size WHERE x.p_brand = 'Brand#11' AND y.p_brand = 'Brand#11'"),
    "cross_product": (ask("region", text="[:find ?a ?b :where [?x :region/name ?a] [?y :region/name ?b]]"), "SELECT x.r_name AS a, y.r_name AS b FROM region x, region y"),
    "inputs_relation": (ask("nation", text="[:find ?name ?w :in [[?k ?w]] :where [?n :nation/nationkey ?k] [?n :nation/name ?name]]", inputs=([[1, "a"], [3, "b"], [5, "c"], [99, "d"]],)), "SELECT n_name AS name, w FROM nation JOIN (VALUES (1, 'a'), (3, 'b'), (5, 'c'), (99, 'd')) v(k, w) ON n_nationkey = k"),
    "inputs_scalar": (ask("customer", text="[:find ?name :in ?min :where [?c :customer/acctbal ?b] [(> ?b ?min)] [?c :customer/name ?name]]", inputs=(9000.0,)), "SELECT DISTINCT c_name AS name FROM customer WHERE c_acctbal > 9000"),
    "set_sum": (ask("part", text="[:find (as (sum ?s) ?total) :where [?p :part/size ?s]]"), "SELECT sum(DISTINCT p_size)::BIGINT AS total FROM part"),
    "with_sum": (ask("part", text="[:find ?brand (as (sum ?s) ?total) :with ?p :where [?p :part/brand ?brand] [?p :part/size ?s]]"), "SELECT p_brand AS brand, sum(p_size)::BIGINT AS total FROM part GROUP BY 1"),
    "agg_all": (ask("part", text="[:find ?brand (as (count ?s) ?n) (as (count-distinct ?s) ?d) (as (min ?s) ?lo) (as (max ?s) ?hi) (as (median ?s) ?mid) :with ?p :where [?p :part/brand ?brand] [?p :part/size ?s]]"), "SELECT p_brand AS brand, count(*) AS n, count(DISTINCT p_size) AS d, min(p_size)::BIGINT AS lo, max(p_size)::BIGINT AS hi, median(p_size)::DOUBLE AS mid FROM part GROUP BY 1"),
    "having": (ask("orders", text="[:find ?p (as (count ?o) ?n) :where [?o :orders/orderpriority ?p] :having [(> ?n 100)]]"), "SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 100"),
    "not_labelled": (ask("documents", "labels", text="[:find ?id :where [?d :documents/doc_id ?id] (not [?l :labels/doc_id ?d])]"), "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "not_join_path": (ask("orders", "customer", text='[:find ?name :where [?c :customer/name ?name] (not-join [?c] [?o :orders/custkey ?c] [?o :orders/orderpriority "1-URGENT"])]'), "SELECT DISTINCT c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"),
    "or_join": (ask("part", text='[:find ?k :where [?p :part/partkey ?k] (or-join [?p] [?p :part/brand "Brand#12"] (and [?p :part/size ?s] [(> ?s 45)]))]'), "SELECT p_partkey AS k FROM part WHERE p_brand = 'Brand#12' UNION SELECT p_partkey FROM part WHERE p_size > 45"),
    "optional_or_default": (ask("documents", "labels", text='[:find ?id ?q :where [?d :documents/doc_id ?id] (or-join [?d ?q] (and [?l :labels/doc_id ?d] [?l :labels/quality ?q]) (and (not-join [?d] [?l :labels/doc_id ?d]) [(ground -1) ?q]))]'), "SELECT d.doc_id AS id, coalesce(quality, -1)::BIGINT AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "order_limit": (ask("customer", text="[:find ?name ?b :where [?c :customer/name ?name] [?c :customer/acctbal ?b] :order [[?b :desc] [?name :asc]] :offset 5 :limit 20]"), "SELECT c_name AS name, c_acctbal AS b FROM customer ORDER BY c_acctbal DESC, c_name LIMIT 20 OFFSET 5"),
    "after_cursor": (ask("customer", text='[:find ?name ?b :where [?c :customer/name ?name] [?c :customer/acctbal ?b] :order [[?b :desc] [?name :asc]] :after [5000.0 "A"] :limit 20]'), "SELECT c_name AS name, c_acctbal AS b FROM customer WHERE c_acctbal < 5000 OR c_acctbal = 5000 AND c_name > 'A' ORDER BY c_acctbal DESC, c_name LIMIT 20"),
    "rule_nonrec": (ask("customer", "nation", text="[:find ?name :rules [[(rich ?c) [?c :customer/acctbal ?b] [(> ?b 9500)]] [(rich ?c) [?c :customer/mktsegment \"BUILDING\"] [?c :customer/acctbal ?b] [(> ?b 9000)]]] :where (rich ?c) [?c :customer/name ?name]]"), "SELECT DISTINCT c_name AS name FROM customer WHERE c_acctbal > 9500 OR c_mktsegment = 'BUILDING' AND c_acctbal > 9000"),
    "rule_recursive": (ask("nation", text="[:find ?a ?b :rules [[(next ?x ?y) [?x :nation/nationkey ?k] [(* 2 ?k) ?l] [?y :nation/nationkey ?l]] [(next ?x ?y) [?x :nation/nationkey ?k] [(+ 7 ?k) ?l] [?y :nation/nationkey ?l]] [(reach ?x ?y) (next ?x ?y)] [(reach ?x ?y) (reach ?x ?z) (next ?z ?y)]] :where (reach ?x ?y) [?x :nation/nationkey ?a] [?y :nation/nationkey ?b]]"), "WITH RECURSIVE e AS (SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON y.n_nationkey IN (2 * x.n_nationkey, x.n_nationkey + 7)), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a::BIGINT AS a, b::BIGINT AS b FROM r"),
    "forall_every": (ask("orders", "customer", text='[:find ?name :where [?c :customer/name ?name] [?any :orders/custkey ?c] (not-join [?c] [?o :orders/custkey ?c] (not [?o :orders/orderstatus "O"]))]'), "SELECT DISTINCT c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'O')"),
    "fn_math": (ask("nation", text="[:find ?k ?h ?q ?r ?m ?i :where [?n :nation/nationkey ?k] [(/ ?k 2) ?h] [(quot ?k 3) ?q] [(rem ?k 3) ?r] [(mod ?k -3) ?m] [(inc ?k) ?i]]"), "SELECT n_nationkey::BIGINT AS k, n_nationkey / 2.0::DOUBLE AS h, (n_nationkey // 3)::BIGINT AS q, (n_nationkey % 3)::BIGINT AS r, (((n_nationkey % -3) + -3) % -3)::BIGINT AS m, (n_nationkey + 1)::BIGINT AS i FROM nation"),
    "fn_string": (ask("nation", text='[:find ?name ?low ?sub ?len ?s :where [?n :nation/name ?name] [?n :nation/nationkey ?k] [(lower-case ?name) ?low] [(subs ?name 1 4) ?sub] [(count ?name) ?len] [(str ?name "-" ?k) ?s]]'), "SELECT n_name AS name, lower(n_name) AS low, substr(n_name, 2, 3) AS sub, length(n_name)::BIGINT AS len, n_name || '-' || n_nationkey AS s FROM nation"),
    "fn_regex": (ask("part", text='[:find ?b ?d :where [?p :part/brand ?b] [(re-find "[0-9]+" ?b) ?d] [(re-matches? "Brand.*" ?b)]]'), "SELECT DISTINCT p_brand AS b, regexp_extract(p_brand, '[0-9]+') AS d FROM part WHERE regexp_full_match(p_brand, 'Brand.*')"),
    "fn_collection": (ask("part", text='[:find ?w (as (count ?p) ?n) :where [?p :part/type ?t] [(split ?t " ") [?w ...]]]'), "SELECT w, count(DISTINCT p_partkey) AS n FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w FROM part) GROUP BY w"),
    "user_function": (ask("nation", text="[:find ?name ?n :where [?x :nation/name ?name] [(vowels ?name) ?n]]", functions={"vowels": (lambda s: sum(c in "AEIOU" for c in s), "long")}), "SELECT n_name AS name, length(regexp_replace(n_name, '[^AEIOU]', '', 'g'))::BIGINT AS n FROM nation"),
    "cross_type_order": (ask("nation", text='[:find ?name :where [?n :nation/name ?name] [(> ?name 5)] [(!= ?name 5)]]'), "SELECT DISTINCT n_name AS name FROM nation"),
    "star_wide": (ask("lineitem", "orders", "part", text='[:find ?brand ?flag (as (sum ?price) ?total) (as (count ?l) ?n) :with ?l :where [?l :lineitem/partkey ?p] [?l :lineitem/quantity ?q] [(= ?q 10)] [?l :lineitem/returnflag ?flag] [?l :lineitem/linenumber ?price] [?p :part/brand ?brand]]'), "SELECT p_brand AS brand, l_returnflag AS flag, sum(l_linenumber)::BIGINT AS total, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity = 10 GROUP BY ALL"),
    "temporal_compare": (ask("orders", text='[:find ?p (as (count ?o) ?n) :where [?o :orders/orderdate ?d] [(< ?d #inst "1996-06-01T00:00:00Z")] [?o :orders/orderpriority ?p]]'), "SELECT o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1996-06-01' GROUP BY 1"),
    "history_ops": (_history, "SELECT event_id % 5 <> 0 AS op, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1"),
    "current_view": (_current, _CURRENT.format("")),
    "asof_view": (_as_of, _CURRENT.format(" AND event_id <= 4000")),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for k, (q, _) in (_ALL | SURFACES).items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in (_ALL | SURFACES).items() if s}
