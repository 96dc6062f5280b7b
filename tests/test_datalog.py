import random
import statistics

import pytest
from pyspark.sql import functions as F

from factweave import edn
from factweave.plans.compiler import run_query
from factweave.plans.query import BudgetError, QueryError, parse_query
from factweave.sources.views import Tables
from factweave.transactions import Connection, TxError
from tests import naive
from tests.harbour import CLOCK, CRANES, PORTS, SCHEMA, attribute, entities


@pytest.fixture(scope="module")
def coast(spark):
    conn = Connection(spark, now=lambda: CLOCK)
    conn.transact(SCHEMA)
    ids = conn.transact(entities()).tempids
    # the same facts from one cached table: fewer plans to build for each query
    return Connection(spark, now=lambda: CLOCK, log=conn.log().cache()), ids


def q(db, text, *inputs, **more):
    return run_query(db, text, *inputs, **more).value()


def as_set(rows):
    return {repr(r) for r in rows}


def pick(*names, when=lambda p: True):
    """Rows of the named attributes of the ports that have all of them."""
    return [[p[n] for n in names] for p in PORTS.values() if all(n in p for n in names) and when(p)]


def column(name, when=lambda p: True):
    return [r[0] for r in pick(name, when=when)]


BERTHS = [p["berths"] for p in PORTS.values()]

#: question -> what plain Python finds in PORTS; lists are compared as sets
RELATIONS = {
    "[:find ?t ?b :where [?p :port/title ?t] [?p :port/berths ?b]]": lambda: pick("title", "berths"),
    "[:find ?t ?u :where [?p :port/lines ?o] [?p :port/title ?t] [?o :port/title ?u]]": lambda: [[p["title"], PORTS[o]["title"]] for p in PORTS.values() for o in p.get("lines", ())],
    '[:find ?t :where [?h :port/code "VEL"] [?p :port/hub ?h] [?p :port/title ?t]]': lambda: pick("title", when=lambda p: p.get("hub") == "VEL"),
    "[:find ?t ?g :where [?p :port/title ?t] [?p :port/goods ?g] [(includes? ?g \"o\")]]": lambda: [[p["title"], g] for p in PORTS.values() for g in p.get("goods", ()) if "o" in g],
    "[:find ?a ?b :where [?p :port/goods ?g] [?o :port/goods ?g] [?p :port/code ?a] [?o :port/code ?b] [(< ?a ?b)]]": lambda: [[a, b] for a in PORTS for b in PORTS if a < b and set(PORTS[a].get("goods", ())) & set(PORTS[b].get("goods", ()))],
    "[:find ?c (count ?p) (min ?b) (max ?b) :where [?p :port/coast ?c] [?p :port/berths ?b]]": lambda: [[c, len(x), min(x), max(x)] for c in {p.get("coast") for p in PORTS.values()} - {None} for x in [column("berths", lambda p: p.get("coast") == c)]],
    "[:find ?c (as (sum ?b) ?s) :with ?p :where [?p :port/coast ?c] [?p :port/berths ?b] :having [(>= ?s 11)]]": lambda: [[c, s] for c in ("north", "west", "east") if (s := sum(column("berths", lambda p: p.get("coast") == c))) >= 11],
    '[:find ?c (as (count ?p) ?n) :where [?p :port/coast ?c] :having [(or [(= ?n 1)] [(= ?c "west")])]]': lambda: [["east", 1], ["west", 2]],
    '[:find ?c (as (count ?p) ?n) :where [?p :port/coast ?c] :having [(not [(= ?n 2)])]]': lambda: [["east", 1]],
    "[:find ?t ?d :where [?p :port/title ?t] [(get-else $ ?p :port/draft 1) ?d]]": lambda: [[p["title"], p.get("draft", 1.0)] for p in PORTS.values()],
    '[:find ?t ?d :where [?p :port/title ?t] [(get-else $ ?p :port/draft "shallow") ?d]]': lambda: [[p["title"], p.get("draft", "shallow")] for p in PORTS.values()],
    "[:find ?t ?twice ?half :where [?p :port/title ?t] [?p :port/berths ?b] [(* 2 ?b) ?twice] [(quot ?b 2) ?half] [(> ?half 2)]]": lambda: [[t, 2 * b, b // 2] for t, b in pick("title", "berths") if b // 2 > 2],
    "[:find ?t ?s :where [?p :port/title ?t] [?p :port/draft ?d] [(str ?t \" / \" ?d) ?s]]": lambda: [[t, f"{t} / {d:g}"] for t, d in pick("title", "draft")],
    '[:find ?t :where [?p :port/title ?t] [(re-matches? "[A-Z][a-z]+" ?t)]]': lambda: [[t] for t in column("title") if " " not in t],
    "[:find ?w ?n :where [(ground [[\"a\" 3] [\"b\" 5]]) [[?w ?n]]]]": lambda: [["a", 3], ["b", 5]],
    '[:find ?x ?kind :where (or-join [?x ?kind] (and [(ground ["ab" 7 true 2.5]) [?x ...]] [(string? ?x)] [(ground "text") ?kind]) (and [(ground ["ab" 7 true 2.5]) [?x ...]] [(number? ?x)] [(ground "number") ?kind]))]': lambda: [["ab", "text"], [7, "number"], [2.5, "number"]],
    "[:find ?b ?x :where [?p :port/berths ?b] [(vector ?b 5) [?x ...]] [(> ?x 5)]]": lambda: [[b, b] for b in BERTHS if b > 5],
    "[:find ?b ?y :where [?p :port/berths ?b] [(tuple ?b \"z\") [?y _]] [(odd? ?y)]]": lambda: [[b, b] for b in BERTHS if b % 2],
    "[:find ?t ?i :where [?p :port/title ?t ?tx] [?tx :db/txInstant ?i]]": lambda: [[t, CLOCK] for t in column("title")],
    # the wrong kind never equals, and kinds are ordered
    "[:find ?t :where [?p :port/title ?t] [(= ?t 12)]]": lambda: [],
    "[:find ?b :where [?p :port/berths ?b] [(< ?b \"many\")]]": lambda: [[b] for b in BERTHS],
    # all lines of such a port lead to ports that handle something
    '[:find ?t :where [?p :port/title ?t] [?p :port/lines _] (not-join [?p] [?p :port/lines ?o] (not [?o :port/goods _]))]': lambda: [[p["title"]] for p in PORTS.values() if p.get("lines") and all(PORTS[o].get("goods") for o in p["lines"])],
    "[:find ?t ?h :where [?p :port/title ?t] (or-join [?p ?h] (and [?p :port/hub ?k] [?k :port/title ?h]) (and (not [?p :port/hub _]) [(ground [nil]) [?h ...]]))]": lambda: [[p["title"], PORTS[p["hub"]]["title"] if "hub" in p else None] for p in PORTS.values()],
}
COLUMNS = {
    "[:find [?t ...] :where [?p :port/berths 4] [?p :port/title ?t]]": lambda: column("title", lambda p: p["berths"] == 4),
    "[:find [?t ...] :where [?p :port/title ?t] (not [?p :port/ice true])]": lambda: column("title", lambda p: not p.get("ice")),
    "[:find [?t ...] :where [?p :port/title ?t] (not-join [?p] [?c :crane/of ?p])]": lambda: column("title", lambda p: p not in [PORTS[c] for c, _ in CRANES]),
    "[:find [?t ...] :where [?p :port/title ?t] [(missing? $ ?p :port/coast)]]": lambda: column("title", lambda p: "coast" not in p),
    '[:find [?t ...] :where [?p :port/title ?t] (or [?p :port/coast "east"] [?p :port/berths 1])]': lambda: column("title", lambda p: p.get("coast") == "east" or p["berths"] == 1),
    '[:find [?t ...] :where [?p :port/title ?t] (or-join [?p] [?p :port/coast "east"] (and [?p :port/lines ?o] [?o :port/ice true]))]': lambda: column("title", lambda p: p.get("coast") == "east" or any(PORTS[o].get("ice") for o in p.get("lines", ()))),
    "[:find [?x ...] :where [(ground [4 8 15]) [?x ...]] [(even? ?x)]]": lambda: [4, 8],
    '[:find [?x ...] :where [(ground ["ore" "tin"]) [?x ...]] [_ :port/goods ?x]]': lambda: ["ore"],
    '[:find [?w ...] :where [?p :port/code "IST"] [?p :port/title ?t] [(split ?t " ") [?w ...]]]': lambda: ["Istra", "Quay"],
    '[:find [?w ...] :where [(ground "k1l22m") ?t] [(split ?t "([0-9])") [?w ...]]]': lambda: ["k", "1", "l", "2", "", "m"],
    "[:find [?n ...] :where [(ground \"p\U0001F6A2\") ?t] [(count ?t) ?n]]": lambda: [3],
    '[:find [?s ...] :where [(ground [1.0e21 4.5e-7 0.000125 12345678.5 1.5 3.0]) [?d ...]] [(str ?d) ?s]]': lambda: ["1e+21", "4.5e-7", "0.000125", "12345678.5", "1.5", "3"],
}
SCALARS = {
    '[:find ?b . :where [[:port/code "HAF"] :port/berths ?b]]': lambda: PORTS["HAF"]["berths"],
    "[:find (count ?p) . :where [?p :port/title]]": lambda: len(PORTS),
    "[:find (sum ?b) . :where [?p :port/berths ?b]]": lambda: sum(set(BERTHS)),
    "[:find (sum ?b) . :with ?p :where [?p :port/berths ?b]]": lambda: sum(BERTHS),
    "[:find (avg ?b) . :with ?p :where [?p :port/berths ?b]]": lambda: statistics.mean(BERTHS),
    "[:find (median ?b) . :with ?p :where [?p :port/berths ?b]]": lambda: statistics.median(BERTHS),
    "[:find (variance ?b) . :with ?p :where [?p :port/berths ?b]]": lambda: statistics.pvariance(BERTHS),
    "[:find (count-distinct ?d) . :with ?p :where [?p :port/draft ?d]]": lambda: len(set(column("draft"))),
    "[:find (distinct ?b) . :where [?p :port/berths ?b]]": lambda: sorted(set(BERTHS)),
    "[:find (max 2 ?b) . :with ?p :where [?p :port/berths ?b]]": lambda: sorted(set(BERTHS))[:-3:-1],
    "[:find (min 3 ?b) . :with ?p :where [?p :port/berths ?b]]": lambda: sorted(set(BERTHS))[:3],
    '[:find [?t ?b] :where [?p :port/code "LOM"] [?p :port/title ?t] [?p :port/berths ?b]]': lambda: ["Lomond", 1],
    '[:find ?s . :where [?p :port/code "LOM"] [?p :port/since ?i] [(str ?i) ?s]]': lambda: "1990-11-30T12:30:00.000Z",
    "[:find (rand 0 ?b) . :where [?p :port/berths ?b]]": lambda: [],
}


@pytest.mark.parametrize("text", RELATIONS)
def test_relations(coast, text):
    got = q(coast[0].db(), text)
    want = RELATIONS[text]()
    assert as_set(got) == as_set(want) and len(got) == len(as_set(want))


@pytest.mark.parametrize("text", COLUMNS)
def test_columns(coast, text):
    got = q(coast[0].db(), text)
    assert as_set(got) == as_set(COLUMNS[text]()) and len(got) == len(set(got))


@pytest.mark.parametrize("text", SCALARS)
def test_scalars(coast, text):
    got, want = q(coast[0].db(), text), SCALARS[text]()
    assert got == (pytest.approx(want) if isinstance(want, float) else want)


def test_draws(coast):
    db = coast[0].db()
    draws = q(db, "[:find (rand 400 ?b) . :with ?p :where [?p :port/berths ?b]]")
    assert len(draws) == 400 and set(draws) <= set(BERTHS)
    assert draws.count(7) + draws.count(4) > 180  # four of the six ports: values of more ports are drawn more often
    some = q(db, "[:find (sample 3 ?b) . :where [?p :port/berths ?b]]")
    assert len(set(some)) == 3 and set(some) <= set(BERTHS)


def test_inputs(coast):
    conn, ids = coast
    db = conn.db()
    by = {"find": ["?t"], "in": ["$", "?least"], "where": [["?p", ":port/berths", "?b"], [[">=", "?b", "?least"]], ["?p", ":port/title", "?t"]]}
    assert as_set(q(db, by, 7)) == as_set(pick("title", when=lambda p: p["berths"] >= 7))
    assert as_set(q(db, "[:find ?t :in $ ?h :where [?p :port/hub ?h] [?p :port/title ?t]]", ids["QUN"])) == as_set([["Istra Quay"]])
    assert as_set(q(db, "[:find [?t ...] :in $ [?b ...] :where [?p :port/berths ?b] [?p :port/title ?t]]", [1, 12])) == as_set(["Velmark", "Lomond"])
    assert as_set(q(db, "[:find ?c ?w :in $ [[?c ?w]] :where [?p :port/code ?c]]", [["TOR", "x"], ["NIL", "y"], ["HAF", "z"]])) == as_set([["TOR", "x"], ["HAF", "z"]])
    assert q(db, "[:find ?p . :in $ [?t ?b] :where [?p :port/title ?t] [?p :port/berths ?b]]", ["Torvik", 4]) == ids["TOR"]
    found = q(db, "[:find [?a ...] :in $ ?p :where [?p ?a _]]", ids["LOM"])
    assert {db.schema.by_id[a].ident.removeprefix("port/") for a in found} == {"code", *PORTS["LOM"]}
    # values of several kinds in one input
    assert as_set(q(db, "[:find ?x ?t :in $ [?x ...] :where [?p :port/title ?t] (or-join [?p ?x] [?p :port/berths ?x] [?p :port/coast ?x])]", [1, "east", True])) == as_set([[1, "Lomond"], ["east", "Hafnest"]])


def test_user_functions(coast):
    db = coast[0].db()
    from pyspark.sql import functions as F

    mine = {"turned": (lambda s: s[::-1], "string"), "tripled": lambda c: c * 3, "shout": lambda c: F.upper(c), "parts": (lambda s: s.split(" "), "array<string>")}
    assert q(db, '[:find [?t ...] :where [?p :port/title ?t] [(turned ?t) ?u] [(= ?u "kivroT")]]', functions=mine) == ["Torvik"]
    assert q(db, '[:find ?n . :where [?p :port/code "QUN"] [?p :port/berths ?b] [(tripled ?b) ?n]]', functions=mine) == 21
    assert q(db, '[:find ?u . :where [?p :port/code "QUN"] [?p :port/title ?t] [(shout ?t) ?u]]', functions=mine) == "QUENNBY"
    assert as_set(q(db, '[:find [?w ...] :where [?p :port/code "IST"] [?p :port/title ?t] [(parts ?t) [?w ...]]]', functions=mine)) == as_set(["Istra", "Quay"])


def test_rules_and_recursion(coast):
    db = coast[0].db()
    rules = '[[(deep ?p) [?p :port/draft ?d] [(> ?d 9)]] [(deep ?p) [?p :port/code "QUN"]] [(under ?x ?y) [?x :port/hub ?y]] [(under ?x ?y) [?x :port/hub ?z] (under ?z ?y)]]'
    ask = lambda find, where: q(db, f"[:find {find} :rules {rules} :where {where}]")
    assert as_set(ask("[?c ...]", "(deep ?p) [?p :port/code ?c]")) == as_set(["VEL", "TOR", "HAF", "QUN"])
    above = {c: [] for c in PORTS}
    for c in PORTS:
        h = PORTS[c].get("hub")
        while h:
            above[c].append(h)
            h = PORTS[h].get("hub")
    assert as_set(ask("?a ?b", "(under ?x ?y) [?x :port/code ?a] [?y :port/code ?b]")) == as_set([[a, b] for a in PORTS for b in above[a]])
    assert as_set(ask("[?a ...]", '[?y :port/code "VEL"] (under ?x ?y) [?x :port/code ?a] (not (deep ?x))')) == as_set(["IST", "LOM"])
    # lines run in circles; set semantics end the recursion
    reach = "[[(sails ?x ?y) [?x :port/lines ?y]] [(sails ?x ?y) (sails ?x ?z) [?z :port/lines ?y]]]"
    to = {c: set(PORTS[c].get("lines", ())) for c in PORTS}
    for _ in PORTS:
        to = {c: s | {y for x in s for y in to[x]} for c, s in to.items()}
    got = q(db, f"[:find ?a ?b :rules {reach} :where (sails ?x ?y) [?x :port/code ?a] [?y :port/code ?b]]")
    assert as_set(got) == as_set([[a, b] for a, s in to.items() for b in s])
    with pytest.raises(BudgetError):
        q(db, f"[:find ?x ?y :rules {reach} :where (sails ?x ?y)]", budget=8)


def test_order_and_paging(coast):
    db = coast[0].db()
    base = "[:find ?t ?d :where [?p :port/title ?t] (or-join [?p ?d] [?p :port/draft ?d] (and (not [?p :port/draft _]) [(ground [nil]) [?d ...]]))"
    got = lambda more: [r[0] for r in q(db, f"{base} {more}]")]
    known = sorted(pick("draft", "title"))
    up = [t for _, t in known]
    assert got(":order [[?d :asc] ?t]") == [*up, "Quennby"]
    assert got(":order [[?d :desc] [?t :desc]]") == [*up[::-1], "Quennby"]
    assert got(":order [[?d :asc :first] ?t]") == ["Quennby", *up]
    assert got(":order [[?d :asc] ?t] :offset 2 :limit 3") == [*up, "Quennby"][2:5]
    assert got(':order [[?d :asc] ?t] :after [9.5 "Hafnest"]') == ["Torvik", "Velmark", "Quennby"]
    assert got(':order [[?d :asc] ?t] :after [nil "Quennby"]') == []
    assert got(":order [?t] :limit 0") == []
    # values of all kinds in one column: numbers, texts, truth values, times, nothing
    mixed = '[:find [?x ...] :where [(ground [nil #inst "2001-01-01T00:00:00Z" true "b" false 3 "a" -1.5]) [?x ...]] :order [[?x %s]]]'
    moment = edn.Instant.of("2001-01-01T00:00:00Z")
    assert q(db, mixed % ":asc") == [-1.5, 3, "a", "b", False, True, moment, None]
    assert q(db, mixed % ":desc") == [moment, True, False, "b", "a", 3, -1.5, None]


def test_history_and_views(spark):
    conn = Connection(spark, now=lambda: 5)
    conn.transact(SCHEMA[:4])
    e = conn.transact([{":db/id": "n", ":port/title": "Nord", ":port/berths": 3}]).tempids["n"]
    before = conn.t
    conn.transact([[":db/add", e, ":port/berths", 8]])
    conn.transact([[":db/retract", e, ":port/berths", 8]])
    told = "[:find ?b ?op :in $ ?p :where [?p :port/berths ?b _ ?op]]"
    assert as_set(q(conn.db().history(), told, e)) == as_set([[3, True], [3, False], [8, True], [8, False]])
    now = "[:find ?b . :in $ ?p :where [?p :port/berths ?b]]"
    assert [q(conn.db().as_of(t), now, e) for t in (before, before + 1, before + 2)] == [3, 8, None]
    assert conn.db().entity(e) == {"port/title": "Nord", "db/id": e} and conn.db().exists(e) and conn.db().basis == conn.t
    both = {"$": conn.db().as_of(before + 1), "$old": conn.db().as_of(before)}
    assert q(both, "[:find ?a ?b :in $ $old :where [?p :port/berths ?a] [$old ?p :port/berths ?b] [(> ?a ?b)]]") == [[8, 3]]


def test_errors(coast):
    db = coast[0].db()
    for bad in ("[:find ?z :where [?p :port/title ?t]]", "[:find ?p :where [?p :port/colour ?c]]", "[:find ?p :where [(< ?p 3)]]", "[:find ?t :where [?p :port/title ?t] (or [?p :port/berths 4] [?p :port/hub ?h])]", "[:find ?t :where [?p :port/title ?t] :having [(= ?t 1)]]", "[:find ?t :whither [1]]", "[:find ?t :where (sunk ?t)]", "[:find ?x :where [?p :port/berths ?b] [(inc ?b) [?x ...]]]"):
        with pytest.raises(QueryError):
            q(db, bad)
    product = "[:find ?a ?b :where [?x :port/title ?a] [?y :port/goods ?b]]"
    with pytest.raises(BudgetError):
        q(db, product, budget=20)
    assert len(q(db, product)) == len(PORTS) * len({g for p in PORTS.values() for g in p.get("goods", ())})
    from factweave.plans import compiler

    assert compiler.BUDGET < 10**7  # products are guarded without being asked
    told = run_query(db, "[:find ?t ?h :where [?p :port/title ?t] [?p :port/hub ?k] [?k :port/title ?h]]").explain()
    assert {"star", "inner-join"} <= {s["strategy"] for s in told["steps"]} and "Physical Plan" in told["plan"]
    assert parse_query(parse_query("[:find ?t :where [?p :port/title ?t]]")).find


def test_ground_values_are_compared_not_multiplied(coast):
    """Lists that other clauses bind, and literals of one row, are no products; others are, and stay guarded."""
    db = coast[0].db()
    ask = lambda clauses, more="", budget=1: q(db, f"[:find [?t ...] {more} :where [?p :port/title ?t] {clauses}]", budget=budget)
    codes = ["VEL", "LOM"]
    told = [p["title"] for c, p in PORTS.items() if c in codes]
    listed = '[(ground ["VEL" "LOM" "nowhere"]) [?c ...]]'
    assert as_set(ask(f"(or-join [?p] [?p :port/berths -1] (and {listed} [?p :port/code ?c]))")) == as_set(told)
    assert as_set(ask(f"{listed} (or [?p :port/code ?c] [?p :port/title ?c])")) == as_set(told)
    assert as_set(ask(f"{listed} (called ?p ?c)", ":rules [[(called ?x ?n) [?x :port/code ?n]]]")) == as_set(told)
    both = [p["title"] for c, p in PORTS.items() if c in codes and p.get("berths") in (4, 5, 12)]
    assert as_set(ask(f"{listed} [(ground [4 5 12]) [?b ...]] [?p :port/code ?c] [?p :port/berths ?b]")) == as_set(both)
    pairs = [p["title"] for c, p in PORTS.items() if (c, p.get("berths")) in {(x, y) for x in PORTS for y in (4, 5, 12)}]
    assert as_set(ask(f"[(ground [{' '.join(f'[{chr(34)}{c}{chr(34)} {b}]' for c in PORTS for b in (4, 5, 12))}]) [[?c ?b]]] [?p :port/code ?c] [?p :port/berths ?b]")) == as_set(pairs)
    for one in ("[5]", "[nil]", "[5 5]"):
        assert len(ask(f"[(ground {one}) [?x ...]]")) == len(PORTS)
    # a rule that takes the values from outside has them first
    below = ":rules [[(below ?x ?n) [?x :port/berths ?m] [(< ?m ?n)]]]"
    assert as_set(ask("[(ground [4 5]) [?n ...]] (below ?p ?n)", below, None)) == as_set([t for t, b in pick("title", "berths") if b < 5])
    with pytest.raises(BudgetError):
        ask("[(ground [4 5]) [?n ...]]")


def test_builder_lists_under_the_budget(coast, monkeypatch):
    from factweave import builder

    monkeypatch.setattr(builder, "run_query", lambda db, text: run_query(db, text, budget=1))
    either = builder.entities("port").either(lambda p: p.where("berths", "=", -1), lambda p: p.where("code", "in", ["VEL", "LOM"])).select("title")
    assert as_set(r["title"] for r in either.run(coast[0].db())) == as_set([PORTS["VEL"]["title"], PORTS["LOM"]["title"]])


def test_products_of_keyed_rows(spark):
    """Keys stand for their rows, so pairs of keys aren't made distinct, and tasks share the pairs; other values are."""
    rows = [(k, k * 5 % 7, "ab"[k % 2]) for k in range(40)]
    db = Tables(spark, {"part": spark.createDataFrame(rows, "key long, size long, brand string").coalesce(1)}, {"part": "key"})
    ask = lambda find, where, **more: run_query(db, f"[:find {find} :where {where}]", **more)
    pairs = "[?x :part/size ?s] [?x :part/key ?a] [?y :part/size ?z] [?y :part/key ?b] [(< ?s ?z)]"
    found = ask("?a ?b", pairs, budget=None)
    plan = found.explain()["plan"]
    assert "Aggregate" not in plan and "Broadcast" not in plan
    assert found.df.select(F.spark_partition_id()).distinct().count() > 1
    assert sorted(found.rows()) == sorted([a, b] for a, s, _ in rows for b, z, _ in rows if s < z)
    assert sorted(ask("?a ?z", pairs, budget=None).rows()) == sorted([a, z] for a, s, _ in rows for z in range(7) if s < z)
    assert sorted(ask("?s ?z", pairs).rows()) == [[s, z] for s in range(7) for z in range(s + 1, 7)]
    assert ask("?a (as (count ?z) ?n)", pairs + " [(= ?a 1)]").rows() == [[1, 1]]
    # an empty key tells no row
    path = '[?x :part/brand "a"] [?x :part/key ?k]'
    optional = f"[?x :part/size ?s] (or-join [?x ?k] (and {path}) (and (not {path}) [(ground [nil]) [?k ...]]))"
    assert as_set(ask("?k", optional).rows()) == as_set([[k] for k in [*range(0, 40, 2), None]]) and len(ask("?k", optional).rows()) == 21
    # a clause of constants restricts, whatever the budget
    assert len(ask("?a", "[?x :part/key ?a] [[:part/key 3] :part/size 1]", budget=1).rows()) == 40


def test_random_queries_against_nested_loops(spark):
    """Joins, not, or, comparisons over random facts: the compiler and the naive evaluator agree."""
    rng = random.Random(77)
    conn = Connection(spark, now=lambda: 1)
    conn.transact([attribute("n/kind", "string"), attribute("n/size", "long"), attribute("n/next", "ref", cardinality="many"), attribute("n/mark", "string", cardinality="many")])
    ops = []
    for k in range(24):
        node = {":db/id": f"t{k}", ":n/size": rng.randrange(5)}
        if rng.random() < 0.8:
            node[":n/kind"] = rng.choice("uvw")
        node[":n/next"] = [f"t{rng.randrange(24)}" for _ in range(rng.randrange(3))]
        node[":n/mark"] = rng.sample(["red", "wet", "old"], rng.randrange(3))
        ops.append(node)
    conn.transact(ops)
    log = conn.log().cache()
    db = Connection(spark, now=lambda: 1, log=log).db()
    names = {a.id: a.ident for a in db.schema.attributes.values()}
    facts = [(r["e"], names[r["a"]], r["v_str"] if r["v_str"] is not None else r["v_long"]) for r in log.collect() if names.get(r["a"], "").startswith("n/")]

    def pattern(have):
        e = rng.choice([*have, "?fresh"])
        attr = rng.choice(["kind", "size", "next", "mark"])
        v = {"kind": '"%s"' % rng.choice("uvw"), "size": str(rng.randrange(5)), "mark": '"%s"' % rng.choice(["red", "wet"]), "next": "_"}[attr] if rng.random() < 0.4 else "?y%d" % rng.randrange(100) if attr != "next" else "?e%d" % rng.randrange(3)
        return f"[{e} :n/{attr} {v}]"

    for k in range(40):
        clauses = [f"[?e0 :n/{rng.choice(['kind', 'size', 'next'])} _]"]
        clauses += [pattern(["?e0"]).replace("?fresh", "?e0") for _ in range(rng.randrange(1, 3))]
        if rng.random() < 0.5:
            clauses.append("[?e0 :n/next ?e1]")
            clauses.append(pattern(["?e1"]).replace("?fresh", "?e1"))
        if rng.random() < 0.4:
            clauses.append(f"(not-join [?e0] [?e0 :n/next ?z] [?z :n/size {rng.randrange(5)}])")
        if rng.random() < 0.4:
            clauses.append(f'(or-join [?e0] [?e0 :n/mark "old"] (and [?e0 :n/size ?s] [(< ?s {rng.randrange(5)})]))')
        if rng.random() < 0.4:
            clauses.append("[?e0 :n/size ?sa] [?eb :n/size ?sa] [?eb :n/kind ?kb] [(!= ?eb ?e0)]")
        find = "?e0 ?kb" if "?kb" in clauses[-1] else "?e0"
        text = f"[:find {find} :where {' '.join(clauses)}]"
        assert {tuple(r) for r in q(db, text)} == naive.answers(parse_query(text), facts), text


def test_transactions(spark):
    conn = Connection(spark, now=lambda: 7)
    conn.transact(SCHEMA)
    a = conn.transact([{":db/id": "x", ":port/code": "XAN", ":port/title": "Xanth", ":port/lines": [{":db/id": "y", ":port/code": "YUL"}]}]).tempids
    # an identity that is known takes the new facts
    again = conn.transact([{":db/id": "other", ":port/code": "XAN", ":port/title": "New Xanth", ":port/berths": 2}])
    assert again.tempids["other"] == a["x"] and conn.db().entity(a["x"])["port/title"] == "New Xanth"
    assert len(conn.transact([[":db/add", a["x"], ":port/berths", 2]]).datoms) == 1  # nothing new but its instant
    with pytest.raises(TxError) as bad:
        conn.transact([[":db/add", a["y"], ":port/code", "XAN"]])
    assert bad.value.code == "unique-conflict"
    # a code that is given up may be taken in the same transaction
    conn.transact([[":db/retract", a["x"], ":port/code", "XAN"], [":db/add", a["y"], ":port/code", "XAN"]])
    assert conn.db().entid([":port/code", "XAN"]) == a["y"]
    for wrong in ([[":db/add", "t", ":port/berths", 2.5]], [[":db/add", "t", ":port/title", None]], [[":db/add", "t", ":port/none", 1]], [["sink"]], [[":db/add", [":port/code", "???"], ":port/berths", 1]]):
        with pytest.raises(TxError):
            conn.transact(wrong)
    view, _ = conn.with_ops([[":db/add", a["x"], ":port/berths", 30]])
    assert view.entity(a["x"])["port/berths"] == 30 and conn.db().entity(a["x"])["port/berths"] == 2
    conn.transact([[":db/retractEntity", a["y"]]])
    assert conn.db().entity(a["y"]) == {} and "port/lines" not in conn.db().entity(a["x"])
    t = conn.t
    with pytest.raises(TxError):
        conn.transact_many([[[":db/add", a["x"], ":port/berths", 4]], [["sink"]]])
    assert conn.t == t and conn.db().entity(a["x"])["port/berths"] == 2
    assert conn.transact([[":db/add", a["x"], ":port/berths", 5]], "once").t == conn.transact([[":db/add", a["x"], ":port/berths", 6]], "once").t


def test_edn():
    assert edn.read('{:depth [3 4] :name "q"}') == {":depth": [3, 4], ":name": edn.Const("q")}
    assert edn.read("[#_ 9 8 ; rest of the line\n 0.25 nil false \\z #{6}]") == [8, 0.25, None, False, edn.Const("z"), {6}]
    every = [7, "Two words", 2.5, None, False, edn.Instant(90_000), edn.Uuid("0a" * 4 + "-1111-2222-3333-" + "4" * 12), b"\x02\xff", {3, 4}, [["nested"], {":k": -1}]]
    back = edn.read(edn.write(every))
    assert back == every
    for value in (edn.Instant(66), edn.Uuid("f" * 8 + "-0000-0000-0000-" + "e" * 12), b"ab", {"k": [1, None]}):
        assert edn.from_json(edn.to_json(value)) == value
    for bad in ("[7", "7 8", "{:odd}", "]"):
        with pytest.raises(edn.EdnError):
            edn.read(bad)
