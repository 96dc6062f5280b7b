import time

import pytest

from factweave.builder import NotOne, Param, ParamError, entities, rule
from factweave.operators.pull import pull, pull_many
from factweave.plans.compiler import run_query
from factweave.policy import Policy, Principal, Rule
from factweave.plans.query import QueryError
from factweave.shapes import again, everything, field, identity, shape
from factweave.streaming.frames import follow, frames, unwired, wire
from factweave.streaming.live import Live, Replica, changes
from factweave.transactions import Connection, StaleError, Store, TxError
from tests import harbour
from tests.harbour import CLOCK, PORTS, SCHEMA, attribute


@pytest.fixture(scope="module")
def coast(spark):
    conn = Connection(spark, now=lambda: CLOCK)
    conn.transact(SCHEMA)
    ids = conn.transact(harbour.entities()).tempids
    return Connection(spark, now=lambda: CLOCK, log=conn.log().cache()), ids


def test_pull(coast):
    conn, ids = coast
    db = conn.db()
    assert pull(db, ids["TOR"], "[:port/title {:port/hub [:port/title :port/berths]} :port/unknown]") == {"port/title": "Torvik", "port/hub": {"port/title": "Velmark", "port/berths": 12}}
    assert pull(db, [":port/code", "VEL"], "[(default :port/berths 0) {:port/_hub [:port/code]}]") == {"port/berths": 12, "port/_hub": [{"port/code": "TOR"}, {"port/code": "QUN"}]}
    assert pull(db, ids["QUN"], ["db/id", [":port/draft", ":as", "metres", ":default", -2.0]]) == {"db/id": ids["QUN"], "metres": -2.0}
    assert pull(db, ids["LOM"], "[:port/code (default :port/none 5)]") == {"port/code": "LOM", "port/none": 5}
    shallow = pull(db, ids["IST"], '[{[:port/lines :where [["lt" :port/berths 9]]] [:port/code]}]')
    assert shallow == {"port/lines": [{"port/code": "QUN"}, {"port/code": "LOM"}]}
    by_berths = pull(db, ids["IST"], "[{[:port/lines :order [[:port/berths :desc]] :limit 2] [:port/code]}]")
    assert by_berths == {"port/lines": [{"port/code": "VEL"}, {"port/code": "QUN"}]}
    assert pull(db, ids["VEL"], "[(limit :port/goods 2)]") == {"port/goods": ["grain", "ore"]}
    # a target without anything of the pattern is its id
    assert pull(db, ids["TOR"], "[{:port/hub [:crane/tons]}]") == {"port/hub": {"db/id": ids["VEL"]}}
    assert pull_many(db, [1 << 30, ids["HAF"]], "[:port/title]") == [None, {"port/title": "Hafnest"}]
    rows = run_query(db, "[:find ?c (pull ?p [:port/berths]) :where [?p :port/code ?c] :order [[?c :desc]] :limit 2]").rows()
    assert rows == [["VEL", {"port/berths": 12}], ["TOR", {"port/berths": 4}]]


def test_pull_wildcard(coast):
    conn, ids = coast
    got = pull(conn.db(), ids["TOR"], "[*]")
    assert got == {"db/id": ids["TOR"], "port/code": "TOR", "port/title": "Torvik", "port/berths": 4, "port/draft": 9.5, "port/ice": True, "port/coast": "north", "port/goods": ["fish"], "port/hub": {"db/id": ids["VEL"]}, "port/lines": [{"db/id": ids["VEL"]}]}
    nested = pull(conn.db(), ids["QUN"], "[{:port/lines [*]}]")
    assert [x["port/title"] for x in nested["port/lines"]] == ["Istra Quay"] and nested["port/lines"][0]["db/id"] == ids["IST"]


def expected(code, path, depth):
    """The recursive tree of lines in plain Python."""
    out = {"port/code": code}
    kids = [{"db/id": c} if c in path or depth == 0 else expected(c, path | {c}, None if depth is None else depth - 1) for c in PORTS[code].get("lines", ())]
    return out | ({"port/lines": kids} if kids else {})


@pytest.mark.parametrize("depth", [1, 2, None])
def test_pull_recursion_ends_on_cycles(coast, depth):
    conn, ids = coast

    def named(t):
        out = {k: v for k, v in t.items() if k != "port/lines"}
        if "db/id" in out:
            out["db/id"] = next(c for c, i in ids.items() if i == out["db/id"])
        return out | ({"port/lines": sorted((named(x) for x in t["port/lines"]), key=repr)} if "port/lines" in t else {})

    began = time.time()
    got = pull_many(conn.db(), [ids["VEL"], ids["IST"], ids["HAF"]], [":port/code", {":port/lines": "..." if depth is None else depth}])
    assert time.time() - began < 60
    want = [expected(c, {c}, depth) for c in ("VEL", "IST", "HAF")]
    assert [named(t) for t in got] == [named_want(t) for t in want]
    up = pull(conn.db(), ids["LOM"], "[:port/code {:port/hub ...}]")
    assert up == {"port/code": "LOM", "port/hub": {"port/code": "IST", "port/hub": {"port/code": "QUN", "port/hub": {"port/code": "VEL"}}}}


def named_want(t):
    return {k: v for k, v in t.items() if k != "port/lines"} | ({"port/lines": sorted((named_want(x) for x in t["port/lines"]), key=repr)} if "port/lines" in t else {})


def test_policy(coast):
    conn, ids = coast
    db = conn.db()
    policy = Policy([Rule("allow", "read", "port", ("or", ("class", "pilot"), ("eq", "port/hub", ("principal", "id")))), Rule("deny", "read", "port/draft"), Rule("allow", "add", "port/berths", ("eq", "port/hub", ("principal", "id")))])
    codes = lambda view: sorted(run_query(view, "[:find [?c ...] :where [?p :port/code ?c]]").value())
    master = Principal(id=ids["VEL"])
    assert codes(policy.readable(db, master)) == ["QUN", "TOR"]
    assert codes(policy.readable(db, Principal())) == []
    pilot = policy.readable(db, Principal(classes=frozenset({"pilot"})))
    assert codes(pilot) == sorted(PORTS) and run_query(pilot, "[:find ?d :where [_ :port/draft ?d]]").value() == []
    assert run_query(pilot, "[:find ?t :where [_ :crane/tons ?t]]").value() == []
    assert codes(policy.readable(db, Principal(admin=True))) == sorted(PORTS)
    berths = db.schema.attr("port/berths").id
    policy.check(db, master, [(ids["TOR"], berths, 1, True)])
    with pytest.raises(TxError):
        policy.check(db, master, [(ids["IST"], berths, 1, True)])


def test_builder(coast):
    conn, ids = coast
    db = conn.db()
    assert entities("port").where("berths", ">", 6).select("code").order_by("code").run(db) == [{"code": c} for c in ("HAF", "QUN", "VEL")]
    assert entities("port").where("code", "=", "IST").follow("hub").select("title").one(db) == {"title": "Quennby"}
    assert entities("port").where("code", "=", "VEL").backlink("hub").select(leaf="code").order_by("leaf").run(db) == [{"leaf": "QUN"}, {"leaf": "TOR"}]
    assert entities("port").has("title").none("hub").select("code").order_by("code").run(db) == [{"code": c} for c in ("HAF", "LOM", "TOR")]
    assert entities("port").has("title").some("hub", lambda p: p.where("ice", "=", True)).select("code").run(db) == [{"code": "VEL"}]
    assert entities("port").some("hub").every("hub", lambda p: p.has("goods")).select("code").run(db) == [{"code": "VEL"}]
    assert entities("port").has("berths").aggregate("all", "sum", "berths").run(db) == [{"all": 35}]
    assert entities("port").where("berths", "in", [1, 12]).select("code").order_by("code").run(db) == [{"code": "LOM"}, {"code": "VEL"}]
    assert entities("port").either(lambda p: p.where("coast", "=", "east"), lambda p: p.where("berths", "<", 2)).select("code").order_by("code").run(db) == [{"code": "HAF"}, {"code": "LOM"}]
    by = entities("port").where("berths", ">=", Param("least")).select("code")
    assert by.order_by("code").run(db, least=12) == [{"code": "VEL"}]
    with pytest.raises(ParamError):
        by.run(db)
    with pytest.raises(NotOne):
        entities("port").has("title").select("title").one_or_fail(db)
    first, cursor = entities("port").has("title").select("title").order_by("title").page(db, 4)
    rest, end = entities("port").has("title").select("title").order_by("title").page(db, 4, cursor)
    assert [r["title"] for r in first + rest] == sorted(p["title"] for p in PORTS.values()) and end is None


def test_builder_composes_queries(coast):
    conn, ids = coast
    db = conn.db()
    deep = entities("port").where("draft", ">", Param("over", kind="double")).select("code")
    assert entities("port").open(deep, over=9).follow("hub").select("code").run(db) == [{"code": "VEL"}]
    assert deep.refine(lambda p: p.where("ice", "=", True)).order_by("code").run(db, over=9.0) == [{"code": "HAF"}, {"code": "TOR"}]
    assert deep.order_by("code").limit(1).logic().enrich(b="berths").order_by("b").run(db, over=9.0) == [{"code": "TOR", "b": 4}, {"code": "HAF", "b": 7}, {"code": "VEL", "b": 12}]
    for wrong in (lambda: entities("port").open(deep.limit(2), over=1), lambda: deep.limit(1).refine(lambda p: p), lambda: deep.order_by("code").enrich("title"), lambda: deep.when(Param("x"), lambda p: p.follow("hub"))):
        with pytest.raises(QueryError):
            wrong()
    with pytest.raises(ParamError):
        deep.run(db, over="deep")
    with pytest.raises(ParamError):
        entities("port").open(deep)
    lined = entities("port").where("ice", "=", True).mark("from").follow("hub").rows(at="code", start={"code": "from.code", "size": {"berths": "from.berths"}})
    assert lined.run(db) == [{"at": "VEL", "start": {"code": "TOR", "size": {"berths": 4}}}]
    gated = entities("port").has("title").when(Param("coast"), lambda p: p.where("coast", "=", Param("coast"))).select("code").order_by("code")
    assert [r["code"] for r in gated.run(db)] == sorted(PORTS) and [r["code"] for r in gated.run(db, coast="west")] == ["IST", "QUN"]
    above = rule("above", "port", lambda p: p.follow("hub"), lambda p: p.follow("hub").call(above))
    assert entities("port").where("code", "=", "LOM").call(above).select("code").order_by("code").run(db) == [{"code": c} for c in ("IST", "QUN", "VEL")]
    cold = rule("cold", "port", lambda p: p.where("ice", "=", True), lambda p: p.where("coast", "=", "north"))
    assert entities("port").has("code").call(cold).select("code").order_by("code").run(db) == [{"code": c} for c in ("HAF", "TOR", "VEL")]


def test_shapes(coast):
    conn, ids = coast
    db = conn.db()
    want = shape(id=identity(), title=field("port/title"), draft=field("port/draft"), hub=field("port/hub").select(code=field("port/code")), goods=field("port/goods").all(), coast=field("port/coast").or_default("?"), since=field("port/since").optional())
    got = entities("port").has("code").shaped(want).run(db)
    assert sorted(r["title"] for r in got) == ["Istra Quay", "Lomond", "Torvik"]  # those with a draft and a hub
    by = {r["title"]: r for r in got}
    assert by["Lomond"] == {"id": ids["LOM"], "title": "Lomond", "draft": 3.75, "hub": {"code": "IST"}, "goods": [], "coast": "?", "since": 659968200000}
    assert by["Torvik"]["goods"] == ["fish"] and "since" not in by["Torvik"]
    leaves = shape(code=field("port/code"), leaves=field("port/_hub").select(code=field("port/code")), cranes=field("crane/_of").select(everything()))
    vel = entities("port").where("code", "=", "VEL").shaped(leaves).run(db)
    assert vel[0]["leaves"] == [{"code": "TOR"}, {"code": "QUN"}] and sorted(c["crane/tons"] for c in vel[0]["cranes"]) == [40, 90]
    up = shape(code=field("port/code"), hub=field("port/hub").optional().select(again(2)))
    assert entities("port").where("code", "=", "LOM").shaped(up).run(db) == [{"code": "LOM", "hub": {"code": "IST", "hub": {"code": "QUN", "hub": {"db/id": ids["VEL"]}}}}]
    with pytest.raises(QueryError):
        again(17)


def _buoys(spark, path):
    conn = Connection(spark, now=lambda: 3, path=path)
    conn.transact([attribute("buoy/name", "string", unique="identity"), attribute("buoy/depth", "long"), attribute("buoy/seal", "bytes")])
    return conn, conn.transact([{":db/id": "b", ":buoy/name": "B7", ":buoy/depth": 40, ":buoy/seal": b"\x00\xff"}]).tempids["b"]


def test_store_survives_failures(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "db")
    conn, b = _buoys(spark, path)
    store = Store(spark, path)
    # a failed write leaves neither facts nor state, and the number is free again
    t, before = conn.t, conn.log().count()
    with monkeypatch.context() as m:
        m.setattr(spark.__class__, "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(OSError("disk")))
        with pytest.raises(OSError):
            conn.transact([[":db/add", b, ":buoy/depth", 1]])
        with pytest.raises(OSError):
            conn.transact_many([[[":db/add", b, ":buoy/depth", 1]]])
    assert (conn.t, conn.log().count()) == (t, before)
    conn.transact([[":db/add", b, ":buoy/depth", 41]])
    # a second writer with an old view of the store is refused, and what is there stays
    other = Store(spark, path).connect()
    conn.transact([[":db/add", b, ":buoy/depth", 42]])
    with pytest.raises(TxError) as late:
        other.transact([[":db/add", b, ":buoy/depth", 99]])
    assert late.value.code == "conflict" and store.connect().db().entity(b)["buoy/depth"] == 42
    # a snapshot without its manifest doesn't count
    with monkeypatch.context() as m:
        m.setattr(Store, "_create", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.compact()
    assert store.current() == 0 and store.connect().db().entity(b)["buoy/depth"] == 42
    first = store.compact()
    conn = store.connect()
    conn.transact([[":db/add", b, ":buoy/depth", 43]])
    second = store.compact()
    # only what the log touched was written again; the old root still reads as it was
    assert set(store.manifest(second).values()) == {first, second} and store.at_root(first).entity(b)["buoy/depth"] == 42
    assert store.retain(1) == [second] and store.connect().db().entity(b) == {"buoy/name": "B7", "buoy/depth": 43, "buoy/seal": b"\x00\xff", "db/id": b}
    with pytest.raises(StaleError):
        store.connect(second + 1)
    # a claim of a writer that died
    (tmp_path / "db" / "claims" / f"{second + 1:012d}").touch()
    with pytest.raises(TxError):
        store.connect().transact([[":db/add", b, ":buoy/depth", 44]])
    assert store.recover() == [second + 1]
    assert store.connect().transact([[":db/add", b, ":buoy/depth", 44]], "mine").t == second + 1
    again = store.connect().transact([[":db/add", b, ":buoy/depth", 45]], "mine")
    assert again.t == second + 1 and any(r[3] == 44 for r in again.datoms) and store.connect().db().entity(b)["buoy/depth"] == 44


def test_replica_and_frames(spark, tmp_path):
    conn, b = _buoys(spark, str(tmp_path / "db"))
    store = Store(spark, conn.path)
    replica, start = Replica(store), conn.t
    reports = [conn.transact([[":db/add", b, ":buoy/depth", 50 + k]]) for k in range(3)]
    assert replica.offer(reports[2].t, reports[2].datoms) == "filled" and replica.offer(reports[0].t, reports[0].datoms) == "duplicate"
    assert replica.db().entity(b)["buoy/depth"] == 52
    assert Replica(store).offer(conn.t + 5, []) == "early"
    for r in store.log().collect():
        assert unwired(wire(tuple(r))) == tuple(r)
    late = Replica(store)
    late.t, late._base = start, store.tail(0).where(f"t <= {start}")
    assert follow(late, frames(store, start)) == ["hello", "applied", "applied", "applied"]
    assert late.db(conn.t).entity(b) == replica.db().entity(b)
    with pytest.raises(ValueError):
        follow(late, ['{"v": 2, "kind": "tx"}'])


def test_live_tries_again_and_ends(spark, tmp_path, monkeypatch):
    conn, b = _buoys(spark, str(tmp_path / "db"))
    store, seen, failed = Store(spark, conn.path), [], []
    live = Live(store, "[:find ?d . :where [_ :buoy/depth ?d]]", emit=lambda v, t: seen.append(v))
    plain = Store.connect

    def shaky(self, min_t=0):
        if len(failed) < 2:
            failed.append(1)
            raise OSError("not now")
        return plain(self, min_t)

    monkeypatch.setattr("factweave.streaming.live.WAITS", (0.01, 0.02))
    monkeypatch.setattr(Store, "connect", shaky)
    live._patiently()
    assert seen == [40] and len(failed) == 2
    wrong = Live(store, "[:find ?d . :where [_ :buoy/none ?d]]", emit=lambda v, t: seen.append(v))
    with pytest.raises(QueryError):
        wrong._patiently()
    assert isinstance(wrong.ended, QueryError) and seen == [40]


def test_store_and_live(spark, tmp_path):
    path = str(tmp_path / "db")
    conn = Connection(spark, now=lambda: 3, path=path)
    conn.transact([attribute("buoy/name", "string"), attribute("buoy/depth", "long")])
    ids = conn.transact([{":db/id": "b", ":buoy/name": "B7", ":buoy/depth": 40}]).tempids
    store = Store(spark, path)
    assert store.compact() == conn.t and store.current() == conn.t
    seen = []
    live = Live(store, "[:find ?n ?d :where [?b :buoy/name ?n] [?b :buoy/depth ?d]]", emit=lambda v, t: seen.append(v))
    assert live.run() and not live.run()
    again = store.connect()
    again._now = lambda: 4
    again.transact([[":db/add", ids["b"], ":buoy/depth", 55]])
    live.start(spark, str(tmp_path / "ck"), once=True).awaitTermination(60)
    assert seen == [[["B7", 40]], [["B7", 55]]]
    assert [c["t"] for c in changes(store, conn.t)] == [again.t]
    pinned = Live(store, "[:find ?d . :where [_ :buoy/depth ?d]]", emit=lambda v, t: seen.append((v, t)), seen=lambda db: db.as_of(conn.t))
    assert pinned.start(spark, str(tmp_path / "ck2")) is None and seen[-1] == (40, conn.t)
    store.compact()
    assert store.retain(1) == [again.t] and store.connect().db().entity(ids["b"])["buoy/depth"] == 55
