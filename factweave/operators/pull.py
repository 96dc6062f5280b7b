"""Nested projection of entities: a pattern gives one tree for each entity, built with joins for all at once.

A pattern is EDN text or a list of specs: an attribute (`:ns/name`, reverse `:ns/_name`), `:db/id`, `*`,
`{spec: sub-pattern}` for references (a number or `...` in place of a sub-pattern recurs), and
`[attribute :as key :limit n :offset n :default v :where [...] :order [...]]`. Children are filtered, ordered,
skipped and cut in this order, then resolved, so only the kept ones are read further. Many-valued attributes are
arrays in value order, at most 1000 long unless :limit says otherwise (None: unlimited). Attributes that an
entity lacks are null fields; `tree` leaves them out. A reference's target with nothing of its sub-pattern is
`{db/id}`. Recursion goes level by level for all entities at once, each level written to the shared folder; an
entity that its own path holds already, or that lies beyond a number's depth, is `{db/id}`, so cycles end.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import edn
from ..edn import Const
from ..functions.builtins import predicate
from ..functions.values import Val, const
from ..plans.query import QueryError
from ..sources.scratch import written
from ..sources.views import VALUE, Attribute, View

LIMIT = 1000
_OPS = {"eq": "=", "ne": "!=", "lt": "<", "lte": "<=", "gt": ">", "gte": ">=", "startsWith": "starts-with?", "endsWith": "ends-with?", "includes": "includes?"}


@dataclass
class Spec:
    attr: str
    reverse: bool = False
    key: str = ""
    limit: int | None = LIMIT
    offset: int = 0
    default: Any = None
    where: list = field(default_factory=list)
    order: list = field(default_factory=list)
    sub: Any = None  # a pattern, a number, or "..."


def parse_pattern(pattern) -> list:
    if isinstance(pattern, str):
        pattern = edn.read(pattern) if pattern.startswith("[") else [pattern]
    out: list = []
    for x in pattern:
        if isinstance(x, Mapping):
            for k, sub in x.items():
                spec = _spec(edn.thawed(k))
                spec.sub = sub if isinstance(sub, int) or sub == "..." else parse_pattern(sub)
                out.append(spec)
        elif x in ("*", ":db/id", "db/id"):
            out.append(str(x).lstrip(":"))
        else:
            out.append(_spec(x))
    return out


def _spec(x) -> Spec:
    options: dict[str, Any] = {}
    if isinstance(x, list):
        if x[0] in ("limit", "default"):
            x = [x[1], x[0], x[2]]
        x, rest = x[0], x[1:]
        options = {str(k).lstrip(":"): (v.value if isinstance(v, Const) else v) for k, v in zip(rest[::2], rest[1::2])}
    ns, _, name = str(x).lstrip(":").rpartition("/")
    reverse = name.startswith("_")
    spec = Spec(f"{ns}/{name[1:]}" if reverse else f"{ns}/{name}", reverse)
    spec.key = str(options.pop("as", f"{ns}/{name}")).lstrip(":")
    for k, v in options.items():
        if k not in ("limit", "offset", "default", "where", "order"):
            raise QueryError(f"unknown pull option {k}")
        setattr(spec, k, v)
    return spec


def _recurs(s) -> bool:
    return isinstance(s, Spec) and (s.sub == "..." or isinstance(s.sub, int) and not isinstance(s.sub, bool))


def pull_frame(view: View, ids: DataFrame, pattern, nested: bool = False) -> DataFrame:
    """(e, tree) of the distinct entities of ids (e). nested: a tree with nothing in it gets its db/id."""
    specs = parse_pattern(pattern) if not (isinstance(pattern, list) and all(isinstance(s, Spec) or s in ("*", "db/id") for s in pattern)) else pattern
    specs = [s for s in specs if not isinstance(s, Spec) or s.attr in view.schema.attributes or s.default is not None]  # unknown attributes are left out
    if any(map(_recurs, specs)):
        return _unrolled(view, ids, specs, nested)
    out = ids.select("e").distinct()
    fields: dict[str, Column] = {}
    for k, s in enumerate(specs):
        if s == "db/id":
            fields["db/id"] = F.col("e")
        elif s == "*":
            out = out.join(_wildcard(view, ids, f"__{k}"), "e", "left")
            fields.setdefault("db/id", F.when(F.col(f"__{k}").isNotNull(), F.col("e")))
            fields["*"] = F.col(f"__{k}")
        elif s.attr not in view.schema.attributes:
            fields[s.key] = const(s.default).col
        else:
            values = _values(view, ids, view.schema.attributes[s.attr], s).withColumnRenamed("value", f"__{k}")
            out = out.join(values, "e", "left")
            fields[s.key] = F.col(f"__{k}") if s.default is None else F.coalesce(F.col(f"__{k}"), const(s.default).col)
    return out.select("e", _tree(fields, F.col("e"), nested).alias("tree"))


def _tree(fields: Mapping[str, Column], e: Column, nested: bool) -> Column:
    if nested and "db/id" not in fields or not fields:
        empty = reduce(lambda a, b: a & b, [c.isNull() for c in fields.values()], F.lit(True))
        fields = {"db/id": F.when(empty, e), **fields}
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _wildcard(view: View, ids: DataFrame, name: str) -> DataFrame:
    """A map from attribute to its values, and whether it may have many."""
    facts = view.everything().join(ids.select("e").distinct(), "e", "left_semi")
    each = facts.groupBy("e", "a").agg(F.sort_array(F.collect_list(F.struct(*VALUE))).alias("vs"))
    known = view.schema.attributes.values()
    idents = F.create_map(*[x for a in known for x in (F.lit(a.id), F.lit(a.ident))])
    many = F.col("a").isin([a.id for a in known if a.many])
    entry = F.struct(F.coalesce(idents[F.col("a")], F.col("a").cast("string")).alias("k"), F.struct(many.alias("many"), "vs").alias("v"))
    return each.groupBy("e").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias(name))


def _edges(view: View, attr: Attribute, reverse: bool) -> DataFrame:
    rel = view.relation(attr)
    return rel.select(F.col("v").alias("e"), F.col("e").alias("v")) if reverse else rel.select("e", "v")


def _single(attr: Attribute, s: Spec) -> bool:
    return (attr.component and s.reverse) or (not attr.many and not s.reverse)


def _chosen(view: View, ids: DataFrame, attr: Attribute, s: Spec) -> DataFrame:
    """(e, v, rn): the values that a spec keeps of each entity, with their places."""
    if s.reverse and attr.kind != "ref":
        raise QueryError(f"{attr.ident} is no reference")
    rows = _edges(view, attr, s.reverse).join(ids.select("e").distinct(), "e", "left_semi")
    if s.where:
        keep = _satisfying(view, rows.select(F.col("v").alias("e")).distinct(), s.where)
        rows = rows.join(keep.withColumnRenamed("e", "v"), "v", "left_semi")
    keys = []
    for k, o in enumerate(s.order):
        path, *more = o if isinstance(o, list) and not str(o[0]).startswith(":db/") else [o]
        words = [str(m.value if isinstance(m, Const) else m).lstrip(":") for m in more]
        hops = path if isinstance(path, list) else [path]
        key = _follow(view, rows.select(F.col("v").alias("e")).distinct(), hops).groupBy("e").agg(F.min("x").alias(f"__o{k}")).withColumnRenamed("e", "v")
        rows = rows.join(key, "v", "left")
        c = F.col(f"__o{k}")
        keys.append((c.desc_nulls_first() if "first" in words else c.desc_nulls_last()) if "desc" in words else (c.asc_nulls_first() if "first" in words else c.asc_nulls_last()))
    rank = F.row_number().over(Window.partitionBy("e").orderBy(*keys, F.col("v").asc()))
    rows = rows.select("e", "v", rank.alias("rn"))
    if s.offset:
        rows = rows.where(F.col("rn") > s.offset)
    if _single(attr, s):
        return rows.where(F.col("rn") == s.offset + 1)
    return rows if s.limit is None else rows.where(F.col("rn") <= s.offset + s.limit)


def _listed(value: Column) -> Column:
    """Values of a group in the order of their places."""
    cells = F.array_sort(F.collect_list(F.struct("rn", F.struct(value.alias("x")).alias("y"))), lambda p, q: p["rn"] - q["rn"])
    return F.transform(cells, lambda p: p["y"]["x"])


def _values(view: View, ids: DataFrame, attr: Attribute, s: Spec) -> DataFrame:
    rows = _chosen(view, ids, attr, s)
    if attr.kind == "ref":
        inner = pull_frame(view, rows.select(F.col("v").alias("e")), s.sub if s.sub is not None else ["db/id"], True).withColumnRenamed("e", "v")
        rows = rows.join(inner, "v").withColumn("value", F.col("tree"))
    else:
        rows = rows.withColumn("value", F.col("v"))
    return rows.select("e", "value") if _single(attr, s) else rows.groupBy("e").agg(_listed(F.col("value")).alias("value"))


def _unrolled(view: View, ids: DataFrame, specs: list, nested: bool) -> DataFrame:
    """Trees of a pattern that recurs. A node is a path of entities and the specs (by) that led along it."""
    attrs = {k: view.schema.attributes[s.attr] for k, s in enumerate(specs) if _recurs(s)}
    nodes = ids.select("e").distinct().select("e", F.array("e").alias("path"), F.array().cast("array<int>").alias("by"))
    places, children = [nodes], []
    while True:
        parts = []
        for k, attr in attrs.items():
            deep = isinstance(specs[k].sub, int) and len(children) >= specs[k].sub
            cut = F.lit(True) if deep else F.array_contains("path", F.col("v"))
            parts.append(nodes.join(_chosen(view, nodes.select("e"), attr, specs[k]), "e").select("path", "by", F.lit(k).alias("k"), "rn", "v", cut.alias("cut")))
        found = written(reduce(DataFrame.unionByName, parts), "pull-level")
        children.append(found)
        nodes = found.where("not cut").select(F.col("v").alias("e"), F.concat("path", F.array("v")).alias("path"), F.concat("by", F.array("k")).alias("by"))
        if nodes.isEmpty():
            break
        places.append(nodes)
    every = reduce(DataFrame.unionByName, [p.select("e") for p in places]).distinct()
    base = pull_frame(view, every, plain := [s for s in specs if not _recurs(s)] or ["db/id"]).withColumnRenamed("tree", "__base")
    names = [n for n in base.schema["__base"].dataType.names if plain != ["db/id"] or "db/id" in specs]
    deeper = None
    for depth in reversed(range(len(places))):
        kids = children[depth]
        if deeper is None:
            kids = kids.withColumn("value", F.struct(F.col("v").alias("db/id")))
        else:
            below = deeper.toDF("__e", "__path", "__by", "__tree")
            kids = kids.withColumn("__p", F.concat("path", F.array("v"))).withColumn("__b", F.concat("by", F.array("k")))
            kids = kids.join(below, (kids["__p"] == below["__path"]) & (kids["__b"] == below["__by"]) & ~kids["cut"], "left")
            inner = [n for n in below.schema["__tree"].dataType.names if n != "db/id"]
            kids = kids.withColumn("value", F.struct(F.coalesce(F.col("__tree")["db/id"], F.when(F.col("cut"), F.col("v"))).alias("db/id"), *[F.col("__tree")[n].alias(n) for n in inner]))
        out = places[depth].join(base, "e", "left")
        fields = {n: F.col("__base")[n] for n in names}
        for k, attr in attrs.items():
            mine = kids.where(F.col("k") == k)
            got = (mine.select("path", "by", F.col("value").alias(f"__{k}")) if _single(attr, specs[k]) else mine.groupBy("path", "by").agg(_listed(F.col("value")).alias(f"__{k}")))
            out = out.join(got, ["path", "by"], "left")
            fields[specs[k].key] = F.col(f"__{k}")
        deeper = out.select("e", "path", "by", _tree(fields, F.col("e"), nested or depth > 0).alias("tree"))
    return deeper.select("e", "tree")


def _follow(view: View, starts: DataFrame, hops: list) -> DataFrame:
    """(e, x): values at the end of a path of attributes from each start."""
    rows = starts.select("e", F.col("e").alias("x"))
    for h in hops:
        spec = _spec(h)
        step = _edges(view, view.schema.attr(spec.attr), spec.reverse).toDF("__e", "__v")
        rows = rows.join(step, rows["x"] == step["__e"]).select("e", F.col("__v").alias("x"))
    return rows


def _path_kind(view: View, hops: list) -> str:
    spec = _spec(hops[-1])
    return "ref" if spec.reverse else view.schema.attr(spec.attr).kind


def _satisfying(view: View, starts: DataFrame, conditions: list) -> DataFrame:
    """The starts (e) for which all conditions hold; a path's condition holds if some value at its end meets it."""
    return reduce(lambda rows, c: _one(view, rows, c), conditions, starts)


def _one(view: View, starts: DataFrame, c) -> DataFrame:
    head = str(c[0].value if isinstance(c[0], Const) else c[0]).lstrip(":")
    if head == "and":
        return _satisfying(view, starts, c[1:])
    if head == "or":
        return reduce(DataFrame.unionByName, [_one(view, starts, x) for x in c[1:]]).distinct() if len(c) > 1 else starts.where(F.lit(False))
    if head == "not":
        return starts.join(_one(view, starts, c[1]), "e", "left_anti")
    if head in ("some", "every"):
        hops = c[1] if isinstance(c[1], list) else [c[1]]
        met = _follow(view, starts, hops)
        good = _satisfying(view, met.select(F.col("x").alias("e")).distinct(), c[2:])
        hit = met.join(good.withColumnRenamed("e", "x"), "x", "left_semi" if head == "some" else "left_anti")
        return starts.join(hit.select("e").distinct(), "e", "left_semi" if head == "some" else "left_anti")
    hops = c[1] if isinstance(c[1], list) else [c[1]]
    met = _follow(view, starts, hops)
    if head in ("exists", "has"):
        return starts.join(met.select("e").distinct(), "e", "left_semi")
    if head == "missing":
        return starts.join(met.select("e").distinct(), "e", "left_anti")
    v = Val(met["x"], _path_kind(view, hops))
    if head == "in":
        test = reduce(lambda a, b: a | b, [predicate("=")(v, const(x.value if isinstance(x, Const) else x)) for x in c[2]], F.lit(False))
    else:
        fn = predicate(_OPS.get(head, head))
        if fn is None:
            raise QueryError(f"unknown condition {head}")
        x = const(c[2].value if isinstance(c[2], Const) else c[2])
        test = fn(x, v) if head.startswith("re-") else fn(v, x)
    return starts.join(met.where(test).select("e").distinct(), "e", "left_semi")


def attach(view: View, df: DataFrame, column: str, pattern) -> DataFrame:
    """df with a column of entity ids replaced by their trees."""
    trees = pull_frame(view, df.select(F.col(f"`{column}`").alias("e")), pattern).toDF("__e", "__tree")
    joined = df.join(trees, df[f"`{column}`"] == trees["__e"], "left")
    return joined.select(*[F.col("__tree").alias(column) if c == column else df[f"`{c}`"] for c in df.columns])


def tree(value):
    """A collected tree as dicts and lists, without what entities lack."""
    if hasattr(value, "asDict"):
        out = {k: tree(v) for k, v in value.asDict().items() if v is not None}
        star = out.pop("*", None)
        return {**(star or {}), **out}
    if isinstance(value, dict):
        return {k: [_slot(x) for x in v["vs"]] if v["many"] else _slot(v["vs"][0]) for k, v in value.items()}
    return [tree(v) for v in value] if isinstance(value, list) else value


def _slot(row):
    found = next((row[f] for f in VALUE[1:] if row[f] is not None), None)
    return {"db/id": found} if row["vt"] == 5 else found


def pull(view: View, e, pattern) -> dict | None:
    """The tree of one entity, or None if it has nothing of the pattern."""
    return pull_many(view, [e], pattern)[0]


def pull_many(view: View, entities: list, pattern) -> list[dict | None]:
    ids = [view.entid(e) for e in entities]
    known = [i for i in dict.fromkeys(ids) if i is not None]
    if not known:
        return [None] * len(ids)
    df = view.spark.createDataFrame([(i,) for i in known], "e bigint")
    found = {r["e"]: tree(r["tree"]) for r in pull_frame(view, df, pattern).collect()}
    only_id = parse_pattern(pattern) == ["db/id"]
    return [None if i is None or not found.get(i) or (set(found[i]) == {"db/id"} and not only_id) else found[i] for i in ids]
