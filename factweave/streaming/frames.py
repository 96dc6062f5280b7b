"""Messages between a store's writer and its followers, as JSON: a transaction, a new snapshot, a greeting, a gap.

Fixed values: {"v": 1, "kind": "tx" | "root" | "hello" | "gap"}; a datom is [e, a, kind tag, value, t, 1 or 0], bytes
in base64.
"""

from __future__ import annotations

import base64
import json

from ..functions.values import KINDS, SLOTS
from ..sources.views import DATOMS, VALUE
from ..transactions import BOOT, Store
from .live import Replica

_INSTANT = BOOT["db/txInstant"][0]


def wire(row: tuple) -> list:
    cells = dict(zip(DATOMS.fieldNames(), row))
    value = cells[SLOTS[KINDS[cells["vt"]]]]
    return [cells["e"], cells["a"], cells["vt"], base64.b64encode(value).decode() if isinstance(value, (bytes, bytearray)) else value, cells["t"], int(cells["op"])]


def unwired(w: list) -> tuple:
    e, a, tag, value, t, op = w
    slot = SLOTS[KINDS[tag]]
    value = base64.b64decode(value) if slot == "v_bytes" else float(value) if slot == "v_double" else value
    return (e, a, tag, *(value if f == slot else None for f in VALUE[1:]), t, bool(op))


def tx_frame(t: int, rows: list[tuple]) -> str:
    at = next((r[3] for r in rows if r[1] == _INSTANT and r[-1]), None)
    return json.dumps({"v": 1, "kind": "tx", "t": t, "txInstant": at, "datoms": [wire(r) for r in rows]})


def root_frame(root: int) -> str:
    return json.dumps({"v": 1, "kind": "root", "root": root})


def hello_frame(store: Store) -> str:
    return json.dumps({"v": 1, "kind": "hello", "t": max([*store.committed(), store.current()]), "root": store.current()})


def gap_frame(start: int) -> str:
    return json.dumps({"v": 1, "kind": "gap", "from": start})


def frames(store: Store, after: int) -> list[str]:
    """What a follower that has seen `after` is sent: a greeting, a gap mark if the log's start is beyond it, and the
    transactions since."""
    out = [hello_frame(store)]
    rows: dict[int, list[tuple]] = {}
    for r in store.tail(after).where(f"t > {after}").collect():  # what a client catches up with
        rows.setdefault(r["t"], []).append(tuple(r))
    known = min(rows, default=after + 1)
    if known > after + 1:
        out.append(gap_frame(known))
    return out + [tx_frame(t, rows[t]) for t in sorted(rows)]


def follow(replica: Replica, messages) -> list[str]:
    """Give messages to a replica; what it said to each."""
    said = []
    for m in messages:
        m = json.loads(m)
        if m.get("v") != 1 or m.get("kind") not in ("tx", "root", "hello", "gap"):
            raise ValueError(f"not a message: {m!r}")
        if m["kind"] == "tx":
            said.append(replica.offer(m["t"], [unwired(w) for w in m["datoms"]]))
        elif m["kind"] == "root":
            said.append("root")  # snapshots hold the same facts
        else:
            replica.db(m["root"] if m["kind"] == "hello" else m["from"] - 1)  # reads on from the store if it is behind
            said.append(m["kind"])
    return said
