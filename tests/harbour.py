"""Facts of the tests: harbours of an invented coast, the lines between them, and what they handle."""

from factweave import edn

CLOCK = 1_650_000_111_000


def attribute(name, kind, **more):
    return {":db/ident": f":{name}", ":db/valueType": f":db.type/{kind}", **{f":db/{k}": (f":db.{k}/{v}" if isinstance(v, str) else v) for k, v in more.items()}}


SCHEMA = [
    attribute("port/code", "string", unique="identity"),
    attribute("port/title", "string"),
    attribute("port/berths", "long"),
    attribute("port/draft", "double"),
    attribute("port/ice", "boolean"),
    attribute("port/since", "instant"),
    attribute("port/coast", "string"),
    attribute("port/hub", "ref"),
    attribute("port/lines", "ref", cardinality="many"),
    attribute("port/goods", "string", cardinality="many"),
    attribute("crane/of", "ref"),
    attribute("crane/tons", "long"),
]

#: code -> its attributes; hub and lines name other codes.
PORTS = {
    "VEL": {"title": "Velmark", "berths": 12, "draft": 14.25, "ice": False, "since": "1871-05-04T00:00:00Z", "coast": "north", "goods": ["ore", "grain", "salt"], "lines": ["TOR", "QUN"]},
    "TOR": {"title": "Torvik", "berths": 4, "draft": 9.5, "ice": True, "coast": "north", "hub": "VEL", "goods": ["fish"], "lines": ["VEL"]},
    "QUN": {"title": "Quennby", "berths": 7, "ice": False, "coast": "west", "hub": "VEL", "goods": ["wool", "salt"], "lines": ["IST"]},
    "IST": {"title": "Istra Quay", "berths": 4, "draft": 6.0, "ice": False, "coast": "west", "hub": "QUN", "lines": ["QUN", "LOM", "VEL"]},
    "LOM": {"title": "Lomond", "berths": 1, "draft": 3.75, "since": "1990-11-30T12:30:00Z", "hub": "IST"},
    "HAF": {"title": "Hafnest", "berths": 7, "draft": 9.5, "ice": True, "coast": "east", "goods": ["fish", "ore"]},
}
CRANES = [("VEL", 90), ("VEL", 40), ("QUN", 25), ("HAF", 40)]


def entities():
    out = []
    for code, p in PORTS.items():
        e = {":db/id": code, ":port/code": code, **{f":port/{k}": edn.Instant.of(v) if k == "since" else v for k, v in p.items()}}
        out.append(e)
    return out + [{":crane/of": code, ":crane/tons": tons} for code, tons in CRANES]
