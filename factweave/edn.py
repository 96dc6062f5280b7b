"""EDN text to Python forms and back.

Symbols and keywords become plain strings (keywords keep their colon), lists and vectors lists, maps dicts, sets
Python sets. A string literal that could be taken for a symbol, keyword, variable or source is wrapped in Const.
`#inst` gives Instant (epoch milliseconds), `#uuid` Uuid, `#bytes` bytes from hexadecimal text.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from typing import Any


class EdnError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: Any


class Instant(int):
    """Epoch milliseconds."""

    @staticmethod
    def of(value) -> Instant:
        if isinstance(value, dt.datetime):
            value = value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)
            return Instant(round(value.timestamp() * 1000))
        if isinstance(value, str):
            return Instant.of(dt.datetime.fromisoformat(value.replace("Z", "+00:00")))
        return Instant(value)

    def iso(self) -> str:
        whole, ms = divmod(int(self), 1000)
        return dt.datetime.fromtimestamp(whole, dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S") + f".{ms:03d}Z"


class Uuid(str):
    PATTERN = re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}")

    def __new__(cls, value: str):
        low = value.lower()
        if not cls.PATTERN.fullmatch(low):
            raise ValueError(f"not a uuid: {value}")
        return super().__new__(cls, low)


_TOKEN = re.compile(r"""[\s,]+|;[^\n]*|(?P<open>\#\{|[(\[{])|(?P<close>[)\]}])|(?P<skip>\#_)|(?P<str>"(?:[^"\\]|\\.)*")|(?P<chr>\\(?:newline|space|tab|return|u[0-9a-fA-F]{4}|.))|(?P<tag>\#[A-Za-z][\w./-]*)|(?P<atom>[^\s,;()\[\]{}"]+)""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\", "b": "\b", "f": "\f"}
_CHARS = {"newline": "\n", "space": " ", "tab": "\t", "return": "\r"}
_PAIRS = {"(": ")", "[": "]", "{": "}", "#{": "}"}


def _string(raw: str) -> str:
    def one(m: re.Match) -> str:
        if m[1].startswith("u"):
            return chr(int(m[1][1:], 16))
        if m[1] not in _ESCAPES:
            raise EdnError(f"bad escape \\{m[1]}")
        return _ESCAPES[m[1]]

    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", one, raw[1:-1], flags=re.S)


def _atom(text: str):
    if text in ("nil", "true", "false"):
        return {"nil": None, "true": True, "false": False}[text]
    if re.fullmatch(r"[+-]?\d+N?", text):
        return int(text.rstrip("N"))
    if re.fullmatch(r"[+-]?\d+(\.\d*)?([eE][+-]?\d+)?M?", text):
        return float(text.rstrip("M"))
    return text


def _literal(text: str):
    return Const(text) if re.match(r"[?:$%_*]|\.\.\.$", text) or re.fullmatch(r"[a-z][\w?!*<>=./-]*", text) else text


def _tagged(tag: str, value):
    value = value.value if isinstance(value, Const) else value
    if tag == "#inst":
        return Instant.of(value)
    if tag == "#uuid":
        return Uuid(value)
    if tag == "#bytes":
        return bytes.fromhex(value)
    raise EdnError(f"unknown tag {tag}")


def frozen(form):
    """A form as a map's key: lists become tuples."""
    return tuple(map(frozen, form)) if isinstance(form, list) else form


def thawed(form):
    return list(map(thawed, form)) if isinstance(form, (list, tuple)) else form


def read(text: str):
    """The one form in a text."""
    forms = read_all(text)
    if len(forms) != 1:
        raise EdnError(f"expected one form, found {len(forms)}")
    return forms[0]


def read_all(text: str) -> list:
    # each frame: [closing text, opening text, forms]; a tag or a skip waits in the frame's forms as a marker
    stack: list[list] = [[None, None, []]]
    skip, at = object(), 0

    def put(form):
        forms = stack[-1][2]
        while forms and (forms[-1] is skip or isinstance(forms[-1], _Tag)):
            mark = forms.pop()
            if mark is skip:
                return
            form = _tagged(mark.name, form)
        forms.append(form)

    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise EdnError(f"cannot read at {at}: {text[at : at + 20]!r}")
        at = m.end()
        if m["open"]:
            stack.append([_PAIRS[m["open"]], m["open"], []])
        elif m["close"]:
            want, opened, forms = stack.pop() if len(stack) > 1 else (None, None, [])
            if m["close"] != want:
                raise EdnError(f"unexpected {m['close']}")
            if forms and (forms[-1] is skip or isinstance(forms[-1], _Tag)):
                raise EdnError("a tag or skip without a form")
            if opened == "{":
                if len(forms) % 2:
                    raise EdnError("a map needs an even number of forms")
                put({frozen(k): v for k, v in zip(forms[::2], forms[1::2])})
            else:
                put(set(forms) if opened == "#{" else forms)
        elif m["skip"]:
            stack[-1][2].append(skip)
        elif m["tag"]:
            stack[-1][2].append(_Tag(m["tag"]))
        elif m["str"]:
            put(_literal(_string(m["str"])))
        elif m["chr"]:
            name = m["chr"][1:]
            put(_literal(_CHARS.get(name) or (chr(int(name[1:], 16)) if len(name) == 5 and name[0] == "u" else name)))
        elif m["atom"]:
            put(_atom(m["atom"]))
    if len(stack) > 1:
        raise EdnError(f"missing {stack[-1][0]}")
    return stack[0][2]


class _Tag:
    def __init__(self, name: str):
        self.name = name


def write(form) -> str:
    """EDN text of a form; read(write(x)) gives x back."""
    if form is None or isinstance(form, bool):
        return {None: "nil", True: "true", False: "false"}[form]
    if isinstance(form, Instant):
        return f'#inst "{form.iso()}"'
    if isinstance(form, Uuid):
        return f'#uuid "{form}"'
    if isinstance(form, (int, float)):
        return repr(form)
    if isinstance(form, bytes):
        return f'#bytes "{form.hex()}"'
    if isinstance(form, Const):
        return write(form.value) if not isinstance(form.value, str) else _quoted(form.value)
    if isinstance(form, str):
        return form if isinstance(_literal(form), Const) else _quoted(form)
    if isinstance(form, dict):
        return "{" + " ".join(f"{write(k)} {write(v)}" for k, v in form.items()) + "}"
    if isinstance(form, (set, frozenset)):
        return "#{" + " ".join(sorted(map(write, form))) + "}"
    return "[" + " ".join(map(write, form)) + "]"


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + '"'


def to_json(value):
    """Values as the JSON transport writes them: $inst, $uuid and $bytes objects."""
    if isinstance(value, Instant):
        return {"$inst": int(value)}
    if isinstance(value, Uuid):
        return {"$uuid": str(value)}
    if isinstance(value, bytes):
        return {"$bytes": value.hex()}
    if isinstance(value, dict):
        return {k: to_json(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [to_json(v) for v in value]
    return value


def from_json(value):
    if isinstance(value, dict):
        if len(value) == 1:
            (k, v), = value.items()
            if k == "$inst":
                return Instant.of(v)
            if k == "$uuid":
                return Uuid(v)
            if k == "$bytes":
                return bytes.fromhex(v)
            if k == "const":
                return Const(from_json(v))
        return {k: from_json(v) for k, v in value.items()}
    return [from_json(v) for v in value] if isinstance(value, list) else value
