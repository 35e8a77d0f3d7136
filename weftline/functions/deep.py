"""JSON of any depth. The standard library's scanner and encoder give up at some thousand levels;
these take over there with a stack of their own. They also tell a value's events one by one."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

#: One token behind white space; any other sign stands for itself and is no token.
_TOKEN = re.compile(r"""[ \t\n\r]*([{}\[\],:]|"[^"\\\x00-\x1f]*(?:\\.[^"\\\x00-\x1f]*)*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null|[^ \t\n\r])""", re.S)
_WORDS = {"true": True, "false": False, "null": None}
#: Kinds of events.
OPEN_OBJECT, OPEN_LIST, CLOSE, KEY, SCALAR = range(5)


def _reject(token: str):
    raise ValueError(token)


def _scalar(token: str):
    if token[0] == '"':
        if len(token) < 2:
            raise ValueError("open string")
        return json.loads(token) if "\\" in token else token[1:-1]
    if token in _WORDS:
        return _WORDS[token]
    if token[0] in "-0123456789" and token != "-":
        return int(token) if token.lstrip("-").isdigit() else float(token)
    raise ValueError(f"no value: {token[:20]}")


def events(text: str) -> Iterator[tuple[int, object]]:
    """The events of a JSON text in written order, ``(kind, name or scalar)``; ValueError if it isn't JSON."""
    ends: list[str] = []
    state = "value"
    for token in _TOKEN.findall(text):
        c = token[0]
        if state in ("value", "first item"):
            if c == "{":
                yield OPEN_OBJECT, None
                ends.append("}")
                state = "first name"
            elif c == "[":
                yield OPEN_LIST, None
                ends.append("]")
                state = "first item"
            elif c == "]" and state == "first item":
                yield CLOSE, None
                ends.pop()
                state = "after"
            else:
                yield SCALAR, _scalar(token)
                state = "after"
        elif state == "after":
            if not ends:
                raise ValueError("more behind the value")
            if c == ",":
                state = "name" if ends[-1] == "}" else "value"
            elif c == ends[-1]:
                yield CLOSE, None
                ends.pop()
            else:
                raise ValueError("no comma or end")
        elif state == "colon":
            if c != ":":
                raise ValueError("no colon")
            state = "value"
        elif c == '"':
            yield KEY, _scalar(token)
            state = "colon"
        elif c == "}" and state == "first name":
            yield CLOSE, None
            ends.pop()
            state = "after"
        else:
            raise ValueError("no name")
    if ends or state != "after":
        raise ValueError("no end")


def _built(text: str, make):
    """The value of the events of a text; ``make`` turns a list of (name, value) into an object."""
    stack: list[tuple[list, str | None]] = []
    done = name = None
    for kind, x in events(text):
        if kind == KEY:
            name = x
            continue
        if kind in (OPEN_OBJECT, OPEN_LIST):
            stack.append(([], name, kind))
            continue
        if kind == CLOSE:
            items, name, opened = stack.pop()
            x = make(items) if opened == OPEN_OBJECT else items
        if not stack:
            done = x
        else:
            stack[-1][0].append((name, x) if stack[-1][2] == OPEN_OBJECT else x)
    return done


def loads(text: str, pairs: type = dict):
    """A JSON value; objects are made by ``pairs`` from their (name, value) in written order."""
    try:
        return json.loads(text, object_pairs_hook=None if pairs is dict else pairs, parse_constant=_reject)
    except RecursionError:
        return _built(text, pairs)


def plain_number(x):
    return int(x) if isinstance(x, float) and x.is_integer() else x


def _deep_text(value, sort_keys: bool) -> str:
    out: list[str] = []
    todo: list = [value]
    done = object()
    while todo:
        x = todo.pop()
        if isinstance(x, tuple) and x and x[0] is done:
            out.append(x[1])
        elif isinstance(x, dict):
            items = sorted(x.items()) if sort_keys else list(x.items())
            todo.append((done, "}"))
            for n, (k, v) in reversed(list(enumerate(items))):
                todo += [v, (done, (", " if n else "") + json.dumps(k, ensure_ascii=False) + ": ")]
            out.append("{")
        elif isinstance(x, list):
            todo.append((done, "]"))
            for n, v in reversed(list(enumerate(x))):
                todo += [v, (done, ", ")] if n else [v]
            out.append("[")
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def dumps(value, sort_keys: bool = False) -> str:
    """JSON text of a value of any depth, as ``json.dumps`` writes it."""
    try:
        return json.dumps(value, ensure_ascii=False, sort_keys=sort_keys)
    except RecursionError:
        return _deep_text(value, sort_keys)


def canonical(value) -> str:
    """Equal JSON values have equal text: keys sorted, whole numbers without fraction."""
    if value is None or isinstance(value, (str, bool, int)):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, float):
        return json.dumps(plain_number(value))
    # Numbers are made plain in copies of the containers, level by level.
    top = [value]
    todo = [(top, 0)]
    while todo:
        holder, key = todo.pop()
        x = holder[key]
        if isinstance(x, float):
            holder[key] = plain_number(x)
        elif isinstance(x, dict):
            holder[key] = dict(x)
            todo += [(holder[key], k) for k, v in x.items() if isinstance(v, (float, dict, list))]
        elif isinstance(x, list):
            holder[key] = list(x)
            todo += [(holder[key], k) for k, v in enumerate(x) if isinstance(v, (float, dict, list))]
    return dumps(top[0], True)


def plain_text(text: str | None) -> str | None:
    """Halves of surrogate pairs, which JSON may escape but no column holds, escaped again."""
    return text if text is None or text.isascii() else "".join(c if not "\ud800" <= c <= "\udfff" else f"\\u{ord(c):04x}" for c in text)
