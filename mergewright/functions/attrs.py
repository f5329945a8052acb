"""Attribute text of a listing as a list of (key, value) entries.

The text may be a JSON object, a JSON text inside a JSON string, a list of
name and value objects, nested groups, or ``key: value; key: value``. Keys may
repeat, so objects are read as pairs in text order.
"""

from __future__ import annotations

import json

#: Key names of entries written as objects of a name and a value.
NAME_KEYS = frozenset({"name", "attr", "key", "title", "attribute", "property"})
VALUE_KEYS = frozenset({"value", "val", "values"})


class _Pairs(list):
    """A JSON object as its pairs."""


_decoder = json.JSONDecoder(object_pairs_hook=_Pairs)
Entry = tuple[str, object]


def _entry_of(pairs: _Pairs) -> Entry | None:
    if len(pairs) != 2:
        return None
    (a, x), (b, y) = pairs
    if a.lower() in NAME_KEYS and b.lower() in VALUE_KEYS:
        return str(x), y
    if b.lower() in NAME_KEYS and a.lower() in VALUE_KEYS:
        return str(y), x
    return None


def _walk(root: object) -> list[Entry]:
    """Entries below a node in text order, at any depth."""
    if isinstance(root, _Pairs) and len(root) != 2 and not any(isinstance(v, list) for _, v in root):
        return root
    out: list[Entry] = []
    todo: list[tuple[str | None, object]] = [(None, root)]
    while todo:
        key, node = todo.pop()
        if isinstance(node, _Pairs):
            if key is None and (e := _entry_of(node)):
                todo.append(e)
            else:
                todo += reversed(node)
        elif isinstance(node, list):
            # the objects of a list may be entries themselves
            todo += [(None if isinstance(x, _Pairs) else key, x) for x in reversed(node)]
        elif key is not None:
            out.append((key, node))
    return out


def entries(text: str | None) -> list[Entry]:
    """Entries in text order; a list value gives one entry per element.

    Null, blank, cut off and other unreadable text gives none.
    """
    if not text or not (s := text.strip()):
        return []
    while True:
        try:
            node = _decoder.decode(s)
        except (ValueError, RecursionError):
            if s[0] in '{["' or ":" not in s:
                return []
            out = []
            for part in s.split(";"):
                k, colon, v = part.partition(":")
                if colon:
                    out.append((k.strip(), v.lstrip(": ")))
            return out
        if not isinstance(node, str):
            return _walk(node)
        # a text within a string, quoted any number of times: every decoding is shorter
        if not (s := node.strip()):
            return []
