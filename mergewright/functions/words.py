"""Patterns over many words."""

from __future__ import annotations

import re
from collections.abc import Iterable


def one_of(words: Iterable[str]) -> str:
    """Pattern of the longest of the words at a place, as a tree of their letters."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(node: dict) -> str:
        more = [re.escape(c) + pattern(n) for c, n in sorted(node.items()) if c]
        if not more:
            return ""
        body = more[0] if len(more) == 1 and "" not in node else "(?:" + "|".join(more) + ")"
        return body + "?" if "" in node else body

    return pattern(tree)
