"""A minimal acyclic transducer: words to id lists, in one memory-mapped file.

States with the same right language are shared, so common endings are stored
once. Edges carry numbers that add up to the word's rank; the rank addresses the
id list. A lookup walks the word's bytes over the mapped file.
"""

from __future__ import annotations

import json
import mmap
import struct
from array import array
from collections.abc import Iterable

_MAGIC = b"MWLX"


class _State:
    __slots__ = ("edges", "final", "number", "count")

    def __init__(self) -> None:
        self.edges: dict[int, _State] = {}
        self.final, self.number, self.count = False, -1, -1

    def key(self) -> tuple:
        return (self.final, *((b, s.number) for b, s in self.edges.items()))


def compile_lexicon(words: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The transducer of the words, which must come sorted and distinct.

    Incremental construction: once a prefix can't grow any more, its states are
    replaced by equal registered ones.
    """
    root, register, order = _State(), {}, []
    path: list[tuple[_State, int, _State]] = []
    offsets, ids, last = array("I", [0]), array("I"), None

    def close(down_to: int) -> None:
        while len(path) > down_to:
            parent, b, child = path.pop()
            k = child.key()
            known = register.get(k)
            if known is None:
                child.number = len(order)
                order.append(child)
                register[k] = child
            else:
                parent.edges[b] = known

    for word, out in words:
        if last is not None and word <= last:
            raise ValueError("words must be sorted and distinct")
        shared, n = 0, min(len(word), len(last or b""))
        while shared < n and word[shared] == last[shared]:
            shared += 1
        close(shared)
        at = path[-1][2] if path else root
        for b in word[shared:]:
            nxt = _State()
            at.edges[b] = nxt
            path.append((at, b, nxt))
            at = nxt
        at.final = True
        ids.extend(out)
        offsets.append(len(ids))
        last = word
    close(0)
    root.number = len(order)
    order.append(root)

    first, final = array("I"), bytearray()
    labels, targets, sums = bytearray(), array("I"), array("I")
    for s in order:  # children come before their parents
        first.append(len(labels))
        final.append(s.final)
        total = int(s.final)
        for b, t in sorted(s.edges.items()):
            labels.append(b)
            targets.append(t.number)
            sums.append(total)
            total += t.count
        s.count = total
    first.append(len(labels))
    parts = {"first": first.tobytes(), "targets": targets.tobytes(), "sums": sums.tobytes(), "offsets": offsets.tobytes(), "ids": ids.tobytes(), "final": bytes(final), "labels": bytes(labels)}
    head = json.dumps({"root": root.number, "words": len(offsets) - 1, "sizes": {k: len(v) for k, v in parts.items()}}).encode()
    head += b" " * (-(len(head) + 8) % 8)
    out = bytearray(_MAGIC + struct.pack("<I", len(head)) + head)
    for v in parts.values():
        out += v + b"\0" * (-len(v) % 8)
    return bytes(out)


class Lexicon:
    """Lookup over a compiled lexicon, mapped from a file or over bytes."""

    def __init__(self, data: mmap.mmap | bytes):
        self._data = data
        view = memoryview(data)
        n = struct.unpack("<I", view[4:8])[0]
        head = json.loads(bytes(view[8 : 8 + n]))
        at, part = 8 + n, {}
        for k, size in head["sizes"].items():
            part[k] = (at, size)
            at += size + (-size % 8)
        ints = {k: view[a : a + s].cast("I") for k, (a, s) in part.items() if k not in ("final", "labels")}
        self.first, self.targets, self.sums, self.offsets, self.ids = (ints[k] for k in ("first", "targets", "sums", "offsets", "ids"))
        self._final = view[part["final"][0] : sum(part["final"])]
        self._labels_at, self.root, self.words = part["labels"][0], head["root"], head["words"]

    @classmethod
    def open(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def get(self, word: bytes) -> list[int] | None:
        """Id list of the word, or None if the lexicon hasn't got it."""
        state, rank, base, find, first = self.root, 0, self._labels_at, self._data.find, self.first
        for i in range(len(word)):
            e = find(word[i : i + 1], base + first[state], base + first[state + 1]) - base
            if e < 0:
                return None
            rank += self.sums[e]
            state = self.targets[e]
        if not self._final[state]:
            return None
        return self.ids[self.offsets[rank] : self.offsets[rank + 1]].tolist()
