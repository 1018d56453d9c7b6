"""A bounded cache from spans of text to token ids, looked up for many spans at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from .common import joined

#: Bytes that one Python worker remembers; beyond, it starts anew.
REMEMBERED = 24 << 20


class Lexicon:
    """Ids of spans by 64-bit hash of the span; ``encode`` gives the ids of spans not yet known."""

    def __init__(self, encode: Callable[[Sequence[bytes]], list]):
        self.encode = encode
        self._clear()

    def _clear(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def look_up(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, prefix: np.ndarray | None = None, lead: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, number of ids of each span). Where ``prefix`` is set, ``lead`` comes before the span."""
        if sum(x.nbytes for x in (self.keys, self.slots, self.ids, self.begin, self.size)) > REMEMBERED:
            self._clear()
        keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        known[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] == keys[at < len(self.keys)]
        new = np.flatnonzero(~known)
        if len(new):
            text = data.tobytes()
            spans = [text[s:e] for s, e in zip(start[first[new]].tolist(), end[first[new]].tolist())]
            if prefix is not None:
                spans = [lead + s if p else s for s, p in zip(spans, prefix[first[new]].tolist())]
            found = self.encode(spans)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum()))
            slots = len(self.size) + np.arange(len(new))
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.ids = np.concatenate([self.ids, flat])
            self.keys = np.insert(self.keys, at[new], keys[new])
            self.slots = np.insert(self.slots, at[new], slots)
            at = np.searchsorted(self.keys, keys)
        which = self.slots[at[which]] if len(keys) else np.zeros(0, np.int64)
        return joined(self.ids, self.begin, self.size, which), self.size[which]
