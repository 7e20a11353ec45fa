"""Many texts encoded at once: cut where a pre-token must begin, each distinct part encoded once.

Cuts hold for the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``:
at a space or around a line feed that no white space touches, and between an ASCII letter or
digit and one of ``.,;:!?``. No pre-token lies on both sides of such a place, nor does what
lies on one side change those on the other, so the ids of the parts in a row are the text's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

from fieldmark.llm.common import Memo

#: Bytes of text that are cut and looked up together, about, and parts whose ids are gathered together.
TOGETHER, GATHERED = 4 << 20, 1 << 19
#: The longest part that is remembered.
MEMO_LENGTH = 40

_OTHER, _WHITE, _WORD, _STOP, _LEAD = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(9, 14), *range(28, 33)]] = _WHITE
_KIND[np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8)] = _WORD
_KIND[np.frombuffer(b".,;:!?", np.uint8)] = _STOP
#: White space beyond ASCII, and what some tables count as such; their first bytes.
_WIDE = [*map(chr, (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF))]
_TWO = [int.from_bytes(b) for c in _WIDE if len(b := c.encode()) == 2]
_THREE = [int.from_bytes(b) for c in _WIDE if len(b := c.encode()) == 3]
_KIND[[c.encode()[0] for c in _WIDE]] = _LEAD


def cuts(data: np.ndarray) -> np.ndarray:
    """Of each byte of UTF-8 texts in a row, whether a part may begin there."""
    n, kind = len(data), _KIND[data]
    solid, leads = kind != _WHITE, np.flatnonzero(kind == _LEAD)
    if len(leads):
        after = [data[np.minimum(leads + k, n - 1)].astype(np.int32) for k in range(3)]
        two, three = leads[np.isin(after[0] << 8 | after[1], _TWO)], leads[np.isin(after[0] << 16 | after[1] << 8 | after[2], _THREE)]
        for at in (two, two + 1, three, three + 1, three + 2):
            solid[at] = False
    alone = np.zeros(n, bool)
    alone[1:-1] = solid[:-2] & solid[2:]
    line = alone & (data == 0x0A)
    cut = alone & (data == 0x20) | line
    cut[1:] |= line[:-1] | (kind[1:] == _STOP) & (kind[:-1] == _WORD)
    return cut


class Parts:
    """Encodes texts by their parts; ``new`` gives ids, where those of each part begin and how many they are.

    A bounded memo holds where the ids of a part lie in one array; a full one takes no more.
    """

    def __init__(self, new: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]], limit: int, cut: bool = True, whole: Sequence[str] = ()) -> None:
        self.new, self.cut, self.whole = new, cut, whole
        self.memo = Memo(limit)
        self.ids, self.used = np.empty(1 << 16, "<u4"), 0

    def clear(self, limit: int | None = None) -> None:
        self.memo.clear(limit)
        self.ids, self.used = np.empty(1 << 16, "<u4"), 0

    def encode(self, texts: Sequence[str]) -> Iterator[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        first = size = 0
        for k, t in enumerate(texts):
            if size and size + len(t) > TOGETHER:
                yield from self._encode(texts[first:k])
                first, size = k, 0
            size += len(t)
        yield from self._encode(texts[first:])

    def _encode(self, texts: Sequence[str]) -> Iterator[bytes]:
        column = pa.array(texts, pa.large_string())
        ends = np.frombuffer(column.buffers()[1], np.int64, len(texts) + 1) if len(texts) else np.zeros(1, np.int64)
        if not ends[-1]:
            yield from [b""] * len(texts)
            return
        data = np.frombuffer(column.buffers()[2], np.uint8, ends[-1])
        cut = cuts(data) if self.cut else np.zeros(len(data), bool)
        if self.whole:
            for k, t in enumerate(texts):
                if any(map(t.__contains__, self.whole)):
                    cut[ends[k] : ends[k + 1]] = False
        cut[ends[:-1][ends[:-1] < ends[1:]]] = True
        begins = np.flatnonzero(cut)
        bounds = np.searchsorted(begins, ends)  # parts before each text
        begins = np.append(begins, len(data))
        parts = pa.LargeStringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins), column.buffers()[2]).dictionary_encode()
        which, places = parts.indices.to_numpy(), self._places(parts.dictionary.to_pylist())
        sizes = (places & 0xFFFFFFFF)[which]
        bounds = np.append(0, np.cumsum(sizes))[bounds]  # ids before each text
        out = []
        for at in range(0, len(which), GATHERED):
            some = sizes[at : at + GATHERED]
            upto = np.cumsum(some)
            out.append(self.ids[np.repeat((places >> 32)[which[at : at + GATHERED]] - (upto - some), some) + np.arange(upto[-1])])
        out = memoryview(np.concatenate(out)).cast("B")
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield bytes(out[4 * a : 4 * b])

    def _places(self, parts: list[str]) -> np.ndarray:
        """Where in ``ids`` those of each part begin (upper half) and how many they are (lower half)."""
        places = list(map(self.memo.get, parts))
        new, at = [k for k, x in enumerate(places) if x is None], self.used
        for short in (True, False):
            some = [k for k in new if (len(parts[k]) <= MEMO_LENGTH) is short]
            if not some:
                continue
            names = [parts[k] for k in some]
            ids, begins, sizes = self.new(names)
            end = at + len(ids)
            if end > len(self.ids) or len(self.ids) > 4 * end + (1 << 20):
                self.ids = np.append(self.ids[:at], np.empty(len(ids) + at // 4, "<u4"))
            self.ids[at:end] = ids
            found = (begins + at << 32 | sizes).tolist()
            for k, x in zip(some, found, strict=True):
                places[k] = x
            at = end
            if short and self._remember(names, found, sizes):
                self.used = end
        return np.array(places, np.int64)

    def _remember(self, names: list[str], found: list[int], sizes: np.ndarray) -> bool:
        """Keep as many as there is room for; whether any are kept. From the first without room on, none are."""
        memo = self.memo
        upto = np.cumsum(np.array(list(map(len, names))) + 4 * sizes + memo.ENTRY)
        n = int(np.searchsorted(upto, memo.room, "right"))
        memo.update(zip(names[:n], found[:n], strict=True))
        memo.room = memo.room - int(upto[-1]) if n == len(names) else 0
        return n > 0
