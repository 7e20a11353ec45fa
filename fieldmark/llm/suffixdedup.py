"""Repeated byte strings, found with run-length compressed suffix indexes.

A byte goes if some ``span``-byte string that covers it also starts earlier (smaller
id, or same document and earlier start). Every window of ``span`` bytes belongs to
its minimizer, the least hash of its k-grams; consecutive windows of one minimizer
form one stretch of text. Equal windows have equal minimizers, so:

1. Stretches are dealt by minimizer, as hashes only. Of equal stretches all but the
   first go; that needs no text. Each task collapses its own first, so that a group
   of copies or a common line sends few rows.
2. Where one minimizer stands in different stretches, their text is fetched. Of each
   group of stretches the earlier half is indexed: the Burrows-Wheeler transform,
   run-compressed, with the text position sampled at each run's ends. The later half
   streams past it from right to left: matching statistics, the length of the longest
   match that begins at each byte and a place of it. Where the next byte is not that of the
   row's run, the match goes on from the nearest run of that byte above or below, at the
   position sampled there, whichever agrees longer with the text. Matches of ``span`` bytes
   or more are marked. The halves are then halved in turn, without what is marked already,
   so an index holds text of which little repeats. Groups share indexes side by side.
3. Each document's marked bytes are united and cut out.

Where a minimizer stands in too many different stretches, their windows are settled like
equal stretches: single windows are either equal or not, so their hashes of 128 bits say it
all. No text of theirs travels, and no index grows with the number of copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import named, saved

SPAN, GRAM = 100, 32
#: Bytes hashed at once, bytes of an index, stretches and their bytes from which a minimizer is settled by windows, windows settled at once.
PIECE, INDEX_BYTES, HOT, HOT_BYTES, LOT = 1 << 20, 2 << 20, 128, 1 << 20, 200_000
_PLACE = np.uint64((1 << 21) - 1)
NO_ID = -(1 << 63)
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def stretches(data: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``minimizer, hash, start, length`` of the stretches that cover all windows of ``data``."""
    n = len(data) - span + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none
    g = _BYTE[data]
    h, size, power = g, 1, int(_R)
    while size < gram:
        h, size, power = h[:-size] * np.uint64(power) + h[size:], 2 * size, power * power % (1 << 64)
    # ties go to the leftmost gram, so that equal windows never share a stretch
    h = _mix(h)
    m, width, size = h & ~_PLACE | np.arange(len(h), dtype=np.uint64), span - gram + 1, 1
    while 2 * size <= width:
        m, size = np.minimum(m[:-size], m[size:]), 2 * size
    if width > size:
        m = np.minimum(m[: len(m) - (width - size)], m[width - size :])
    m &= _PLACE
    new = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    lengths = np.diff(np.append(new, n))
    length = lengths + span - 1
    powers = np.full(len(data) + 1, _R, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    inverse = np.full(len(data) + 1, _R_INV, np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(g * powers[:-1], dtype=np.uint64)])
    return h[m[new].astype(np.int64)], _mix((sums[new + length] - sums[new]) * inverse[new] + length.astype(np.uint64)), new, length


class RunIndex:
    """Run-length compressed index of some strings, each closed by a mark.

    Of the suffix order only the runs of the transform are kept, with the text position
    at each run's first and last row; the text itself serves to compare two places.
    """

    def __init__(self, strings: list[bytes]) -> None:
        self.text = _marked_text(strings)
        order = self._suffixes(self.text)
        bwt = self.text[order - 1].astype(np.int64)
        self.start = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        self.symbol = bwt[self.start]
        size = np.diff(np.append(self.start, len(bwt)))
        self.end = self.start + size - 1
        self.first_sample, self.last_sample = order[self.start], order[self.end]
        # rows of smaller symbols, and of a run's symbol before it: what an LF step adds to
        self.by_symbol = np.lexsort((self.start, self.symbol))
        self.to = np.empty(len(size), np.int64)
        self.to[self.by_symbol] = np.cumsum(size[self.by_symbol]) - size[self.by_symbol]
        self.keys = self.symbol[self.by_symbol] * len(size) + self.by_symbol
        self.words = _words(self.text)

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix order by prefix doubling."""
        n = len(text)
        key, depth = np.zeros(n, np.uint64), 6
        for k in range(depth):
            key = key * np.uint64(257)
            key[: n - k] += text[k:].astype(np.uint64)
        while True:
            order = np.argsort(key)
            ranked = key[order]
            number = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
            if number[-1] == n - 1:
                return order
            rank = np.empty(n, np.int64)
            rank[order] = number
            other = np.zeros(n, np.int64)
            other[: n - depth] = rank[depth:] + 1
            key, depth = rank * (n + 1) + other, 2 * depth

    def step(self, run: np.ndarray, row: np.ndarray) -> np.ndarray:
        """LF: the rows of the suffixes one symbol longer to the left."""
        return self.to[run] + row - self.start[run]

    def agreement(self, at: np.ndarray, words: np.ndarray, place: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Symbols, up to ``most``, in which the text from ``at`` agrees with a pattern from ``place``."""
        out, live, k = np.zeros(len(at), np.int64), np.flatnonzero(most > 0), 0
        while len(live):
            differ = self.words[np.minimum(at[live] + k, len(self.words) - 1)] ^ words[place[live] + k]
            low = (differ & (~differ + np.uint64(1))).astype(np.float64)
            out[live] = np.minimum(most[live], k + np.where(differ == 0, WORD, np.frexp(low)[1] - 1 >> 4))
            k += WORD
            live = live[(differ == 0) & (most[live] > k)]
        return out

    def statistics(self, patterns: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``pattern, offset, length, place`` for each byte of each pattern, right to left:
        the longest match that begins there and the text position of one such match."""
        text = _marked_text(patterns)
        words, left = _words(text), np.array([len(p) for p in patterns])
        begin = np.cumsum(left + 1) - left - 1
        row, length = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64)
        at = np.full(len(patterns), self.first_sample[0])
        runs, live = len(self.start), np.flatnonzero(left > 0)
        while len(live):
            place = begin[live] + left[live]
            symbol, r = text[place - 1].astype(np.int64), row[live]
            run = np.searchsorted(self.start, r, side="right") - 1
            miss = np.flatnonzero(self.symbol[run] != symbol)
            if len(miss):
                i, c, here, most = live[miss], symbol[miss], place[miss], length[live[miss]]
                k = np.searchsorted(self.keys, c * runs + run[miss])
                below, above = np.minimum(k, runs - 1), np.maximum(k - 1, 0)
                has_below, has_above = (k < runs) & (self.keys[below] // runs == c), (k > 0) & (self.keys[above] // runs == c)
                below, above = self.by_symbol[below], self.by_symbol[above]
                n_below = np.where(has_below, self.agreement(self.first_sample[below], words, here, np.where(has_below, most, 0)), -1)
                n_above = np.where(has_above, self.agreement(self.last_sample[above], words, here, np.where(has_above, most, 0)), -1)
                up = n_above > n_below
                best = np.maximum(n_below, n_above)
                run[miss] = np.where(up, above, below)
                r[miss] = np.where(up, self.end[above], self.start[below])
                at[i] = np.where(up, self.last_sample[above], self.first_sample[below])
                length[i] = best
            row[live] = self.step(run, r)
            at[live] -= 1
            length[live] += 1
            left[live] -= 1
            found = length[live] > 0
            if not found.all():  # a byte that the text doesn't have
                gone = live[~found]
                row[gone], at[gone], length[gone] = 0, self.first_sample[0], 0
            yield live, left[live], length[live], at[live]
            live = live[left[live] > 0]


#: Symbols that are compared at once.
WORD = 4


def _marked_text(strings: list[bytes]) -> np.ndarray:
    """Bytes plus one, and 0 behind each string."""
    lengths = np.array([len(s) for s in strings])
    text, inside = np.zeros(int(lengths.sum()) + len(strings), np.uint16), np.ones(int(lengths.sum()) + len(strings), bool)
    inside[np.cumsum(lengths + 1) - 1] = False
    text[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + np.uint16(1)
    return text


def _words(text: np.ndarray) -> np.ndarray:
    wide = np.concatenate([text, np.zeros(WORD, np.uint16)]).astype(np.uint64)
    return wide[:-4] | wide[1:-3] << np.uint64(16) | wide[2:-2] << np.uint64(32) | wide[3:-1] << np.uint64(48)


def _window_hashes(texts: list[bytes], windows: np.ndarray, span: int) -> np.ndarray:
    """A hash of each window of each text, one text after the other."""
    lengths = windows + span - 1
    g = _BYTE[np.frombuffer(b"".join(texts), np.uint8)]
    power, inverse = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(g), x, np.uint64)])) for x in (_R, _R_INV))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(g * power[:-1], dtype=np.uint64)])
    begin = np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    return _mix((sums[begin + span] - sums[begin]) * inverse[begin])


def repeats(texts: list[bytes], group: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """``string, offset`` of each window whose bytes also stand in an earlier string of its group.

    ``group``: equal numbers side by side, strings in order of origin. No window of one
    string is in another group. A window whose hash no other one has can't be equal to any;
    of the others the index tells which are.
    """
    n = len(texts)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    rank = np.arange(n) - starts[number]
    windows = np.array([len(t) for t in texts]) - span + 1
    base = np.cumsum(windows) - windows
    hashes = _window_hashes(texts, windows, span)
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    open_ = np.zeros(len(hashes), bool)
    open_[order[1:][same]] = open_[order[:-1][same]] = True
    gone = np.zeros(len(hashes), bool)
    low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)  # of each string what is open lies between

    def bound(strings: np.ndarray) -> None:
        part = np.repeat(base[strings] - (np.cumsum(windows[strings]) - windows[strings]), windows[strings]) + np.arange(windows[strings].sum())
        at = np.flatnonzero(open_[part])
        of = np.searchsorted(np.cumsum(windows[strings]), at, side="right")
        offset = part[at] - base[strings][of]
        low[strings] = high[strings] = 0
        if len(at):
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            low[strings[of[first]]] = offset[first]
            high[strings[of[first]]] = offset[np.append(first[1:], len(of)) - 1] + 1

    bound(np.arange(n))
    for k in reversed(range(int(rank.max(initial=0)).bit_length())):
        block, late = rank >> (k + 1), (rank >> k & 1).astype(bool)
        live = low < high
        for b in np.unique(block[late & live]):
            right = np.flatnonzero((block == b) & late & (low < high))
            asked = np.zeros(len(starts), bool)
            asked[number[right]] = True
            left = np.flatnonzero((block == b) & ~late & (low < high) & asked[number])
            asked[:] = False
            asked[number[left]] = True
            right = right[asked[number[right]]]
            if not len(right):
                continue
            part = lambda i: texts[i][low[i] : high[i] + span - 1]
            for i, offset, length, _ in RunIndex([part(i) for i in left]).statistics([part(i) for i in right]):
                long = length >= span
                i = right[i[long]]
                gone[base[i] + low[i] + offset[long]] = True
            open_ &= ~gone
            bound(right)
    at = np.flatnonzero(gone)
    string = np.searchsorted(base, at, side="right") - 1
    return string, at - base[string]


def _pieces(texts: list[bytes], ids: np.ndarray, ties: np.ndarray, span: int) -> Iterator[tuple]:
    """``minimizer, hash, id, tie, start, length`` over documents, a piece at a time."""
    for text, i, t in zip(texts, ids.tolist(), ties.tolist(), strict=True):
        data = np.frombuffer(text, np.uint8)
        for at in range(0, len(data) - span + 1, PIECE):
            h, s, start, length = stretches(data[at : at + PIECE + span - 1], span)
            yield h, s, np.full(len(h), i), np.full(len(h), t), start + at, length


def _rows(h, s, id, tie, start, length, sure) -> pd.DataFrame:
    return pd.DataFrame({"h": h.view(np.int64), "s": s.view(np.int64), "id": id, "tie": tie, "at": start << 32 | length, "sure": sure})


STRETCHES = "h long, s long, id long, tie long, at long, sure boolean"


def _find(span: int):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """All stretches; those that equal an earlier one of the same lot are sure."""

        def lot(parts: list[tuple]) -> pd.DataFrame:
            h, s, i, t, start, length = (np.concatenate(x) for x in zip(*parts, strict=True))
            by = np.lexsort((start, t, i, s, h))
            h, s, i, t, start, length = (x[by] for x in (h, s, i, t, start, length))
            again = np.concatenate([[False], (h[1:] == h[:-1]) & (s[1:] == s[:-1])])
            first = np.maximum.accumulate(np.where(again, 0, np.arange(len(h))))
            same = again & (i == i[first]) & (t == t[first]) & (start == start[first])
            h = np.where(again, _mix(i.astype(np.uint64) + start.astype(np.uint64)), h)
            return _rows(h, s, i, t, start, length, again)[~same]

        parts, n = [], 0
        for pdf in batches:
            for x in _pieces(pdf["text"].tolist(), pdf["id"].to_numpy(), pdf["tie"].to_numpy(), span):
                parts.append(x)
                n += len(x[0])
                if n >= LOT:
                    yield lot(parts)
                    parts, n = [], 0
        if parts:
            yield lot(parts)

    return run


def _settle(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From stretches in order: those equal to an earlier one (sure) and, where a
    minimizer has different stretches, the first of each kind (to be looked at)."""
    last: pd.DataFrame | None = None  # the first stretch of the kind that is open
    shown = False  # whether it has been passed on
    for pdf in batches:
        sure = pdf["sure"].to_numpy()
        if sure.any():
            yield pdf[sure]
        pdf = pdf[~sure]
        if not len(pdf):
            continue
        if last is not None:
            pdf = pd.concat([last, pdf], ignore_index=True)
        h, s, i, t, at = (pdf[c].to_numpy() for c in ("h", "s", "id", "tie", "at"))
        same_h = np.concatenate([[False], h[1:] == h[:-1]])
        again = same_h & np.concatenate([[False], s[1:] == s[:-1]])
        first = np.maximum.accumulate(np.where(again, 0, np.arange(len(h))))
        repeat = again & ~((i == i[first]) & (t == t[first]) & (at == at[first]))
        if repeat.any():
            yield pdf[repeat].assign(sure=True)
        kinds = np.flatnonzero(~again)
        near = np.concatenate([[False], h[kinds[1:]] == h[kinds[:-1]]])  # the kind before has the same minimizer
        ask = near | np.concatenate([near[1:], [False]])
        if last is not None and shown:
            ask[0] = False
        if ask.any():
            yield pdf.iloc[kinds[ask]].assign(sure=False)
        shown = bool(ask[-1]) or (len(kinds) == 1 and last is not None and shown)
        last = pdf.iloc[[kinds[-1]]]


FETCHED = "h long, s long, id long, tie long, at long, text binary, sure boolean"


def _fetch(span: int):
    def windows(parts: list[tuple]) -> Iterator[pd.DataFrame]:
        """Windows as hashes of 128 bits; those that equal an earlier one of the same lot are sure, in runs."""
        digests, i, t, start = (np.concatenate(x) for x in zip(*parts, strict=True))
        h, s = digests[:, 0], digests[:, 1]
        by = np.lexsort((start, t, i, s, h))
        h, s, i, t, start = (x[by] for x in (h, s, i, t, start))
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (s[1:] == s[:-1])])
        yield pd.DataFrame({"h": h[~again], "s": s[~again], "id": i[~again], "tie": t[~again], "at": start[~again] << 32 | span, "text": None, "sure": False})
        i, t, start = i[again], t[again], start[again]
        if len(i):
            by = np.lexsort((start, t, i))
            i, t, start = i[by], t[by], start[by]
            at = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (t[1:] != t[:-1]) | (start[1:] != start[:-1] + 1)]))
            length = np.diff(np.append(at, len(i))) - 1 + span
            i, t, start = i[at], t[at], start[at]
            spread = _mix(i.astype(np.uint64) + start.astype(np.uint64)).view(np.int64)
            yield pd.DataFrame({"h": spread, "s": 0, "id": i, "tie": t, "at": start << 32 | length, "text": None, "sure": True})

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The text of stretches; a crowded minimizer's as hashes of its windows."""
        parts, n = [], 0
        for pdf in batches:
            out, size = [], 0
            for i, t, text, asked in zip(pdf["id"], pdf["tie"], pdf["text"], pdf["asked"], strict=True):
                for a in asked:
                    start, length = a["at"] >> 32, a["at"] & 0xFFFFFFFF
                    if a["crowded"]:
                        at = np.arange(start, start + length - span + 1, dtype=np.int64)
                        digests = b"".join(hashlib.blake2b(text[k : k + span], digest_size=16).digest() for k in at.tolist())
                        parts.append((np.frombuffer(digests, np.int64).reshape(-1, 2), np.full(len(at), i), np.full(len(at), t), at))
                        n += len(at)
                        if n >= LOT:
                            yield from windows(parts)
                            parts, n = [], 0
                    else:
                        out.append((a["h"], 0, i, t, a["at"], text[start : start + length], False))
                        size += length
                        if size > 1 << 23:
                            yield pd.DataFrame(out, columns=["h", "s", "id", "tie", "at", "text", "sure"])
                            out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=["h", "s", "id", "tie", "at", "text", "sure"])
        if parts:
            yield from windows(parts)

    return run


def _index(span: int):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Marked runs of bytes: of equal windows all but the first, else from an index over whole groups of stretches."""

        def marked(parts: list[pd.DataFrame]) -> pd.DataFrame:
            pdf = pd.concat(parts, ignore_index=True)
            string, offset = repeats(pdf["text"].tolist(), pdf["h"].to_numpy(), span)
            new = np.concatenate([[True], (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1)]) if len(string) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(string)) - 1
            own = pdf.iloc[string[at]]
            return pd.DataFrame({"id": own["id"].to_numpy(), "tie": own["tie"].to_numpy(), "at": (own["at"].to_numpy() >> 32) + offset[at] << 32 | offset[last] - offset[at] + span})

        held, size, key, window = [], 0, None, None
        for pdf in batches:
            hashed, sure = pdf["text"].isna().to_numpy(), pdf["sure"].to_numpy()
            if hashed.any():
                open_ = pdf[hashed & ~sure]
                h, s = open_["h"].to_numpy(), open_["s"].to_numpy()
                again = np.concatenate([[False], (h[1:] == h[:-1]) & (s[1:] == s[:-1])]) if len(h) else np.zeros(0, bool)
                if len(h):
                    again[0], window = (h[0], s[0]) == window, (h[-1], s[-1])
                yield pd.concat([pdf[hashed & sure], open_[again]])[["id", "tie", "at"]]
                pdf = pdf[~hashed]
                if not len(pdf):
                    continue
            h, n = pdf["h"].to_numpy(), pdf["text"].str.len().to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(pdf)], strict=True):
                if size >= INDEX_BYTES and key != h[a]:
                    yield marked(held)
                    held, size = [], 0
                held.append(pdf.iloc[a:b])
                size += int(n[a:b].sum())
                key = h[a]
        if held:
            yield marked(held)

    return run


def _cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for i, t, text, spans in zip(pdf["id"], pdf["tie"], pdf["text"], pdf["spans"], strict=True):
            kept, n_removed, n_spans = text, 0, 0
            if spans is not None and len(spans):
                at = np.asarray(spans, np.int64)
                start, length = at >> 32, at & 0xFFFFFFFF
                change = np.bincount(start, minlength=len(text) + 1) - np.bincount(start + length, minlength=len(text) + 1)
                gone = np.cumsum(change)[: len(text)] > 0
                n_removed, n_spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            rows.append((i, t, len(text), n_removed, n_spans, kept))
        yield pd.DataFrame(rows, columns=["id", "tie", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", span: int = SPAN, hot: int = HOT) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept`` (binary) of every row.

    A null text is empty; a null id comes before all others. Texts of any length are
    searched whole, a piece at a time. Rows alike in id and text
    are one document and share its result; rows of equal id and other text are told
    apart and ordered by a hash of the text. Texts shorter than ``span`` stay whole. An
    empty table gives an empty result. Columns other than the two are not read.
    """
    if span < GRAM:
        raise ValueError(f"span must be {GRAM} bytes or more")
    rows = docs.select(F.coalesce(named(id).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(named(text).cast("binary"), F.lit(b"")).alias("text"))
    alike = rows.groupBy("id").count().where("count > 1").limit(1).count()
    rows = rows.withColumn("tie", F.xxhash64("text") if alike else F.lit(0).cast("long")).select("id", "tie", "text")
    found = rows.where(F.octet_length("text") >= span).mapInPandas(_find(span), STRETCHES)
    order = ["h", "s", "id", "tie", "at"]
    settled = saved(found.repartition("h").sortWithinPartitions(*order).mapInPandas(_settle, STRETCHES))
    asked = settled.where("not sure")
    many = (F.count("*") > hot) | (F.sum(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))) > HOT_BYTES)
    crowded = asked.groupBy("h").agg(many.alias("crowded")).where("crowded")
    asked = asked.join(crowded, "h", "left").groupBy("id", "tie").agg(F.collect_list(F.struct("h", "at", F.coalesce("crowded", F.lit(False)).alias("crowded"))).alias("asked"))
    texts = rows.dropDuplicates() if alike else rows
    fetched = texts.join(asked, ["id", "tie"]).mapInPandas(_fetch(span), FETCHED)
    ordered = fetched.repartition("h", "s").sortWithinPartitions("h", "s", "id", "tie", "at")
    marked = saved(ordered.mapInPandas(_index(span), "id long, tie long, at long"))
    spans = settled.where("sure").select("id", "tie", "at").unionByName(marked)
    spans = spans.groupBy("id", "tie").agg(F.collect_list("at").alias("spans"))
    out = rows.join(spans, ["id", "tie"], "left").mapInPandas(_cut, "id long, tie long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id), "n_bytes", "n_removed", "n_spans", "kept")
