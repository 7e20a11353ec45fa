"""Differences of texts in the order of their lines.

Lines that both sides hold exactly once are anchors where they come in the same order: the
longest increasing run of their places, found by patience sorting. Between two anchors the
rest is aligned by a longest common subsequence, by halving one side over bit-parallel rows, so that
memory grows with the lines and no gap is too long. Lines that one side lost and the
other gained are moved, not removed and added.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.columns import col

LINE_BREAK = r"\r\n|\r|\n"


def increasing(places: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence of distinct numbers, by patience sorting."""
    tops: list[int] = []  # smallest last number of a run of each length
    at: list[int] = []
    before: list[int] = []
    for i, x in enumerate(places):
        k = bisect_left(tops, x)
        before.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(x)
            at.append(i)
        else:
            tops[k], at[k] = x, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _row(a: list[int], b: list[int]) -> list[int]:
    """Lengths of the longest common subsequences of ``a`` and each beginning of ``b``: the bits of a
    number stand for places of ``b``, and a zero is where the length goes up by one."""
    where: dict[int, int] = defaultdict(int)
    for j, x in enumerate(b):
        where[x] |= 1 << j
    every = (1 << len(b)) - 1
    v = every
    for x in a:
        m = where.get(x, 0) & v
        v = ((v + m) | (v - m)) & every
    out, n = [0], 0
    for bit in bin(v | 1 << len(b))[:2:-1]:
        n += bit == "0"
        out.append(n)
    return out


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence in both lists (Hirschberg)."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            out.append((k, m))
        if i == k or j == m:
            continue
        if k - i == 1:
            if a[i] in b[j:m]:
                out.append((i, b.index(a[i], j, m)))
            continue
        half = (i + k) // 2
        head, tail = _row(a[i:half], b[j:m]), _row(a[half:k][::-1], b[j:m][::-1])
        cut = max(range(m - j + 1), key=lambda x: head[x] + tail[m - j - x])
        todo += [(i, half, j, j + cut), (half, k, j + cut, m)]
    return sorted(out)


def aligned(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """Places of the lines that stay: the anchors, and what is common between them."""
    codes: dict[str, int] = {}
    a, b = ([codes.setdefault(x, len(codes)) for x in side] for side in (old, new))
    once_a, once_b = Counter(a), Counter(b)
    at = {x: j for j, x in enumerate(b) if once_b[x] == 1}
    both = [(i, at[x]) for i, x in enumerate(a) if once_a[x] == 1 and x in at]
    anchors = [both[k] for k in increasing([j for _, j in both])]
    out, i, j = [], 0, 0
    for x, y in [*anchors, (len(a), len(b))]:
        out += [(i + p, j + q) for p, q in common(a[i:x], b[j:y])]
        if x < len(a):
            out.append((x, y))
        i, j = x + 1, y + 1
    return out


def changes(old: list[str], new: list[str]) -> list[tuple[str, str, int | None, int | None]]:
    """``change, line, old_no, new_no``: of equal lines lost and gained, the first ones are moved."""
    stay = aligned(old, new)
    kept_old, kept_new = {i for i, _ in stay}, {j for _, j in stay}
    gained = defaultdict(list)
    for j, x in enumerate(new):
        if j not in kept_new:
            gained[x].append(j)
    out, taken = [], set()
    for i, x in enumerate(old):
        if i in kept_old:
            continue
        if gained[x]:
            j = gained[x].pop(0)
            taken.add(j)
            out.append(("moved", x, i, j))
        else:
            out.append(("removed", x, i, None))
    return out + [("added", x, None, j) for j, x in enumerate(new) if j not in kept_new and j not in taken]


def ordered_diff(old: DataFrame, new: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``change, id, line, old_no, new_no``: lines removed, added or moved, numbered from 0.

    Texts meet by one join on their ids and are compared where they meet, each whole. A text that one
    side lacks, or that is null there, has no lines. Ids must not repeat on a side.
    """
    sides = [docs.select(col(id).alias("id"), F.split(col(text), LINE_BREAK, -1).alias(n)) for docs, n in ((old, "old"), (new, "new"))]
    both = sides[0].join(sides[1], "id", "full").where(~F.col("old").eqNullSafe(F.col("new")))
    kind = both.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [changes(a or [], b or []) for a, b in zip(batch.column("old").to_pylist(), batch.column("new").to_pylist(), strict=True)]
            of = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64())
            rows = [r for rows in found for r in rows]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([columns[0], batch.column("id").take(of), *columns[1:]], names=["change", "id", "line", "old_no", "new_no"])

    return both.mapInArrow(run, f"change string, id {kind}, line string, old_no int, new_no int").withColumnRenamed("id", id)
