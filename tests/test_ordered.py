"""Differences in order, against dynamic programming."""

import random

from fieldmark.plans import ordered


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t


def test_common_is_longest():
    rng = random.Random(1)
    for _ in range(600):
        k = rng.randrange(1, 6)
        a, b = ([rng.randrange(k) for _ in range(rng.randrange(25))] for _ in range(2))
        got = ordered.common(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p < r and q < s for (p, q), (r, s) in zip(got, got[1:]))
        t = lcs(a, b)
        assert len(got) == t[-1][-1] and ordered._row(a, b) == t[-1]


def test_anchors_are_the_longest_run():
    rng = random.Random(2)
    for _ in range(300):
        p = rng.sample(range(30), rng.randrange(12))
        got = [p[i] for i in ordered.increasing(p)]
        assert got == sorted(got) and len(got) == lcs(p, sorted(p))[-1][-1]


def test_changes():
    rng = random.Random(3)
    for _ in range(400):
        old, new = ([rng.choice("abcdefghijklmnop"[: rng.randrange(2, 17)]) for _ in range(rng.randrange(20))] for _ in range(2))
        got = ordered.changes(old, new)
        gone = {i for _, _, i, _ in got if i is not None}
        come = {j for _, _, _, j in got if j is not None}
        # what stays is equal on both sides, in order; what is moved is equal; nothing both removed and added
        assert [x for i, x in enumerate(old) if i not in gone] == [x for j, x in enumerate(new) if j not in come]
        assert all(old[i] == line == new[j] for c, line, i, j in got if c == "moved")
        assert not {x for c, x, *_ in got if c == "removed"} & {x for c, x, *_ in got if c == "added"}
        # between anchors, as many lines stay as dynamic programming keeps
        once = [x for x in old if old.count(x) == 1 and new.count(x) == 1]
        run = [once[k] for k in ordered.increasing([new.index(x) for x in once])]
        want, a, b = len(run), old, new
        for x in [*run, None]:
            i, j = (a.index(x), b.index(x)) if x is not None else (len(a), len(b))
            want += lcs(a[:i], b[:j])[-1][-1]
            a, b = a[i + 1 :], b[j + 1 :]
        assert len(old) - len(gone) == want
    assert ordered.changes(list("abc"), list("cab")) == [("moved", "c", 2, 0)]


def test_long_texts_take_no_square(spark):
    import time

    rng = random.Random(4)
    old = [str(rng.randrange(300)) for _ in range(6000)]
    new = [str(rng.randrange(300)) for _ in range(6000)]
    began = time.time()
    ordered.changes(old, new)
    assert time.time() - began < 60
    docs = [(1, "a\nb\r\nc"), (2, None), (3, "x"), (None, "n"), (5, ""), (6, "same")]
    other = [(1, "c\na\nd"), (2, "new"), (4, "y\ny"), (5, None), (6, "same")]
    got = ordered.ordered_diff(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(other, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.change, r.line, r.old_no, r.new_no) for r in got} == {(None, "removed", "n", 0, None), (1, "added", "d", None, 2), (1, "moved", "a", 0, 1), (1, "removed", "b", 1, None), (2, "added", "new", None, 0), (3, "removed", "x", 0, None), (4, "added", "y", None, 0), (4, "added", "y", None, 1), (5, "removed", "", 0, None)}
