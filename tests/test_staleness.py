"""Results that are out of date, in a diamond of needs."""

import os

import pytest

from fieldmark.plans import report
from fieldmark.plans.staleness import Artifact, states
from fieldmark.sources import tables


def test_diamond(spark, tmp_path):
    """a is needed by b and c, both by d; every touch makes what lies behind it stale."""
    at = {}

    def touch(name, second):
        at[name] = second
        (tmp_path / name).mkdir(exist_ok=True)
        for part in ("0", "1"):
            (tmp_path / name / part).write_text("x")
            os.utime(tmp_path / name / part, (second, second))

    path = lambda n: f"file://{tmp_path}/{n}"
    graph = [Artifact("d", [path("d")], ["b", "c"]), Artifact("b", [path("b")], ["a"]), Artifact("c", [path("c")], ["a"]), Artifact("a", [path("a")], [path("raw")])]

    def found():
        return {r.name: (r.done, r.stale, r.because) for r in states(spark, graph).collect()}

    for k, name in enumerate(("raw", "a", "b", "c", "d")):
        touch(name, 1000 + k)
    assert all(done and not stale for done, stale, _ in found().values())
    expected = {"raw": "abcd", "a": "bcd", "b": "d", "c": "d", "d": ""}
    for name, behind in expected.items():
        for k, n in enumerate(("raw", "a", "b", "c", "d")):
            touch(n, 2000 + k)
        touch(name, 3000)
        assert {n for n, (_, stale, _) in found().items() if stale} == set(behind)
    touch("c", 2003)
    touch("d", 2004)
    os.utime(tmp_path / "d" / "1", (1500, 1500))  # one old file is enough
    assert found()["d"] == (True, True, ["b", "c"])
    touch("d", 2004)
    for part in ("0", "1"):
        (tmp_path / "b" / part).unlink()
    got = found()
    assert got["b"] == (False, False, []) and got["d"] == (True, True, ["b"]) and not got["c"][1]
    with pytest.raises(ValueError, match="circle"):
        states(spark, [Artifact("x", [], ["y"]), Artifact("y", [], ["x"])])
    with pytest.raises(ValueError, match="one name"):
        states(spark, [Artifact("x", []), Artifact("x", [])])
    assert report.stale(spark, [path("raw")], path("nothing")) and report.stale(spark, [path("d")], path("c")) and not report.stale(spark, [path("raw"), path("nothing")], path("d"))
    with pytest.raises(Exception, match="(?i)scheme|filesystem"):  # a store that can't be read is no missing file
        report.stale(spark, [path("raw")], "nowhere://x/y")


def test_version_labels(spark, tmp_path):
    folder = f"file://{tmp_path}"
    first, second = (tables.write_table(spark.range(k), folder, "t").rsplit("/", 1)[1] for k in (1, 2))
    assert [(r.version, r.label) for r in report.versions(spark, folder, "t").collect()] == [(second, None), (first, None)]
    report.label_version(spark, folder, "t", first, "draft", "to be checked")
    report.label_version(spark, folder, "t", first, "final")
    assert [(r.label, r.note) for r in report.versions(spark, folder, "t").collect()] == [(None, None), ("final", "to be checked")]
    with pytest.raises(ValueError, match="no version"):
        report.label_version(spark, folder, "t", "v0")
