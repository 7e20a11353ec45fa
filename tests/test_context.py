"""Runs with broken plug-ins, logs without extra jobs, and the order of labels."""

import sys

import pytest
from pyspark.sql import functions as F

from fieldmark.functions.columns import label_order
from fieldmark.plans import registry
from fieldmark.plans.analyze import Result, Spec
from fieldmark.plans.context import Run


def test_run(spark, tmp_path, monkeypatch):
    (tmp_path / "good_plug.py").write_text("from fieldmark.plans.registry import procedure\nfrom fieldmark.plans.analyze import Result\n@procedure('good')\ndef good(df, spec):\n    return Result('good', None, {'n': df.count()})\n")
    (tmp_path / "bad_plug.py").write_text("import nothing_like_this\n")
    monkeypatch.setattr(sys, "path", [str(tmp_path), *sys.path])
    monkeypatch.setattr(registry, "_known", dict(registry._known))
    run = Run(spark)
    run.plug_in(["bad_plug", "good_plug"])
    registry.procedure("fails")(lambda df, spec: 1 / 0)
    registry.procedure("lacks", ("mediator",))(lambda df, spec: Result("x", None, {}))
    df = spark.createDataFrame([(1, "a"), (2, None), (None, None)], "`x.y` long, s string")
    assert run.run_all(df, Spec(), ["good", "fails", "lacks"])["good"].values == {"n": 3}
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("saving", "saving")
    back = run.save(df, "table", f"file://{tmp_path}/t")
    assert len(jobs.getJobIdsForGroup("saving")) <= 1 and back.count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        run.save(df, "again", f"file://{tmp_path}/t")
    got = {r.step: (r.state, r.rows, r.nulls) for r in run.log().collect()}
    assert got == {"bad_plug": ("broken", None, None), "good": ("done", None, None), "fails": ("failed", None, None), "lacks": ("skipped", None, None), "table": ("done", 3, {"x.y": 1, "s": 2}), "again": ("failed", None, None)}


def test_label_order(spark):
    labels = ["张伟", "10", "9", None, "上海", "阿里", "1.5", "-2", "Zeta", "北京", "100"]
    df = spark.createDataFrame([(x,) for x in labels], "v string").repartition(3)
    got = [r.v for r in df.orderBy(*label_order(F.col("v"))).collect()]
    assert got[:5] == ["-2", "1.5", "9", "10", "100"] and got[-1] is None
    assert [x for x in got[5:-1] if x != "Zeta"] == ["阿里", "北京", "上海", "张伟"]
