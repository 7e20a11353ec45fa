"""Every registered query of the core against its SQL, at the smallest scale."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from fieldmark.queries import ORACLE_SQL, QUERIES

SLOW = {"mice_comparison", "deidentified", "breusch_pagan_sensitivity"}


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return round(v, 4)
    return v


def rows(pdf):
    return sorted(str(tuple(str(cell(v)) for v in r)) for r in pdf[sorted(pdf.columns)].astype(object).to_numpy())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in ORACLE_SQL:
        assert len(got.columns)
        return
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part", "customer", "documents", "events", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert rows(got) == rows(con.sql(ORACLE_SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(("name", "module", "operator"), [("mediation_price", "mediate", "mediation"), ("mice_comparison", "impute", "mice")])
def test_production_sizes(spark, sf, monkeypatch, name, module, operator):
    """The operator's own replicates, sets and sweeps are used."""
    from fieldmark import queries

    def caught(*args, **sizes):
        raise LookupError(sorted(sizes))

    monkeypatch.setattr(getattr(queries, module), operator, caught)
    with pytest.raises(LookupError, match=r"^\[\]$"):
        QUERIES[name](spark, sf)
