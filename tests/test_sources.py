"""Files read by ranges, against one-task readers."""

import random

import pytest
from pyspark.sql import functions as F

from fieldmark.sources import ranges, tables


@pytest.fixture
def small_ranges(spark):
    """Ranges of a few lines."""
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")

    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))

    yield cut
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def made_up(seed, rows, end="\n", sep=","):
    rng = random.Random(seed)
    parts = ["a", "é", "王", '""', ",", ";", "\n", "\n\n", "\r\n", " ", "x y", "12", "\t", "NAN"]
    out = ["id,text,note".replace(",", sep)]
    for i in range(rows):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        note = rng.choice(["plain", '5" pipe', "", "b c", '"q"', ' "led" ', "x" * rng.randrange(90)])
        out.append(f'{i}{sep}"t{text}"{sep}{note}')
    return end.join(out) + rng.choice(["", end])


def rows(df):
    return sorted(map(tuple, df.select(*[F.col(f"`{c}`").cast("string") for c in df.columns]).collect()), key=repr)


@pytest.mark.parametrize(("seed", "size", "end", "encoding"), [(1, 40, "\n", "utf-8"), (2, 97, "\r\n", "utf-8"), (3, 300, "\n", "gb18030"), (4, 61, "\n", "gb18030"), (5, 10**6, "\r\n", "utf-8")])
def test_ranges_as_one_task(spark, tmp_path, small_ranges, seed, size, end, encoding):
    text = made_up(seed, 50, end)
    (tmp_path / "a.csv").write_bytes(text.encode(encoding, "replace"))
    path = f"file://{tmp_path}/a.csv"
    tables.allow_charsets(spark)
    whole = spark.read.options(header=True, multiLine=True, escape='"', encoding=encoding, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, **({} if end == "\r\n" else {"lineSep": end})).csv(path)
    want = rows(whole)
    small_ranges(size)
    names, got = ranges.read_delimited(spark, path, ",")
    assert names == ["id", "text", "note"]
    # where lines end in \r\n, the one-task reader makes those inside quotes \n
    assert [tuple(c and c.replace("\r\n", "\n") for c in r) for r in rows(got)] == [tuple(c and c.replace("\r\n", "\n") for c in r) for r in want]
    assert len(want) == 50
    if size < 1000:
        assert ranges.scan(spark, path).count() > 3


def test_ranges_of_several_files(spark, tmp_path, small_ranges):
    """Each file has its own encoding, byte order mark and header; quotes never run on into the next file."""
    (tmp_path / "d.csv").mkdir()
    one, two = "\n".join(f'{i},"王\n{i}"' for i in range(40)), "\n".join(f"{i},乙{i}" for i in range(40, 70))
    (tmp_path / "d.csv/1.csv").write_bytes(("﻿id,名\n" + one).encode())
    (tmp_path / "d.csv/2.csv").write_bytes(("id,名\n" + two).encode("gb18030"))
    (tmp_path / "d.csv/3.csv").write_bytes(b'id,x\n80,"never closed\n81,b\n')
    small_ranges(50)
    df = tables.read_table(spark, f"file://{tmp_path}/d.csv", clean=False)
    got = {r["id"]: r["名"] for r in df.collect()}
    want = {i: f"王\n{i}" for i in range(40)} | {i: f"乙{i}" for i in range(40, 70)}
    assert {k: v for k, v in got.items() if k < 80} == want and got[80].startswith("never closed")
    assert dict(df.dtypes)["id"] == "bigint"


def test_types_and_missing_cells(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a;b;c;d;e;f\n1;1.5;True;x;NA;\n;2e3;false;007;null;\n+3;.5;;;n/a;\n\n 4 ; -1. ;TRUE;\"NA\";NULL; \n")
    df = tables.read_table(spark, f"file://{tmp_path}/t.csv")
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "boolean", "d": "string"}
    assert [tuple(r) for r in df.orderBy("b").collect()] == [(4, -1.0, True, None), (3, 0.5, None, None), (1, 1.5, True, "x"), (None, 2000.0, False, "007")]
    (tmp_path / "tab.tsv").write_text('a\tb\n1\t"x\ty\nz"\n')
    assert tables.read_table(spark, f"file://{tmp_path}/tab.tsv").first()[1] == "x\ty\nz"
    (tmp_path / "none.csv").write_text("")
    assert tables.read_table(spark, f"file://{tmp_path}/none.csv", clean=False).count() == 0
    (tmp_path / "head.csv").write_text("a,b\n")
    head = tables.read_table(spark, f"file://{tmp_path}/head.csv")
    assert head.columns == ["a", "b"] and head.count() == 0
    (tmp_path / "bad.csv").write_bytes(b"a,b\n1,\xff\xfe\x81\n")
    assert tables.read_table(spark, f"file://{tmp_path}/bad.csv").first()["b"].startswith("�")


def test_numbered_lines(spark, tmp_path, small_ranges):
    text = "﻿" + "".join(f"行{i}" + ["\n", "\r\n", "\r", "\n\n"][i % 4] for i in range(120)) + "末"
    (tmp_path / "x.txt").write_bytes(text.encode())
    (tmp_path / "y.txt").write_bytes(text[1:].encode("gb18030"))
    import re

    want = re.split(r"\r\n|\r|\n", text[1:])
    small_ranges(77)
    got = tables.read_transcripts(spark, f"file://{tmp_path}").orderBy("path", "line_no").collect()
    assert [r["line"] for r in got] == want * 2
    assert [r["line_no"] for r in got] == [*range(len(want))] * 2


def test_open_quotes_are_found(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "MOST_RECORD", 100)
    (tmp_path / "o.csv").write_text('a,b\n1,"' + "x\n" * 200)
    state = ranges.splitter(b",")
    assert state(b'1,"x', False) and not state(b'y",2', True) and state(b'y",2,"', True)
    assert not state(b'5" pipe,"" , "a""b"', False) and state(b'"" x,"', False) and not state(b'"a"b"c', False)


def test_marks_compose(spark):
    """Each range's first state, against walking from range to range."""
    rng = random.Random(9)
    data, want = [], {}
    for f in range(30):
        state, before = False, 0
        for k in range(rng.randrange(1, 12)):
            out, inside, n = rng.random() < 0.5, rng.random() < 0.5, rng.randrange(5)
            data.append((f"f{f}", k * 10, 10, out, inside, n, f % 3 != 0, f % 5 != 0, False))
            want[f"f{f}", k * 10] = (state, before, "utf-8" if f % 3 or not f % 5 else "gb18030")
            state, before = inside if state else out, before + n
    got = ranges.marked(spark.createDataFrame(data, ranges.SCANNED).repartition(5)).collect()
    assert {(r.path, r.start): (r.opened, r.before, r.encoding) for r in got} == want


def test_many_ranges_are_joined_by_a_shuffle(spark, tmp_path, small_ranges, monkeypatch):
    (tmp_path / "a.csv").write_text(made_up(7, 30))
    path = f"file://{tmp_path}/a.csv"
    small_ranges(50)
    want = rows(ranges.read_delimited(spark, path, ",")[1])
    monkeypatch.setattr(ranges, "MOST_RANGES", 0)
    assert rows(ranges.read_delimited(spark, path, ",")[1]) == want
