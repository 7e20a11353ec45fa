"""Workbooks (XLSX) and SPSS tables (SAV) without further packages.

Files come through Spark's own reader, so any store serves, and a folder is read by as many
tasks as it has files; neither format can be cut inside a file. A first pass gives the
columns of every file, a second its rows, in batches, so that no table is held whole.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows sent at once.
LOT = 5000
#: Numbers of Excel's built-in formats that are dates or times.
DATES = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _text(e: ElementTree.Element) -> str:
    """All text of a string item, phonetic readings aside."""
    runs = [e, *(r for r in e if _tag(r) == "r")]
    return "".join(t.text or "" for r in runs for t in r if _tag(t) == "t")


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _moment(days: float, from_1904: bool) -> str:
    """A serial number as ISO date, or date and time."""
    import datetime

    start = datetime.datetime(1904, 1, 1) if from_1904 else datetime.datetime(1899, 12, 30) if days >= 60 else datetime.datetime(1899, 12, 31)
    at = start + datetime.timedelta(seconds=round(days * 86400))
    return at.isoformat(" ") if at.time() != datetime.time() else at.date().isoformat()


def xlsx_rows(content: bytes, sheet: int | str = 0) -> Iterator[list[str | None]]:
    """Cells of one sheet row by row as text: numbers as they are written, dates in ISO form.

    ``sheet``: name, or place in the order of the tabs. Missing rows and cells come as nulls.
    """
    book = zipfile.ZipFile(io.BytesIO(content))
    names = set(book.namelist())
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    tabs = [(e.get("name"), next(v for k, v in e.attrib.items() if k.endswith("}id"))) for e in root.iter() if _tag(e) == "sheet"]
    places = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    from_1904 = any(_tag(e) == "workbookPr" and e.get("date1904") in ("1", "true") for e in root.iter())
    target = places[dict(tabs)[sheet] if isinstance(sheet, str) else tabs[sheet][1]]
    path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    shared = [_text(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    dated: list[bool] = []
    if "xl/styles.xml" in names:
        styles = ElementTree.fromstring(book.read("xl/styles.xml"))
        own = {int(e.get("numFmtId")): bool(re.search("[ymdhs]", re.sub(r'"[^"]*"|\\.|\[(?!h|m|s)[^\]]*\]', "", e.get("formatCode", "").lower()))) for e in styles.iter() if _tag(e) == "numFmt"}
        for xfs in (e for e in styles if _tag(e) == "cellXfs"):
            dated = [own.get(int(x.get("numFmtId", 0)), int(x.get("numFmtId", 0)) in DATES) for x in xfs]
    at = 0
    with book.open(path) as f:
        for _, e in ElementTree.iterparse(f):
            if _tag(e) != "row":
                continue
            no = int(e.get("r", at + 1))
            yield from ([] for _ in range(at + 1, no))
            at, cells = no, []
            for c in e:
                k = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (k + 1 - len(cells))
                kind, v = c.get("t", "n"), next((x for x in c if _tag(x) in ("v", "is")), None)
                if v is None or (v.text is None and kind != "inlineStr"):
                    continue
                style = int(c.get("s", 0))
                if kind == "s":
                    cells[k] = shared[int(v.text)]
                elif kind == "inlineStr":
                    cells[k] = _text(v)
                elif kind == "b":
                    cells[k] = "true" if v.text == "1" else "false"
                elif kind == "n" and style < len(dated) and dated[style]:
                    cells[k] = _moment(float(v.text), from_1904)
                elif kind != "e":
                    cells[k] = v.text
            e.clear()
            yield cells


def sav_rows(content: bytes, labels: bool = False) -> Iterator[list[str | None]]:
    """Names of an SPSS system file's variables, then its records as text.

    Plain and compressed (bytecode) files of either byte order; long names and long strings
    are put together. System-missing values and declared missing codes are null. ``labels``
    gives value labels in place of values.
    """
    file = memoryview(content)
    if bytes(file[:4]) != b"$FL2":
        raise ValueError("not a system file, or one compressed as a whole")
    order = "<" if struct.unpack("<i", file[64:68])[0] in (2, 3) else ">"
    packed, _, _, bias = struct.unpack(order + "iiid", file[72:92])
    if packed not in (0, 1):
        raise ValueError("not a plain or bytecode-compressed system file")
    at, slots, named, long_names, wide, encoding = 176, [], {}, {}, {}, "utf-8"

    def ints(n: int) -> tuple[int, ...]:
        nonlocal at
        at += 4 * n
        return struct.unpack(f"{order}{n}i", file[at - 4 * n : at])

    def take(n: int) -> bytes:
        nonlocal at
        at += n
        return bytes(file[at - n : at])

    while (kind := ints(1)[0]) != 999:
        if kind == 2:
            width, labelled, missing, _, _ = ints(5)
            name = take(8)
            if labelled:
                n = ints(1)[0]
                take(-(-n // 4) * 4)
            codes = [take(8) for _ in range(abs(missing))]
            slots.append((name, width, missing, codes))
        elif kind == 3:
            pairs = []
            for _ in range(ints(1)[0]):
                value, n = take(8), take(1)[0]
                pairs.append((value, take(-(-(n + 1) // 8) * 8 - 1)[:n]))
            _, n = ints(2)
            named |= {k - 1: dict(pairs) for k in ints(n)}
        elif kind == 6:
            take(80 * ints(1)[0])
        elif kind == 7:
            sub, size, n = ints(3)
            body = take(size * n)
            if sub == 20:
                encoding = body.decode("ascii").strip() or encoding
            elif sub in (13, 14):
                (long_names if sub == 13 else wide).update(x.split(b"=", 1) for x in body.replace(b"\0", b"").split(b"\t") if b"=" in x)
        else:
            raise ValueError(f"unknown record {kind}")
    at += 4

    def plain(raw: bytes) -> str:
        return raw.decode(encoding, "replace").rstrip(" \0")

    # variables: name, first slot, width (0: number) and, for long strings, the segments that follow
    columns, k = [], 0
    while k < len(slots):
        name, width = slots[k][0].rstrip(), slots[k][1]
        total = int(wide.get(name, b"0") or 0)
        segments = -(-total // 252) if total > 255 else 1
        parts = []
        for _ in range(segments):
            own = slots[k][1]
            parts.append((k, own))
            k += max(1, -(-own // 8))
        columns.append((long_names.get(name, name), parts, slots[parts[0][0]], named.get(parts[0][0], {})))
    yield [plain(c[0]) for c in columns]

    def octets() -> Iterator[bytes | None]:
        """Each slot's eight bytes; None is system-missing."""
        if not packed:
            for i in range(at, len(file) - 7, 8):
                yield bytes(file[i : i + 8])
            return
        i = at
        while i + 8 <= len(file):
            codes, i = bytes(file[i : i + 8]), i + 8
            for c in codes:
                if c == 252:
                    return
                if c == 253:
                    yield bytes(file[i : i + 8])
                    i += 8
                elif c == 254:
                    yield b"        "
                elif c == 255:
                    yield None
                elif c:
                    yield struct.pack(order + "d", c - bias)

    def number(raw: bytes) -> float:
        return struct.unpack(order + "d", raw)[0]

    lowest = -1.7976931348623157e308
    record: list[bytes | None] = []
    for slot in octets():
        record.append(slot)
        if len(record) < len(slots):
            continue
        row: list[str | None] = []
        for _, parts, (_, width, missing, codes), texts in columns:
            raw = record[parts[0][0]]
            if width == 0:
                x = number(raw) if raw is not None else lowest
                if missing < 0:
                    low, high = number(codes[0]), number(codes[1])
                    gone = low <= x <= high or (missing == -3 and x == number(codes[2]))
                else:
                    gone = any(x == number(c) for c in codes)
                if x == lowest or gone:
                    row.append(None)
                elif labels and raw in texts:
                    row.append(plain(texts[raw]))
                else:
                    row.append(str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x))
            else:
                whole = b"".join(b"".join(record[j] or b"" for j in range(first, first + max(1, -(-own // 8))))[: 252 if len(parts) > 1 and n < len(parts) - 1 else own] for n, (first, own) in enumerate(parts))
                if raw in codes and width <= 8:
                    row.append(None)
                elif labels and width <= 8 and raw in texts:
                    row.append(plain(texts[raw]))
                else:
                    row.append(plain(whole) or None)
        yield row
        record = []


def read_files(spark: SparkSession, path: str, rows_of: Callable[[bytes], Iterator[list[str | None]]]) -> tuple[list[str], DataFrame]:
    """Names of the columns, in the order of the first file by path and then of those that others
    add, and one string column ``c0, c1 ...`` for each. Rows without any value go."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def heads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                yield pa.RecordBatch.from_pylist([{"path": file, "names": _header(rows_of(content.as_buffer().to_pybytes()))}], pa.schema([("path", pa.string()), ("names", pa.list_(pa.string()))]))

    found = files.mapInArrow(heads, "path string, names array<string>").orderBy("path").collect()  # a row for each file
    names = list(dict.fromkeys(n for r in found for n in r["names"]))
    if not names:
        return [], spark.createDataFrame([], "c0 string")

    def body(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = rows_of(content.as_buffer().to_pybytes())
                own = _header(rows)
                where = [own.index(n) if n in own else None for n in names]
                lot: list[list[str | None]] = []
                for row in rows:
                    if any(x not in (None, "") for x in row):
                        lot.append([row[k] if k is not None and k < len(row) else None for k in where])
                    if len(lot) == LOT:
                        yield _batch(lot)
                        lot = []
                if lot:
                    yield _batch(lot)

    return names, files.mapInArrow(body, ", ".join(f"c{k} string" for k in range(len(names))))


def _header(rows: Iterator[list[str | None]]) -> list[str]:
    """The first row that has a value; names that repeat are numbered, blank ones too."""
    for row in rows:
        if any(row):
            out: list[str] = []
            for k, x in enumerate(row):
                name = (x or "").strip() or f"Unnamed: {k}"
                n = 1
                while name in out:
                    name, n = f"{(x or '').strip()}.{n}", n + 1
                out.append(name)
            return out
    return []


def _batch(lot: list[list[str | None]]) -> pa.RecordBatch:
    columns = list(zip(*lot, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=[f"c{k}" for k in range(len(columns))])


def read_workbooks(spark: SparkSession, path: str, sheet: int | str = 0) -> tuple[list[str], DataFrame]:
    return read_files(spark, path, lambda content: xlsx_rows(content, sheet))


def read_sav(spark: SparkSession, path: str, labels: bool = False) -> tuple[list[str], DataFrame]:
    return read_files(spark, path, lambda content: sav_rows(content, labels))
