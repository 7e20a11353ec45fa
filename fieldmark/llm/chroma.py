"""Chroma audio fingerprints of a media column, and alignment of recordings.

A recording (8-bit mono PCM in a binary column) is cut into overlapping frames;
each frame's spectrum folds into twelve pitch classes. Over the image of pitch
classes by time, sixteen rectangle filters are read from its integral image; each
response is one of four levels, and the sixteen levels pack into one 32-bit item for
each place of a window of sixteen frames. A window without sound yields no item.

Recordings that share items are aligned by a histogram of the items' offsets. At every
offset with a vote the bit errors over the overlap are verified: over all of it, or over
the best run of windows, so that a passage that two recordings share is found whatever else
they hold, also behind a cut. Since a match has less than one wrong bit an item on average, some
of its items are equal, and no offset without a vote can hold one (held tones aside, which
vote where they begin).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import named, saved

#: Samples a second, of a frame and between frames; lowest and highest pitch in Hz; frames of a window and of the smoothing.
RATE, FRAME, HOP, LOWEST, HIGHEST = 2756, 512, 128, 28.0, 1378.0
WINDOW, SMOOTH = 16, np.array([0.25, 0.75, 1.0, 0.75, 0.25], np.float32)
#: Frames transformed at once.
LOT = 4096
#: Ratios of a filter's two areas between its four levels: quartiles over broadband sound, in the order of ``filters``.
RATIOS = (
    (0.94, 0.99, 1.05),
    (1.17, 1.32, 1.46),
    (0.98, 1.00, 1.02),
    (0.96, 1.00, 1.04),
    (1.01, 1.09, 1.18),
    (0.97, 1.00, 1.03),
    (1.05, 1.07, 1.10),
    (1.07, 1.16, 1.25),
    (0.96, 1.00, 1.04),
    (0.95, 1.00, 1.05),
    (1.02, 1.13, 1.22),
    (0.99, 1.00, 1.01),
    (0.90, 0.94, 0.99),
    (0.89, 0.99, 1.09),
    (0.98, 1.00, 1.02),
    (0.96, 1.00, 1.04),
)
#: Bit errors of a match; overlapping windows of recordings that agree throughout, and windows of a shared run.
MOST_ERROR, LEAST_OVERLAP, LEAST_RUN = 0.03, 8, 24


def filters() -> list[tuple[int, int, int, int]]:
    """``kind, first pitch, pitches, frames`` of the sixteen filters, by rule."""
    out = []
    for k in range(16):
        height = (4, 6, 8, 12)[k % 4]
        out.append((k % 6, (5 * k) % (13 - height), height, (4, 8, 16, 12)[(k + k // 4) % 4]))
    return out


@lru_cache
def _pitches() -> np.ndarray:
    """Which of twelve classes each bin of a frame's spectrum adds to."""
    hz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    use = (hz >= LOWEST) & (hz <= HIGHEST)
    out = np.zeros((len(hz), 12), np.float32)
    note = np.round(12 * np.log2(np.where(use, hz, 440) / 440)).astype(int) % 12
    out[np.flatnonzero(use), note[use]] = 1
    return out


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames by pitch classes, smoothed over time and of length 1 each (or 0)."""
    need = FRAME + HOP * (WINDOW + len(SMOOTH) - 2)
    if len(samples) < need:
        samples = np.concatenate([samples, np.full(need - len(samples), 128, np.uint8)])
    n, hann = (len(samples) - FRAME) // HOP + 1, np.hanning(FRAME).astype(np.float32)
    out = np.empty((n, 12), np.float32)
    for at in range(0, n, LOT):
        k = min(LOT, n - at)
        part = (samples[at * HOP : (at + k - 1) * HOP + FRAME].astype(np.float32) - 128) / 128
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        spectrum = np.fft.rfft(frames * hann, axis=1)
        out[at : at + k] = (spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ _pitches()
    m = n - len(SMOOTH) + 1
    out = sum(w * out[k : k + m] for k, w in enumerate(SMOOTH))
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.where(size > 0.01, out / np.maximum(size, 1e-9), 0).astype(np.float32)


def fingerprint(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and packed items (unsigned 32-bit) of a recording's windows with sound."""
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    image = chroma(np.frombuffer(data, np.uint8))
    whole = np.zeros((len(image) + 1, 13), np.float64)
    whole[1:, 1:] = image.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)
    n = len(image) - WINDOW + 1

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        a, b = whole[t0 : t0 + n], whole[t1 : t1 + n]
        return b[:, p1] - b[:, p0] - a[:, p1] + a[:, p0]

    packed = np.zeros(n, np.uint32)
    for (kind, p, height, width), ratios in zip(filters(), RATIOS, strict=True):
        full = area(0, width, p, p + height)
        if kind == 0:  # this band against the mean of all
            part, rest = full, area(0, width, 0, 12) * (height / 12)
        elif kind == 1:  # lower half against upper half
            part = area(0, width, p, p + height // 2)
            rest = full - part
        elif kind == 2:  # first half against second half
            part = area(0, width // 2, p, p + height)
            rest = full - part
        elif kind == 3:  # opposite quarters
            part = area(0, width // 2, p, p + height // 2) + area(width // 2, width, p + height // 2, p + height)
            rest = full - part
        elif kind == 4:  # middle of the band against its borders
            part = area(0, width, p + height // 4, p + height - height // 4)
            rest = full - part
        else:  # middle of the time against its ends
            part = area(width // 4, width - width // 4, p, p + height)
            rest = full - part
        part, rest = part + 1, rest + 1
        level = sum((part > rest * x).astype(np.uint32) for x in ratios)
        packed = packed << np.uint32(2) | (level ^ level >> 1).astype(np.uint32)  # neighbours differ in one bit
    sound = area(0, WINDOW, 0, 12) > 0
    return np.flatnonzero(sound), packed[sound]


def aligned(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], offset: int, most_error: float = MOST_ERROR, least_overlap: int = LEAST_OVERLAP, least_run: int = LEAST_RUN) -> tuple[int, float]:
    """Matching windows and bit error of ``a`` against ``b`` begun ``offset`` windows later.

    All of the overlap if its error is low enough and it is long enough; else the run of
    windows that gains most over the highest error allowed, if long enough; else no windows.
    """
    _, p, q = np.intersect1d(a[0], b[0] + offset, assume_unique=True, return_indices=True)
    wrong = np.bitwise_count(a[1][p] ^ b[1][q]) / 32
    if len(wrong) >= least_overlap and wrong.mean() <= most_error:
        return len(wrong), float(wrong.mean())
    if len(wrong) < least_run:
        return 0, 1.0
    gain = np.concatenate([[0.0], np.cumsum(most_error - wrong)])
    least = np.minimum.accumulate(gain)
    end = int((gain - least).argmax())
    start = int(np.flatnonzero(gain[: end + 1] == least[end])[-1])
    return (end - start, float(wrong[start:end].mean())) if end - start >= least_run else (0, 1.0)


def fingerprints(media: DataFrame, id: str = "id", data: str = "data") -> DataFrame:
    """``id, places, items`` of every row: little-endian 32-bit places and items.

    Both are empty for null, empty and silent recordings. One narrow pass, in which only
    the recordings go to Python.
    """

    @F.pandas_udf("places binary, items binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for recordings in batches:
            got = [fingerprint(x) for x in recordings]
            yield pd.DataFrame({"places": [p.astype("<i4").tobytes() for p, _ in got], "items": [i.astype("<u4").tobytes() for _, i in got]})

    found = media.select(named(id).cast("long").alias("id"), run.asNondeterministic()(named(data).cast("binary")).alias("of"))
    return found.select("id", "of.places", "of.items")


def _pair(places: bytes, items: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(places, "<i4").astype(np.int64), np.frombuffer(items, "<u4")


def _starts(places: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where an item begins: of a held tone that repeats it the first place alone."""
    new = np.concatenate([[True], (items[1:] != items[:-1]) | (places[1:] != places[:-1] + 1)])[: len(items)]
    return places[new], items[new]


def _exploded(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), 500):
            some = pdf.iloc[at : at + 500]
            got = [_starts(*_pair(p, i)) for p, i in zip(some["places"], some["items"], strict=True)]
            if got:
                sizes = [len(p) for p, _ in got]
                yield pd.DataFrame({"item": np.concatenate([i for _, i in got]).astype(np.int64), "class": np.repeat(some["class"].to_numpy(), sizes), "place": np.concatenate([p for p, _ in got])})


def search(media: DataFrame, queries: str, id: str = "id", data: str = "data", most_error: float = MOST_ERROR, least_overlap: int = LEAST_OVERLAP, least_run: int = LEAST_RUN) -> DataFrame:
    """The recordings that match those of a query set, one row per recording.

    ``queries``: SQL condition over ``id`` that names the query set. Returns ``id,
    n_items, items_crc32, class_id`` (smallest id of equal fingerprints), ``n_links``
    (queries that match it, itself left out) and the best of the other classes'
    queries: ``query_class, offset, overlap, bit_error``. Every recording is indexed by
    all its items, once for each time that an item begins; equal fingerprints are looked up
    once. A query is compared with what shares an item with it, at every offset that shared
    items agree on, of which there are no more than windows. Null, empty and silent recordings match nothing, and
    so do recordings whose fingerprint only rows of null ids have; recordings of any length
    are read whole; an empty table gives an empty result.
    """
    prints = saved(fingerprints(media, id, data).withColumn("print", F.md5(F.concat("places", "items"))))
    sound = prints.where(F.octet_length("items") > 0)
    asks = F.expr(f"int(coalesce({queries}, false))")
    classes = saved(sound.groupBy("print").agg(F.min("id").alias("class"), F.sum(asks).alias("asks"), F.first("places").alias("places"), F.first("items").alias("items")))
    index = classes.where("class is not null").select("class", "places", "items").mapInPandas(_exploded, "item long, class long, place long")
    asked = classes.where("asks > 0").select("class", "places", "items").mapInPandas(_exploded, "item long, class long, place long")
    asked = asked.select("item", F.col("class").alias("query_class"), F.col("place").alias("query_place"))
    votes = index.join(asked, "item").where("class <> query_class").groupBy("query_class", "class", (F.col("query_place") - F.col("place")).alias("offset")).agg(F.count("*").alias("n"))
    best = votes.groupBy("query_class", "class").agg(F.collect_list("offset").alias("offsets"))

    def verify(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for a, b, c, d, offsets in zip(pdf["qp"], pdf["qi"], pdf["places"], pdf["items"], pdf["offsets"], strict=True):
                found = [(*aligned(_pair(a, b), _pair(c, d), int(o), most_error, least_overlap, least_run), int(o)) for o in sorted(offsets)]
                rows.append(max(found, key=lambda x: (x[0], -x[1])))
            out = pdf[["query_class", "class", "asks"]].assign(overlap=[x[0] for x in rows], bit_error=[x[1] for x in rows], offset=[x[2] for x in rows])
            yield out[out["overlap"] > 0]

    sides = best.join(classes.select(F.col("class").alias("query_class"), F.col("places").alias("qp"), F.col("items").alias("qi"), "asks"), "query_class").join(classes.select("class", "places", "items"), "class")
    links = sides.mapInPandas(verify, "query_class long, class long, asks long, overlap long, bit_error double, offset long")
    found = links.groupBy("class").agg(F.sum("asks").alias("others"), F.min(F.struct("bit_error", -F.col("overlap"), "query_class", "offset", "overlap")).alias("best"))
    by_class = classes.join(found, "class", "left").select("print", F.col("class").alias("class_id"), (F.col("asks") + F.coalesce("others", F.lit(0))).alias("n_links"), "best")
    # silent recordings have no class of others, so one join serves all rows
    out = prints.join(by_class, "print", "left")
    loud = F.octet_length("items") > 0
    return out.select(
        F.col("id").alias(id), (F.octet_length("items") / 4).cast("long").alias("n_items"), F.crc32("items").alias("items_crc32"), F.when(loud, F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
        F.when(loud, F.col("n_links") - asks).otherwise(0).cast("long").alias("n_links"), "best.query_class", "best.offset", "best.overlap", "best.bit_error",
    )
