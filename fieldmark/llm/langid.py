"""Language ID by unigrams over pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary. Each language has its own piece
probabilities, fitted by expectation maximisation (forward and backward sums, no
single best segmentation). A text's likelihood in a language is the product over
its words of the forward sum over all segmentations of the word into pieces. Long
words' sums are kept as logarithms, so words of any length are summed whole.

Words are lower-cased runs between white space, digits, punctuation and symbols; a
character that is no piece costs the same in every language.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.llm.common import Memo, named, small_batches, tidied, without

PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Cost of a character that is no piece; characters of a word whose sums fit a double; characters summed at once, about.
UNKNOWN, SHORT, LOT = 1e-7, 40, 150_000
#: Bytes of scores that one worker remembers as long as it holds the model, and the longest word it remembers one for.
MEMO, MEMO_LENGTH = 32 << 20, 40
#: Languages of a model at most: its size, and so what is broadcast, grows with them.
MOST_LANGUAGES = 400
_BASE = 0x9E3779B97F4A7C15
#: Characters of the basic plane that end a word.
_BREAKS = {c: " " for c in range(1 << 16) if chr(c) != " " and (c < 128 and not chr(c).isalpha() or unicodedata.category(chr(c))[0] in "PSNZC")}


def words(text: str) -> list[str]:
    return text.lower().translate(_BREAKS).split()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _sums(codes: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes, with the last character counting once."""
    powers = _powers(len(codes))
    inverse = np.full(len(codes) + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    back = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * inverse[1:], dtype=np.uint64)])
    return back * powers


def vocabulary(path: str = PIECES) -> list[str]:
    """All pieces that hold a letter, the word-start mark kept as U+2581."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return sorted({p for p in found if any(c.isalpha() for c in p)})


@dataclass
class Lattice:
    """Words end to end, and every piece that fits a stretch of one.

    A word of n characters has n + 1 places in a row. ``start`` and ``end`` are
    places, ``piece`` is the piece between them.
    """

    first: np.ndarray
    length: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray

    @property
    def logs(self) -> bool:
        return bool(self.length.max(initial=0) > SHORT)


def _by_step(at: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by step, and where each step begins in it."""
    order = np.argsort(at, kind="stable")
    return order, np.searchsorted(at[order], np.arange(steps + 2))


@dataclass
class PieceModel:
    """Piece probabilities of each language and a scorer of words."""

    languages: list[str]
    pieces: list[str]
    probabilities: np.ndarray  # pieces x languages
    memo: Memo = field(default_factory=lambda: Memo(MEMO))

    def __post_init__(self) -> None:
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(self.pieces):
            by_length.setdefault(len(p), []).append(i)
        self._keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, own in sorted(by_length.items()):
            h = np.zeros(len(own), np.uint64)
            for codes in _codes("".join(self.pieces[i] for i in own)).reshape(-1, n).T:
                h = h * np.uint64(_BASE) + codes
            order = np.argsort(h)
            self._keys[n] = h[order], np.array(own)[order]

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "pieces": self.pieces, "probabilities": self.probabilities}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def lattice(self, ws: list[str]) -> Lattice:
        length = np.array([len(w) for w in ws])
        first = np.concatenate([[0], np.cumsum(length[:-1] + 1)])
        codes = _codes("".join(w + "\0" for w in ws))
        sums = _sums(codes)
        word = np.repeat(first, length + 1)
        found = []
        for n, (keys, own) in self._keys.items():
            # a stretch that runs over a word's end holds a mark, which no piece has
            if n < len(codes):
                h = sums[n:] - sums[:-n] * np.uint64(pow(_BASE, n, 1 << 64))
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == h)
                found.append((hit, hit + n, own[at[hit]]))
        start, end, piece = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        inside = end - word[start] <= length[np.searchsorted(first, word[start])] if len(start) else np.zeros(0, bool)
        return Lattice(first, length, start[inside], end[inside], piece[inside])

    def sums(self, x: Lattice, backward: bool = False) -> np.ndarray:
        """The sum over all segmentations up to each place (or, backward, from it).

        As logarithms if ``x.logs``; a short word's sums can't vanish and stay as they are.
        """
        logs, steps = x.logs, int(x.length.max(initial=0))
        out = np.full((int((x.length + 1).sum()), len(self.languages)), 0.0 if logs else 1.0)
        here, there, way = (x.start, x.end, -1) if backward else (x.end, x.start, 1)
        edge = x.first + x.length if backward else x.first
        # characters between a word's edge and the place that a piece leads to
        order, begins = _by_step(np.abs(here - np.repeat(edge, x.length + 1)[here]), steps)
        here, there, p = here[order], there[order], self.probabilities[x.piece[order]]
        by_length = np.argsort(-x.length, kind="stable")
        edge, lengths, place = edge[by_length], -x.length[by_length], np.empty(len(out), np.int64)
        for step in range(1, steps + 1):
            live = edge[: int(np.searchsorted(lengths, -step, side="right"))] + way * step
            a, b = begins[step], begins[step + 1]
            place[live] = np.arange(len(live))
            before, at = out[live - way], place[here[a:b]]
            flow = (np.exp(out[there[a:b]] - out[here[a:b] - way]) if logs else out[there[a:b]]) * p[a:b]
            total = np.full_like(before, UNKNOWN) if logs else before * UNKNOWN
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(at, weights=flow[:, k], minlength=len(live))
            out[live] = before + np.log(total) if logs else total
        return out

    def score(self, ws: list[str]) -> np.ndarray:
        """Log-likelihood of each word in each language."""
        out = np.zeros((len(ws), len(self.languages)))
        for own in _lots(ws):
            x = self.lattice(["▁" + ws[i] for i in own])
            sums = self.sums(x)[x.first + x.length]
            out[own] = sums if x.logs else np.log(sums)
        return out

    def of(self, texts: list[list[str]]) -> np.ndarray:
        """Log-likelihood of each text, a list of words, in each language."""
        memo, out = self.memo, np.zeros((len(texts), len(self.languages)))
        new = [w for w in set().union(*texts) if w not in memo]
        scores = self.score(new).astype(np.float32)
        if not memo:
            self._scores = np.zeros((0, len(self.languages)), np.float32)
        kept = len(memo)
        for w in new:
            if len(w) <= MEMO_LENGTH:
                memo.keep(w, len(memo), 4 * len(self.languages))
        # remembered words first, in the order of their numbers; then those of these texts only
        number = {w: memo.get(w, -1) for w in new}
        fresh = np.array(list(number.values()), np.int64)
        if len(memo) > len(self._scores):
            self._scores = np.concatenate([self._scores, np.zeros((max(len(memo), 2 * kept) - len(self._scores), len(self.languages)), np.float32)])
        self._scores[fresh[fresh >= 0]] = scores[fresh >= 0]
        own = {w: i for i, (w, k) in enumerate(number.items()) if k < 0}
        for i, ws in enumerate(texts):
            if own and not own.keys().isdisjoint(ws):
                out[i] = scores[[own[w] for w in ws if w in own]].sum(axis=0, dtype=np.float64)
                ws = [w for w in ws if w not in own]
            out[i] += self._scores[np.fromiter(map(memo.__getitem__, ws), np.int64, len(ws))].sum(axis=0, dtype=np.float64)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text; ``und`` and 0 without a letter.

        Score: posterior over the languages with the log-likelihood divided by the
        square root of the number of words, since words of one text are alike.
        """
        und = [not t or not any(map(str.isalpha, t)) for t in texts]
        split = [[] if u else words(t) for t, u in zip(texts, und, strict=True)]
        totals = self.of(split)
        out = []
        for u, ws, row in zip(und, split, totals, strict=True):
            if u or not self.languages:
                out.append(("und", 0.0))
                continue
            row = (row - row.max()) / max(1, len(ws)) ** 0.5
            p = np.exp(row)
            k = int(row.argmax())
            out.append((self.languages[k], float(p[k] / p.sum())))
        return out


def _lots(ws: list[str]) -> Iterator[np.ndarray]:
    """Places of words in lots of about ``LOT`` characters, like lengths together."""
    lengths = np.array([len(w) + 2 for w in ws], np.int64)
    order = np.argsort(lengths, kind="stable")
    lot = np.cumsum(lengths[order]) // LOT
    yield from np.split(order, np.flatnonzero(np.diff(lot)) + 1) if len(ws) else []


def fit(counts: pd.DataFrame, pieces: list[str], sweeps: int = 4) -> PieceModel:
    """Piece probabilities from ``lang, word, n`` by expectation maximisation over all words."""
    languages = sorted(counts["lang"].unique())
    model = PieceModel(languages, pieces, np.full((len(pieces), len(languages)), 1 / max(1, len(pieces))))
    if not len(counts):
        return model
    word, ws = pd.factorize(counts["word"])
    weights = np.zeros((len(ws), len(languages)))
    np.add.at(weights, (word, np.searchsorted(languages, counts["lang"])), counts["n"].to_numpy(np.float64))
    lots = [(own, model.lattice(["▁" + ws[i] for i in own])) for own in _lots(ws)]
    for _ in range(sweeps):
        expected = np.zeros((len(pieces), len(languages)))
        for own, x in lots:
            alpha, beta = model.sums(x), model.sums(x, backward=True)
            total, of = alpha[x.first + x.length], np.repeat(np.arange(len(own)), x.length + 1)[x.start]
            for k in range(len(languages)):
                a, b, t = alpha[x.start, k], beta[x.end, k], total[of, k]
                flow = (np.exp(a + b - t) if x.logs else a * b / t) * model.probabilities[x.piece, k]
                expected[:, k] += np.bincount(x.piece, weights=flow * weights[own[of], k], minlength=len(pieces))
        expected += 0.01
        model.probabilities = expected / expected.sum(axis=0)
    return model


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_language: int = 300, path: str = PIECES) -> PieceModel:
    """A model of the languages named in ``lang``.

    Fitted on a bounded sample of labelled documents, whole texts each: for every
    language the ``docs_per_language`` (at most 1000) documents with the smallest
    hashes of their ids, then of their texts, so the sample is the same however the rows lie.
    Rows without label, id or text are left out, and repeated rows are one document;
    without any, the model has no language and finds none. Only word counts of the sample travel to the driver. More than
    ``MOST_LANGUAGES`` values of ``lang`` are an error, since a column of labels that
    dirty would make a model of no bound.
    """
    order = Window.partitionBy("lang").orderBy("h", "id", "t")
    labelled = docs.where(named(lang).isNotNull()).select(named(lang).cast("string").alias("lang"), named(id).alias("id"), named(text).alias("text"))
    languages = labelled.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if languages > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in {lang}")
    whole = labelled.where("text is not null and id is not null").withColumn("t", F.xxhash64("text"))
    ids = whole.select("lang", "id", "t").distinct().withColumn("h", F.xxhash64("id"))
    chosen = ids.withColumn("k", F.row_number().over(order)).where(F.col("k") <= min(docs_per_language, 1000)).select("lang", "id", "t")
    # at most docs_per_language documents for each of the languages counted above
    sample = whole.join(F.broadcast(chosen), ["lang", "id", "t"], "left_semi").dropDuplicates(["lang", "id", "t"])

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts = Counter((x, w) for x, t in zip(pdf["lang"], pdf["text"], strict=True) for w in words(t))
            yield pd.DataFrame([(x, w, n) for (x, w), n in counts.items()], columns=["lang", "word", "n"])

    counts = sample.select("lang", "text").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return fit(counts.toPandas(), vocabulary(path))


def identify(docs: DataFrame, model: PieceModel, text: str = "text") -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``score``, which replace columns of these names.

    Whole texts of any length, one narrow pass, in which only the text goes to Python.
    A null text, an empty one and one without a letter get ``und`` and score 0. Repeated
    rows get equal results; an empty table gives an empty result. The model's size is
    bounded by the vocabulary and ``MOST_LANGUAGES``; it travels with the task.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value

        def found(texts: pd.Series) -> pd.DataFrame:
            got = []
            for at in range(0, len(texts), 500):
                got += m.predict_all(texts.iloc[at : at + 500].tolist())
            return pd.DataFrame(got, columns=["lang_pred", "score"])

        yield from tidied(map(found, batches))

    # not deterministic for the planner, so that a filter on the result doesn't run it twice
    kept = without(docs, "lang_pred", "score")
    inner = [c.alias(f"c{k}") for k, c in enumerate(kept)]
    out = docs.select(*inner, predict.asNondeterministic()(named(text)).alias("found"))
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], "found.lang_pred", "found.score")
