"""Operators for training data against brute force, with odd rows: nulls, empty and long
texts, ties, repeats, empty tables and clashing column names."""

import datetime
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from fieldmark.llm import bpe, chroma, langid, mixing, multiindex, pii, queries, sharding, simhash, suffixdedup, tokenfile

LONG = " ".join(f"word{i * 7919 % 1013}" for i in range(20_000))
TEXTS = [None, "", " ", "one", "a b c d e f g", "a b c d e f g", "A B C D E F G", "ça va où être naïve 你好 😀", "  two  spaces\n\ttabs ", LONG, LONG + " tail", "mail x.1@mail2.example.com call +1 (017) 555-7713", "x" * 300, "x" * 300, "x <|endoftext|> y<|endoftext|>", "don't can't we'll 123456 !!! \u001c z"]
CLASH = "doc_id long, text string, lang string, source string, n_tokens int, size int, id int, fp int, at int, h int, tie int, count int"
#: Names that results, reserved columns and inner columns have.
NAMES = ("weight", "probability", "kept", "lang_pred", "score", "token_ids", "_text", "_topic", "topic", "component_id", "_ids", "found", "c0", "m0", "print", "node")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 3 else None, None if i % 4 == 0 else f"s{i % 2}", 1, 2, 3, 4, 5, 6, 7, 8) for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "null id", "de", "s1", 1, 2, 3, 4, 5, 6, 7, 8)]
    return spark.createDataFrame(rows, CLASH).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], CLASH)


def by_id(df, *cols):
    out = {}
    for r in df.collect():
        out[r["doc_id"]] = tuple(r[c] for c in cols)
    return out


# 1 mixing


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(50, 150)), ["en", "de"][i % 3 == 0], f"s{min(2, i % 10)}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    got = mixing.mix(docs, {"lang": {"en": 0.5, "de": 0.5}, "source": None}, 0.1).toPandas()
    kept = got[got.kept]
    assert abs(kept.n_tokens.sum() / got.n_tokens.sum() - 0.1) < 0.03
    expected = got.assign(e=got.probability * got.n_tokens)
    assert expected.e.sum() / got.n_tokens.sum() == pytest.approx(0.1)
    shares = expected.groupby("lang").e.sum() / expected.e.sum()
    assert shares["en"] == pytest.approx(0.5, abs=1e-6)
    assert (expected.groupby("source").e.sum() / expected.e.sum()).to_numpy() == pytest.approx([1 / 3] * 3, abs=1e-6)


def test_mix_takes_small_cells_whole(spark):
    raked = spark.createDataFrame([("a", 10, 0.5), ("b", 1000, 0.5)], "m string, tokens long, share double")
    got = {r["m"]: r["probability"] for r in mixing.probabilities(raked, 505.0, 1010).collect()}
    assert got == {"a": 1.0, "b": pytest.approx(0.495)}


def test_mix_odd_rows(odd, none):
    got = mixing.mix(odd, {"lang": None, "source": None}, 0.5)
    rows = got.collect()
    assert len(rows) == odd.count() and all(0 <= r["probability"] <= 1 for r in rows)
    assert all(not r["kept"] for r in rows if r["n_tokens"] == 0)
    assert mixing.mix(none, {"lang": None}, 0.5).count() == 0


# 2 sharding


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_shards(odd, shards):
    got = sharding.shard_by_bytes(odd, shards).toPandas()
    assert len(got) == odd.count() and got["shard"].between(0, shards - 1).all()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert got.groupby("text_crc32")["shard"].nunique().max() == 1
    assert got.loc[got.doc_id == 9, "text_crc32"].item() == zlib.crc32(LONG.encode())
    assert got.loc[got.doc_id == 9, "size"].item() == len(LONG.encode()) + 8


@pytest.mark.parametrize(("seed", "buckets", "read"), [(0, 10_000, 200_000), (1, 20, 5), (2, 6, 0)])
def test_capacity_is_minimal(spark, seed, buckets, read):
    """Also where the running sums are looked at through few buckets."""
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 60, 80).tolist()
    sizes[5] = 700 if seed == 1 else sizes[5]
    ends = np.cumsum(sizes).tolist()
    capacity, cuts = sharding.minimax_capacity(spark.createDataFrame([(e,) for e in ends], "end long"), 7, ends[-1], max(sizes), buckets, read)

    def fits(c):
        n, left = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > left:
                n, left = n + 1, c
            left -= s
        return n <= 7

    assert fits(capacity) and not fits(capacity - 1) and cuts[-1] == ends[-1] and set(cuts) <= set(ends)


def test_shards_empty(none):
    assert sharding.shard_by_bytes(none).count() == 0


# 3 suffix index


def brute_repeats(rows, span):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            w = b[i : i + span]
            if w in seen:
                gone[i : i + span] = b"\1" * span
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1])), kept)
    return out


@pytest.mark.parametrize(("seed", "hot"), [(0, 20_000), (1, 20_000), (2, 2)])
def test_repeats_brute_force(spark, seed, hot):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdé "), rng.integers(1, 9)))
    common = ["".join(word() for _ in range(40)) for _ in range(4)]
    rows = [(int(d), "".join(common[rng.integers(4)] if rng.random() < 0.4 else word() * int(rng.integers(1, 30)) for _ in range(8))) for d in rng.permutation(40)]
    rows += [(100, None), (101, ""), (102, "ab" * 400), (103, "a" * 500), (104, rows[0][1])]
    want = brute_repeats(rows, 100)
    got = suffixdedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), hot=hot)
    assert {k: (*v[:3], bytes(v[3])) for k, v in by_id(got, "n_bytes", "n_removed", "n_spans", "kept").items()} == want


def test_repeats_odd_rows(odd, none):
    got = suffixdedup.remove_repeats(odd).toPandas()
    assert len(got) == odd.count()
    twice = got[got.doc_id == 4]
    assert len(twice) == 2 and (twice.n_removed == 0).all()
    assert got.loc[got.doc_id == 10, "n_removed"].item() >= len(LONG) - 5
    assert suffixdedup.remove_repeats(none).count() == 0


def test_repeats_crowded_passage(monkeypatch):
    """A passage in many documents sends hashes, once per task, and reaches no index."""
    import pandas as pd

    rng = np.random.default_rng(4)
    passage = bytes(rng.integers(97, 123, 120, np.uint8))
    docs = [bytes(rng.integers(97, 123, 30, np.uint8)) + passage for _ in range(300)]
    asked = [[{"h": 1, "at": 0 << 32 | 150, "lots": 3, "crowded": True}] for _ in docs]
    frame = pd.DataFrame({"id": np.arange(300), "tie": 0, "text": docs, "asked": asked})
    sent = pd.concat(suffixdedup._fetch(100)([frame.iloc[:150]]))
    assert sent["text"].isna().all()
    assert len(sent[~sent["sure"]]) == len({d[k : k + 100] for d in docs[:150] for k in range(51)}) < 150 * 31
    parts = pd.concat([sent, *suffixdedup._fetch(100)([frame.iloc[150:]])], ignore_index=True).sort_values(["h", "s", "id", "tie", "at"])
    monkeypatch.setattr(suffixdedup, "RunIndex", None)
    got = defaultdict(set)
    for cut in (1000, len(parts)):
        got.clear()
        for pdf in suffixdedup._index(100)(parts.iloc[a : a + cut] for a in range(0, len(parts), cut)):
            for i, at in zip(pdf["id"], pdf["at"], strict=True):
                got[i] |= set(range(at >> 32, (at >> 32) + (at & 0xFFFFFFFF)))
        assert set(got) == set(range(1, 300)) and all(set(range(30, 150)) <= v <= set(range(27, 150)) for v in got.values())


def test_matching_statistics():
    """Lengths and places of the longest matches, against a search of every substring."""
    rng = np.random.default_rng(0)
    for _ in range(20):
        strings = [bytes(rng.integers(97, 100, rng.integers(1, 30), np.uint8)) for _ in range(4)]
        patterns = [bytes(rng.integers(97, 101, rng.integers(1, 30), np.uint8)) for _ in range(4)]
        index, text = suffixdedup.RunIndex(strings), b"\0".join(strings) + b"\0"
        seen = 0
        for rows in index.statistics(patterns):
            for i, offset, length, at in zip(*rows, strict=True):
                rest = patterns[i][offset:]
                assert length == max(k for k in range(len(rest) + 1) if rest[:k] in text)
                assert text[at : at + length] == rest[:length]
                seen += 1
        assert seen == sum(map(len, patterns))


def test_run_index_is_compressed():
    index = suffixdedup.RunIndex([b"banana" * 30, b"bananab" * 25, b"x" * 120])
    assert len(index.start) < 150 < len(index.text)


def test_repeats_in_groups():
    for seed in range(10):
        rng = np.random.default_rng(seed)
        texts, group, want, seen = [], [], set(), set()
        for g in range(12):
            core = bytes([65 + g]) + bytes(rng.integers(97, 123, 14, np.uint8))
            for _ in range(rng.integers(1, 12)):
                texts.append(bytes(rng.integers(97, 99, rng.integers(0, 4), np.uint8)) + core + bytes(rng.integers(97, 99, rng.integers(0, 5), np.uint8)))
                group.append(g)
                windows = [texts[-1][k : k + 12] for k in range(len(texts[-1]) - 11)]
                want |= {(len(texts) - 1, k) for k, w in enumerate(windows) if w in seen}
                seen |= set(windows)
        string, offset = suffixdedup.repeats(texts, np.array(group), 12)
        assert set(zip(string.tolist(), offset.tolist(), strict=True)) == want


# 4 pseudonyms


def test_pseudonyms(spark):
    card, bad = "4041894974608795", "4041894974608796"
    texts = [f"pay {card} or {bad}", f"again {card[:4]} {card[4:8]} {card[8:12]} {card[12:]}", "ip 27.65.93.188 and 999.1.1.1", "on 2020-02-29, 29.02.2020, 2021-02-30", "ssn 219-09-9999 000-12-1234", "a.55@mail4.example.com", "+1 (017) 555-7713", "GB82WEST12345698765432", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', None, "", "plain 12345"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n int")
    got = by_id(pii.pseudonymise(docs, "k", count="n_replaced"), "text", "n_replaced")
    digits = lambda s: "".join(c for c in s if c.isdigit())
    one, two = got[0][0].split(), digits(got[1][0])
    assert one[1] != card and one[1] == two and one[3] == bad and got[0][1] == 1
    total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(two)))
    assert total % 10 == 0 and len(two) == 16
    assert "27.65.93.188" not in got[2][0] and "999.1.1.1" in got[2][0]
    day = got[3][0].split()[1].strip(",").split("-")
    assert got[3][0].split()[2].strip(",") == ".".join(reversed(day)) and "2021-02-30" in got[3][0]
    assert "219-09-9999" not in got[4][0] and "000-12-1234" in got[4][0]
    assert got[5][0].endswith("@mail4.example.com") and got[5][0] != texts[5]
    assert got[6][0][:4] == "+1 (" and got[6][0] != texts[6] and len(got[6][0]) == len(texts[6])
    iban = got[7][0]
    moved = iban[4:] + iban[:4]
    assert int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 and iban != texts[7]
    assert set(got[8][0][9:-1]) <= set("0123456789abcdef") and got[8][0] != texts[8]
    assert got[9] == (None, None) and got[10] == ("", 0) and got[11] == ("plain 12345", 0)


def plain_permuted(values, radices, key, tag):
    """The keyed Feistel network, symbol by symbol."""
    s = list(values)
    half = len(s) // 2
    for i in range(1, pii.ROUNDS + 1):
        other = s[half:] if i % 2 else s[:half]
        stream = "".join(hashlib.sha512("|".join([key, tag, str(i), str(b), ",".join(map(str, other))]).encode()).hexdigest() for b in range(len(s) // 16 + 1))
        for j in range(len(s)):
            if (j < half) == (i % 2 == 1):
                s[j] = (s[j] + int(stream[8 * j : 8 * j + 8], 16)) % radices[j]
    return s


def plain_symbols(text, key, tag):
    def kind(c):
        return (48, 10) if c.isdigit() else (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else (ord(c), 1)

    kinds = [kind(c) for c in text]
    moved = plain_permuted([ord(c) - b for c, (b, _) in zip(text, kinds, strict=True)], [n for _, n in kinds], key, tag)
    return "".join(chr(b + v) for (b, _), v in zip(kinds, moved, strict=True))


def plain_pseudonym(word, key):
    """The pseudonym of one word by plain rules, or the word itself."""
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s)))
    if re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", word) and max(map(int, word.split("."))) < 256:
        return ".".join(map(str, plain_permuted([int(x) for x in word.split(".")], [256] * 4, key, "ip")))
    if re.fullmatch(r"\d{13,19}", word) and luhn(word) % 10 == 0 and set(word) != {"0"}:
        p = word[0] + plain_symbols(word[1:-1], key, "card")
        return p + str(-luhn(p + "0") % 10)
    if m := re.fullmatch(r"(\d{3})-(\d\d)-(\d{4})", word):
        a, b, c = map(int, m.groups())
        if 1 <= a <= 899 and a != 666 and b and c:
            a, b, c = plain_permuted([a - (2 if a > 666 else 1), b - 1, c - 1], [898, 99, 9999], key, "ssn")
            return f"{a + (2 if a > 664 else 1):03d}-{b + 1:02d}-{c + 1:04d}"
    if m := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)", word):
        try:
            n = (datetime.date(*map(int, m.groups())) - datetime.date(1700, 1, 1)).days
        except ValueError:
            return word
        if 0 <= n < 146097:
            a, b = plain_permuted([n // 773, n % 773], [189, 773], key, "date")
            return (datetime.date(1700, 1, 1) + datetime.timedelta(a * 773 + b)).isoformat()
    if m := re.fullmatch(r"([A-Za-z0-9.]+)@([A-Za-z0-9]+\.[a-z]+)", word):
        return plain_symbols(m[1], key, "email") + "@" + m[2].lower()
    return word


def test_pseudonyms_brute_force(spark):
    """Texts of random words, valid and not, against the plain rules word by word."""
    rng = np.random.default_rng(6)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def card(n):
        body = digits(n - 1)
        return body + str(next(c for c in range(10) if sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(body + str(c)))) % 10 == 0))

    makers = [
        lambda: ".".join(str(x) for x in rng.integers(0, 300, 4)), lambda: card(int(rng.integers(13, 20))), lambda: digits(16), lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        lambda: f"{rng.integers(1690, 2110):04d}-{rng.integers(1, 14):02d}-{rng.integers(1, 33):02d}", lambda: f"u{digits(2)}.Xy@Mail{digits(1)}.org", lambda: digits(5), lambda: "plain",
    ]
    texts = [" ".join(makers[rng.integers(len(makers))]() for _ in range(rng.integers(1, 9))) for _ in range(300)]
    got = {r["i"]: r["text"] for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), "key").collect()}
    want = {i: " ".join(plain_pseudonym(w, "key") for w in t.split(" ")) for i, t in enumerate(texts)}
    assert got == want
    assert sum(got[i] != t for i, t in enumerate(texts)) > 200


def plain_class(o):
    """First code point and size of a symbol's class, found by walking to its ends."""
    for first, n in ((48, 10), (97, 26), (65, 26), (223, 24), (248, 8), (192, 23), (216, 7), (161, 31)):
        if first <= o < first + n:
            return first, n
    if o < 161:
        return o, 1
    run = lambda x: next((r for r in pii.SCRIPTS if r[0] <= x < r[0] + r[1]), None)
    if run(o):
        return run(o)
    lo, hi = o, o
    while lo % 64 and not run(lo - 1):
        lo -= 1
    while (hi + 1) % 64 and not run(hi + 1):
        hi += 1
    return lo, hi - lo + 1


LOCALS = ["иван.петров", "張偉", "ИВАН", "łukasz", "Łódź", "γιώργος", "Ά", "ａｂｃ１２", "김철수", "नमस्ते", "é̂x", "𝒳yz", "たなか_1", "ªº²", "çÿ÷".replace("÷", "ß"), "สมชาย", "محمد", "דוד", "o’brien", "a.b%c+d-e"]


def test_addresses_of_all_scripts(spark):
    """Every symbol of a local part moves within its class, as the plain network has it."""
    docs = spark.createDataFrame([(f"<{x}@Example.com>",) for x in LOCALS], "text string")
    for x, r in zip(LOCALS, pii.pseudonymise(docs, "k", count="n").collect(), strict=True):
        kinds = [plain_class(ord(c)) for c in x]
        moved = plain_permuted([ord(c) - b for c, (b, _) in zip(x, kinds, strict=True)], [n for _, n in kinds], "k", "email")
        want = "".join(chr(b + v) for (b, _), v in zip(kinds, moved, strict=True))
        assert (r["text"], r["n"]) == (f"<{want}@example.com>", 1)
        assert all(n > 1 for c, (_, n) in zip(x, kinds, strict=True) if c not in "._%+-’")
    found = pii.classes()
    assert all(a + n <= b for (a, n), (b, _) in zip(sorted(found), sorted(found)[1:], strict=False))
    assert all(plain_class(o) == next((c for c in found if c[0] <= o < c[0] + c[1]), (o // 64 * 64, 64)) for o in range(161, 0x3200, 3) if o not in (215, 247))


def test_addresses_permute(spark):
    """All pairs of letters from blocks that runs cover in part: as many pseudonyms as addresses."""
    letters = [chr(o) for o in [*range(0x386, 0x3A2), *range(0x3F8, 0x410), *range(0x10C0, 0x10D4), *range(0x100, 0x104)] if chr(o).isalpha()]
    docs = spark.createDataFrame([(f"{a}{b}@x.org",) for a in letters for b in letters], "text string")
    out = {r["text"] for r in pii.pseudonymise(docs, "k").collect()}
    assert len(out) == len(letters) ** 2


def test_slashed_dates_permute(spark):
    """All days of a leap year and the one before, as dd/MM/yyyy and as MM/dd/yyyy: as many pseudonyms as values."""
    days = [datetime.date(2023, 1, 1) + datetime.timedelta(k) for k in range(731)]
    values = sorted({f"{d:{f}}" for d in days for f in ("%d/%m/%Y", "%m/%d/%Y")})
    got = {r["text"] for r in pii.pseudonymise(spark.createDataFrame([(v,) for v in values], "text string"), "k").collect()}
    assert len(got) == len(values)
    readable = lambda v: sorted(f for f in ("%d/%m/%Y", "%m/%d/%Y") if _reads(v, f))
    assert sorted(map(readable, got)) == sorted(map(readable, values))


def _reads(value, form):
    try:
        datetime.datetime.strptime(value, form)
    except ValueError:
        return False
    return True


def test_pseudonyms_permute(spark):
    """No two originals share a pseudonym: all of a small format."""
    n = 3000
    cases = {"ip": [f"10.{i // 256}.{i % 256}.7" for i in range(n)], "date": [f"{1900 + i // 336:04d}-{i // 28 % 12 + 1:02d}-{i % 28 + 1:02d}" for i in range(n)], "phone": [f"+1 (017) 555-{i:04d}" for i in range(n)]}
    for values in cases.values():
        docs = spark.createDataFrame([(v,) for v in values], "text string")
        out = {r["text"] for r in pii.pseudonymise(docs, "k").collect()}
        assert len(out) == n and len(out & set(values)) < n / 10


def test_pseudonyms_odd_rows(odd, none):
    got = pii.pseudonymise(odd, "k")
    assert got.columns == odd.columns and got.count() == odd.count()
    assert by_id(got, "text")[9] == (LONG,)
    assert pii.pseudonymise(none, "k").count() == 0


# 5 byte-level BPE


@pytest.fixture(scope="module")
def reference_encoding():
    import base64

    import public_tokenizers as P

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_as_the_library(odd, none, reference_encoding):
    got = by_id(bpe.round_trip(odd), "n_tokens", "ids_sha256", "decoded_sha256")
    for i, t in enumerate(TEXTS):
        ids = np.array(reference_encoding.encode_ordinary(t or ""), "<u4")
        assert got[i] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.round_trip(none).count() == 0
    back = by_id(bpe.decode(bpe.encode(odd)), "decoded")
    assert bytes(back[7][0]).decode() == TEXTS[7]


def test_bpe_random_text(reference_encoding):
    rng = np.random.default_rng(0)
    symbols = list("ab  \n\t\r'stVLÉé1² 你 　 \u001f😀.!-")
    codec = bpe.codec()
    for _ in range(400):
        t = "".join(rng.choice(symbols, rng.integers(0, 40)))
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == reference_encoding.encode_ordinary(t)
        assert codec.decode(codec.encode(t)) == t.encode()


def test_perfect_hash():
    keys = [f"k{i}".encode() for i in range(1000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slot(k) for k in keys) == list(range(1000))
    assert bpe.PerfectHash([]).slot(b"x") == -1
    for seed in range(8):
        for n in range(65):
            keys = [f"{seed}|{i}".encode() for i in range(n)]
            h = bpe.PerfectHash(keys)
            assert sorted(h.slot(k) for k in keys) == list(range(n))
    with pytest.raises(ValueError, match="distinct"):
        bpe.PerfectHash([b"a", b"a"])


# 6 token files


def test_token_file(odd, none):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = sorted(tokenfile.token_file_digest(odd).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in odd.collect()), key=lambda d: (d is not None, d))
    start = 0
    for r in got:
        text = "null id" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert tokenfile.token_file_digest(none).count() == 0


def test_addressable_codes():
    rng = np.random.default_rng(0)
    for values in (rng.integers(0, 50_000, 3000), np.zeros(0, int), np.array([2**40]), np.full(512, 300), rng.integers(0, 300, 1024)):
        codes = tokenfile.AddressableCodes(tokenfile.AddressableCodes.pack(values))
        assert len(codes) == len(values)
        for i in rng.integers(0, max(1, len(values)), 20) if len(values) else []:
            assert codes[int(i)] == values[i]
        a, b = sorted(rng.integers(0, len(values) + 1, 2))
        assert codes.range(int(a), int(b)).tolist() == values[a:b].tolist()


# 7 multi-index


def brute_links(vectors, least):
    ok = [i for i, v in enumerate(vectors) if v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([vectors[i] for i in ok], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= least
    np.fill_diagonal(linked, False)
    n, comp = [0] * len(vectors), list(range(len(vectors)))
    for a, i in enumerate(ok):
        n[i] = int(linked[a].sum())
    changed = True
    while changed:
        changed = False
        for a, i in enumerate(ok):
            low = min([comp[i], *(comp[ok[b]] for b in np.flatnonzero(linked[a]))])
            changed |= low != comp[i]
            comp[i] = low
    return n, comp


def test_multi_index_recall(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    rows = [(base[i % 60] + (rng.normal(0, 0.15, 16) if i > 40 else 0)).astype(np.float32).tolist() for i in range(700)]
    rows += [None, [0.0] * 16, [1.0] * 15 + [None], [float("nan")] * 16, [float("inf")] * 16, rows[3], rows[3], [2 * v for v in rows[3]], [1.0], [], [1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [1.0, 2.0, 3.1], [-1.0, 2.0, 3.0]]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>").withColumn("node", F.lit(1)).withColumn("n", F.lit(2))
    got = {r["vec_id"]: r for r in multiindex.near_duplicates(df.repartition(4)).collect()}
    n, comp = brute_links(rows, 0.9)
    assert [got[i]["n_links"] for i in range(len(rows) - 4, len(rows))] == [2, 2, 2, 0]
    assert [got[i]["component_id"] for i in range(len(rows) - 4, len(rows))] == [len(rows) - 4] * 3 + [len(rows) - 1]
    n[-4:-1], comp[-3:-1] = [2, 2, 2], [len(rows) - 4] * 2
    found = sum(got[i]["n_links"] for i in range(len(rows)))
    assert found >= 0.9 * sum(n) and all(got[i]["n_links"] <= n[i] for i in range(len(rows)))
    assert np.mean([got[i]["component_id"] == comp[i] for i in range(len(rows))]) > 0.98
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got)
    assert multiindex.near_duplicates(df.limit(0)).count() == 0


def test_multi_index_recall_on_embeddings(spark, sf):
    """All pairs of the table itself, at the cosine that one pair in 500 reaches: 0.9 has none at this size."""
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = table.collect()
    x = multiindex.unit(np.array([r["embedding"] for r in rows]))
    cosine = x @ x.T
    np.fill_diagonal(cosine, -1)
    least = float(np.quantile(cosine, 0.998))
    near = cosine >= least
    got = {r["vec_id"]: r["n_links"] for r in multiindex.near_duplicates(table, similarity=least).collect()}
    assert near.sum() > 400 and sum(got.values()) >= 0.99 * near.sum()
    assert all(got[r["vec_id"]] <= n for r, n in zip(rows, near.sum(axis=1), strict=True))


def test_large_ids(spark):
    """Ids of 63 bits pass the links, the components and Python."""
    at = 1 << 62
    vectors = [(at + k, [1.0, 0.01 * k]) for k in range(9)] + [(None, [1.0, 0.0])]
    got = multiindex.near_duplicates(spark.createDataFrame(vectors, "vec_id long, embedding array<float>")).collect()
    assert sorted((r["vec_id"], r["component_id"]) for r in got if r["vec_id"]) == [(at + k, at) for k in range(9)]
    words = [f"w{k}" for k in range(300)]
    docs = spark.createDataFrame([(at + k, " ".join([*words, f"x{k}"])) for k in range(9)] + [(None, "alone")], "doc_id long, text string")
    assert {r["component_id"] for r in simhash.similar_documents(docs).collect() if r["doc_id"]} == {at}
    found = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"] for r in found} == {None, *range(at, at + 9)} and {r["component_id"] for r in found if r["doc_id"]} <= set(range(at, at + 9))
    assert {r["doc_id"] for r in tokenfile.token_file_digest(docs).collect()} == {None, *range(at, at + 9)}
    assert {r["doc_id"] for r in bpe.round_trip(docs).collect()} == {None, *range(at, at + 9)}


def test_multi_index_blocks(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "BLOCK", 16)
    rng = np.random.default_rng(6)
    rows = [(rng.normal(size=16) * 0.05 + 1).astype(np.float32).tolist() for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>")
    got = multiindex.near_duplicates(df).collect()
    assert all(r["n_links"] == 199 and r["component_id"] == 0 for r in got)


def test_multi_index_outside_sample(spark, monkeypatch):
    """Isolated pairs near the threshold, in a table with one hot tight group and a small sample."""
    monkeypatch.setattr(multiindex, "SAMPLE", 256)
    monkeypatch.setattr(multiindex, "BLOCK", 64)
    rng = np.random.default_rng(12)
    x, hot = multiindex.unit(rng.normal(size=(1000, 16))), rng.normal(size=16)
    e = rng.normal(size=x.shape)
    e[:500, 8:] = 0
    e[:500, :8] -= ((e[:500, :8] * x[:500, :8]).sum(axis=1) / (x[:500, :8] ** 2).sum(axis=1))[:, None] * x[:500, :8]
    e[500:] -= (e[500:] * x[500:]).sum(axis=1)[:, None] * x[500:]
    partner = 0.91 * x + (1 - 0.91**2) ** 0.5 * multiindex.unit(e)
    rows = [*x, *partner, *(hot + rng.normal(0, 0.02, (1500, 16)))]
    rows = [r.astype(np.float32).tolist() for r in rows]
    got = {r["vec_id"]: r for r in multiindex.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>").repartition(4)).collect()}
    assert np.mean([got[i]["component_id"] == got[i + 1000]["component_id"] for i in range(1000)]) > 0.99


def test_multi_index_bound_beside_a_tight_group():
    """The bound holds for pairs at the threshold even if only a tight group has partners in the sample."""
    rng = np.random.default_rng(14)
    hot = rng.normal(size=32) + rng.normal(0, 0.001, (200, 32))
    x = multiindex.unit(rng.normal(size=(400, 32)))
    index = multiindex.MultiIndex(multiindex.unit(np.concatenate([x, hot])), 64, 0.9, 0.999)
    e = np.zeros_like(x)
    e[:, :16] = rng.normal(size=(400, 16))
    e[:, :16] -= ((e[:, :16] * x[:, :16]).sum(axis=1) / (x[:, :16] ** 2).sum(axis=1))[:, None] * x[:, :16]
    cells = index.cells(0.91 * x + (1 - 0.91**2) ** 0.5 * multiindex.unit(e))
    a, b = index.halves(x)
    assert np.mean([cells[i] in index.visits(a[i], b[i]) for i in range(400)]) > 0.99


def test_multi_index_streams_asking_rows():
    """Asking rows are compared batch by batch, none held until their block ends."""
    import pandas as pd

    rng = np.random.default_rng(13)
    rows = [(rng.normal(size=8) * 0.02 + 1).tolist() for _ in range(60)]
    frame = pd.DataFrame({"cell": 1, "block": 0, "asks": [False] * 20 + [True] * 40, "node": range(60), "vector": rows, "n": 1})
    taken = []

    def batches():
        for at in range(0, 60, 10):
            taken.append(at)
            yield frame.iloc[at : at + 10]

    seen, out = [], []
    for pdf in multiindex.comparison(0.9)(batches()):
        seen.append(len(taken))
        out.append(pdf)
    assert seen == [3, 3, 4, 5, 6]
    out = pd.concat(out)
    sums = out[out["b"].isna()].groupby("a")["n"].sum()
    assert (sums[:20] == 59).all() and (sums[20:] == 20).all() and len(sums) == 60
    assert out["b"].notna().sum() == 59


def test_multi_sequence_order():
    index = multiindex.MultiIndex(multiindex.unit(np.random.default_rng(1).normal(size=(200, 8))), 6, 0.9, 0.99)
    index.margin = 1e9
    a, b = np.random.default_rng(2).random(len(index.books[0])), np.random.default_rng(3).random(len(index.books[1]))
    sums = [a[c // len(b)] + b[c % len(b)] for c in index.visits(a, b)]
    assert sums == sorted(sums) and len(sums) == len(a) * len(b)


# 8 chroma


def test_chroma_search(spark, none):
    rng = np.random.default_rng(8)
    t = np.arange(24_000)
    song = lambda k: np.clip(128 + 50 * np.sin(2 * np.pi * t * (110 * 2 ** (rng.integers(0, 24, 48) / 12)).repeat(500) / chroma.RATE) + rng.normal(0, 4, len(t)), 0, 255).astype(np.uint8)
    songs = [song(k) for k in range(8)]
    late = songs[0][chroma.HOP * 20 :]
    noisy = np.clip(songs[1].astype(int) + rng.integers(-1, 2, len(t)), 0, 255).astype(np.uint8)
    cut = np.concatenate([songs[3][: chroma.HOP * 80], songs[3][chroma.HOP * 103 :]])
    other = np.concatenate([songs[4][: chroma.HOP * 70], songs[5][chroma.HOP * 70 :]])
    more = [cut.tobytes(), other.tobytes()]
    data = [s.tobytes() for s in songs] + [late.tobytes(), noisy.tobytes(), songs[2].tobytes(), None, b"", b"\x80" * 5000, *more]
    df = spark.createDataFrame([(i, d, 1, 2) for i, d in enumerate(data)], "id long, data binary, item int, places int").repartition(3)
    got = {r["id"]: r for r in chroma.search(df, "id < 8").collect()}
    assert len(got) == len(data)
    assert got[8]["query_class"] == 0 and got[8]["offset"] == 20 and got[8]["bit_error"] == 0
    assert got[9]["query_class"] == 1 and got[9]["bit_error"] < 0.03
    assert got[10]["class_id"] == 2 and got[10]["n_links"] == 1
    assert all(got[i]["n_items"] == 0 and got[i]["class_id"] == i and got[i]["n_links"] == 0 for i in (11, 12, 13))
    # a copy with a piece cut out, and one that goes over into another song
    assert got[14]["query_class"] == 3 and got[14]["overlap"] >= chroma.LEAST_RUN and got[14]["offset"] in (0, 23)
    assert got[15]["n_links"] == 2 and got[15]["query_class"] in (4, 5)
    prints = {i: chroma.fingerprint(d) for i, d in enumerate(data)}
    want = set()
    for q in range(8):
        for r in range(len(data)):
            a, b = prints[q], prints[r]
            if q == r or not len(a[0]) or not len(b[0]):
                continue
            at = {int(t): int(x) for t, x in zip(*b, strict=True)}
            for o in range(-len(b[0]) - 20, len(a[0]) + 20):
                wrong = [(int(x) ^ at[int(t) - o]).bit_count() / 32 for t, x in zip(*a, strict=True) if int(t) - o in at]
                runs = (wrong[i : i + chroma.LEAST_RUN] for i in range(len(wrong) - chroma.LEAST_RUN + 1))
                if len(wrong) >= chroma.LEAST_OVERLAP and np.mean(wrong) <= chroma.MOST_ERROR or any(np.mean(w) <= chroma.MOST_ERROR / 2 for w in runs):
                    want.add((q, r))
    found = sum(got[r]["n_links"] for r in got)
    assert len(want) > 0 and found >= 0.9 * len(want)
    assert chroma.search(df.limit(0), "id < 8").count() == 0


# 9 language


def test_language_held_out(spark, sf):
    got = queries.op9_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) and (held.lang_pred == held.lang).mean() >= 0.9
    assert got.score.between(0, 1).all()


def test_language_odd_rows(odd, none):
    model = langid.train(odd)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd, model).collect()}
    assert got[0] == got[1] == got[2] == "und" and set(got.values()) <= {"und", "en", "de"}
    empty = langid.train(none)
    assert langid.identify(odd, empty).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(none, model).count() == 0


def test_forward_sums_all_segmentations(monkeypatch):
    """Every segmentation of random words, one by one; also where sums are kept as logarithms."""
    rng = np.random.default_rng(0)
    pieces = ["a", "ab", "b", "▁", "ba", "aba", "bab", "▁a", "c"]
    p = rng.random((len(pieces), 2))
    model = langid.PieceModel(["x", "y"], pieces, p / p.sum(axis=0))

    def brute(word, at=0):
        if at == len(word):
            return np.ones(2)
        found = [model.probabilities[k] * brute(word, at + len(piece)) for k, piece in enumerate(pieces) if word.startswith(piece, at)]
        return sum(found, langid.UNKNOWN * brute(word, at + 1))

    ws = ["".join(rng.choice(list("abcz"), rng.integers(1, 12))) for _ in range(40)]
    for short in (40, 0):
        monkeypatch.setattr(langid, "SHORT", short)
        assert np.exp(model.score(ws)) == pytest.approx(np.array([brute("▁" + w) for w in ws]), rel=1e-9)
        x = model.lattice(["▁" + w for w in ws])
        assert model.sums(x, backward=True)[x.first] == pytest.approx(model.sums(x)[x.first + x.length])


def test_long_words_count(spark):
    """Words of any length are fitted and scored whole: text without spaces is told apart."""
    rng = np.random.default_rng(1)
    scripts = {"zh": [chr(c) for c in range(0x4E00, 0x4E40)], "ja": [chr(c) for c in range(0x3042, 0x3082)]}
    rows = [(i, "".join(rng.choice(scripts[lang], 400)), lang) for i, lang in enumerate(["zh", "ja"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.where("doc_id < 20"))
    assert all(r["lang"] == r["lang_pred"] for r in langid.identify(docs, model).collect())
    once, twice = model.score(["ab" * 300, "ab" * 600])
    assert np.isfinite(twice).all() and (twice < once).all()
    assert max(map(len, model.pieces)) > 10


# 10 SimHash


def plain_simhash(text, words=3):
    ws = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + words]).encode(), 42) for i in range(max(1, len(ws) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_links(odd, none, spark):
    rng = np.random.default_rng(3)
    near = [(int(v) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))) & (2**64 - 1) for v in rng.integers(0, 2**63, 30) for _ in range(12)]
    near = list(dict.fromkeys(near))
    fps = spark.createDataFrame([(i, v - 2**64 if v >= 2**63 else v) for i, v in enumerate(near)], "node long, fp long")
    from fieldmark.llm.common import Forest, components

    for shard in (4096, 5):
        got = {r["node"]: r["component_id"] for r in components(simhash.hamming_links(fps, 3, shard)).collect()}
        forest = Forest()
        for i, a in enumerate(near):
            for j in range(i):
                if (a ^ near[j]).bit_count() <= 3:
                    forest.join(i, j)
        assert all(got.get(i, i) == forest.find(i) for i in range(len(near)))
    found = by_id(simhash.near_duplicates(odd), "fp", "component_id")
    for i, t in enumerate(TEXTS):
        assert found[i][0] & (2**64 - 1) == plain_simhash(t)
    assert found[5][1] == found[6][1] == 4 and found[1][1] == found[2][1] == 0
    assert simhash.near_duplicates(none).count() == 0


def test_similar_documents(spark, none, odd):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(12):
        ws = [f"w{x}" for x in rng.integers(0, 5000, 400)]
        rows.append((len(rows), " ".join(ws)))
        for changes in (2, 6, 60):
            new = ws.copy()
            for i in rng.choice(400, changes, replace=False):
                new[i] = f"n{rng.integers(10**9)}"
            rows.append((len(rows), " ".join(new)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(396)} for _, t in rows]
    got = by_id(simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), "component_id")
    caught = total = 0
    for i in range(len(rows)):
        for j in range(i):
            s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if s >= 0.8:
                total += 1
                caught += got[i] == got[j]
            elif i // 4 != j // 4:
                assert got[i] != got[j]
    assert total >= 24 and caught >= 0.9 * total
    assert simhash.similar_documents(none).count() == 0
    assert simhash.similar_documents(odd).count() == odd.count()


def test_similar_documents_templates(spark):
    """Similar pairs in a crowd of texts that are nearly similar to one another."""
    rng = np.random.default_rng(11)
    base = [f"w{x}" for x in rng.integers(0, 5000, 400)]

    def changed(ws, at):
        new = list(ws)
        for i in at:
            new[i] = f"n{rng.integers(10**9)}"
        return new

    texts = []
    for _ in range(150):
        one = changed(base, rng.choice(400, 5, replace=False))
        texts += [one, changed(one, rng.choice(400, 8, replace=False))]
    sets = [{tuple(t[i : i + 5]) for i in range(396)} for t in texts]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = by_id(simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), "component_id")
    from fieldmark.llm.common import Forest

    forest, pairs = Forest(), 0
    for i in range(300):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                pairs += 1
                forest.join(i, j)
    assert pairs >= 150
    assert all(forest.find(i) == forest.find(c) for i, (c,) in got.items())
    assert len({c for c, in got.values()}) <= len({forest.find(i) for i in range(300)}) + 4


# clashing names


@pytest.fixture(scope="module")
def clash(odd):
    return odd.withColumns({c: F.concat(F.lit("kept "), F.col("doc_id").cast("string")) for c in NAMES})


@pytest.mark.parametrize(
    ("operator", "made"),
    [
        (lambda d: mixing.mix(d, {"lang": None, "source": None}, 0.5), ("n_tokens", "weight", "probability", "kept")),
        (lambda d: langid.identify(d, langid.train(d)), ("lang_pred", "score")),
        (lambda d: bpe.encode(d), ("token_ids", "text")),
        (lambda d: bpe.decode(bpe.encode(d)), ("token_ids", "text", "decoded")),
        (lambda d: simhash.fingerprints(d), ("fp", "text")),
        (lambda d: pii.pseudonymise(d, "k", count="found"), ("found",)),
    ],
)
def test_clashing_columns_stay(clash, none, operator, made):
    """Every column that the operator doesn't make is as it was."""
    got = operator(clash)
    stay = [c for c in NAMES if c not in made]
    assert set(stay) <= set(got.columns) and len(got.columns) == len(set(got.columns))
    rows = got.select("doc_id", *stay).collect()
    assert len(rows) == clash.count()
    assert all(r[c] == (None if r["doc_id"] is None else f"kept {r['doc_id']}") for r in rows for c in stay)
    assert operator(none.withColumns({c: F.lit("x") for c in NAMES})).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(clash, none, k):
    """Nulls, empties, repeats, long texts and clashing names, stage by stage."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    name, stage = corpus_pipeline.STAGES[k]
    got = stage(clash.sparkSession, clash, "")
    made = {"tokens": {"token_ids", "n_tokens"}}.get(name, set())
    assert set(got.columns) == set(clash.columns) | made - ({"text"} if name == "tokens" else set()) or name == "tokens"
    stay = [c for c in NAMES if c not in made]
    rows = got.select("doc_id", *stay).collect()
    assert rows and all(r[c] == (None if r["doc_id"] is None else f"kept {r['doc_id']}") for r in rows for c in stay)
    ids = [r["doc_id"] for r in rows]
    want = [r["doc_id"] for r in clash.select("doc_id").collect()]
    assert set(ids) <= set(want) and (name not in ("pseudonyms", "tokens") or len(ids) == len(want))
    if name == "near_copies":
        assert None in ids and 5 not in ids and 6 not in ids and 4 in ids
    if name == "language":
        assert not {0, 1, 2} & set(ids)
    assert stage(clash.sparkSession, none.withColumns({c: F.lit("x") for c in NAMES}), "").count() == 0


# pipeline


def test_pipeline(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from fieldmark.llm.common import saved

    seen = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = saved(stage(spark, seen, sf))
        assert after.dtypes == docs.dtypes and 0 < after.count() <= seen.count()
        assert after.groupBy("doc_id").count().where("count > 1").count() == 0
        seen = after
    last = corpus_pipeline.STAGES[-1][1](spark, seen, sf)
    back = by_id(bpe.decode(last), "decoded")
    want = by_id(seen, "text")
    assert {k: bytes(v[0]).decode() for k, v in back.items()} == {k: v[0] for k, v in want.items()}
    sources = defaultdict(int)
    for r in last.collect():
        sources[r["source"]] += r["n_tokens"]
    assert len(sources) > 10
