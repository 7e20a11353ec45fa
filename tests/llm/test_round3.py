"""Phrase mining, main text and hard negatives against brute force, with odd rows."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from fieldmark.llm import bpe, chroma, common, langid, multiindex, negatives, phrases, webtext

# 11 phrases


def mined(rows, least, top, covered=80):
    """By plain loops over all phrases."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def corpus(seed, n=300):
    rng = np.random.default_rng(seed)
    stock = ["The", "the", "of", "a", "über", "x y", "\u001c", "naïve", "😀", "it's", "-", "z"]
    rows = []
    for i in range(n):
        text = "".join(stock[min(int(rng.geometric(0.3)) - 1, 11)] + [" ", "  ", "\t", ". ", "\n", ", ", " ", " ", " ", ";"][int(rng.integers(10))] for _ in range(int(rng.integers(0, 60))))
        rows.append(([None, "en", "und", "en", "de"][i % 5], text))
    return [*rows, ("en", None), ("en", ""), (None, " .. \n"), ("fr", "one two"), ("en", rows[1][1]), ("en", rows[1][1])]


@pytest.mark.parametrize(("lot", "most", "limits"), [(1 << 20, 4_000_000, (400_000, 1_500_000)), (7, 3, (3, 40))])
def test_phrases(spark, monkeypatch, lot, most, limits):
    """Also with texts cut into tiny lots, counts sent early, and the bitmap in place of hashes."""
    monkeypatch.setattr(phrases, "LOT", lot)
    monkeypatch.setattr(phrases, "MOST", most)
    monkeypatch.setattr(phrases, "WORDS", limits[0])
    monkeypatch.setattr(phrases, "PHRASES", limits[1])
    rows = corpus(1)
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "lang string, text string, f int, phrase int, n int").repartition(3)
    # tasks import the module anew, so sizes go along as defaults of this test's process only
    for top in (2000, 5):
        got = sorted(tuple(r) for r in phrases.mine(docs, 12, top).collect())
        assert got == mined(rows, 12, top)
    assert len(got) > 8


def test_phrase_lots_in_process(monkeypatch):
    """Lots of any size count the same phrases."""
    import pyarrow as pa

    rows = [(lang or "und", t) for lang, t in corpus(2, 60) if t] + [("en", "long word " * 5000)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["lang", "text"])

    every = phrases.Frequent(bitmap=np.full(1 << (phrases.BITS - 6), 2**64 - 1, np.uint64))

    def total(k):
        out = Counter()
        for b in phrases.counted(k, every, [batch]) if k > 1 else phrases.counted_words([batch]):
            for r in b.to_pylist():
                out[r["lang"], r["phrase"]] += r["f"]
        return out

    whole = [total(k) for k in (1, 2, 3, 4)]
    monkeypatch.setattr(phrases, "LOT", 5)
    monkeypatch.setattr(phrases, "WORDS", 4)
    assert [total(k) for k in (1, 2, 3, 4)] == whole
    assert whole[1]["en", "long word"] == 5000 and whole[1]["en", "word long"] == 4999


def test_bitmap_and_hashes_agree(spark, monkeypatch):
    level = spark.createDataFrame([("en", f"w{i} v{i % 7}", 30) for i in range(500)], "lang string, phrase string, f long")
    exact = phrases.frequent(level)
    monkeypatch.setattr(phrases, "MOST", 10)
    coarse = phrases.frequent(level)
    assert coarse.bitmap is not None and len(exact.hashes) == 500
    assert exact.has(exact.hashes).all() and coarse.has(exact.hashes).all()
    other = np.random.default_rng(1).integers(0, 2**63, 100_000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    assert coarse.has(other).mean() < 0.001 and not exact.has(other).any()
    assert not phrases.Frequent(np.zeros(0, np.uint64)).has(other).any()


@pytest.mark.parametrize("most", [4_000_000, 10])
def test_frequent_phrases_reach_the_driver_as_bytes(spark, monkeypatch, most):
    """What the driver gathers of 400,000 phrases is of the size of their hashes or bits, not of rows."""
    import tracemalloc

    level = spark.range(400_000).selectExpr("'en' as lang", "concat('w', id % 1000, ' v', id div 1000) as phrase", "id as f")
    monkeypatch.setattr(phrases, "MOST", most)
    monkeypatch.setattr(phrases, "BITS", 24)
    tracemalloc.start()
    known = phrases.frequent(level)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6
    some = [(f"w{i % 1000}".encode(), f"v{i // 1000}".encode()) for i in range(0, 400_000, 997)]
    h = np.array([phrases.follow(phrases.follow(np.array([phrases.start("en")]), np.array([xxhash.xxh64_intdigest(a)], np.uint64)), np.array([xxhash.xxh64_intdigest(b)], np.uint64))[0] for a, b in some])
    assert known.has(h).all()


def test_phrases_scores_beyond_64_bits(spark):
    """2000000 * a passes 64 bits from 4.7e12 on; decimals keep it."""
    got = spark.sql("select cast(2000000BD * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0))) as bigint) as s from values (9000000000000000000L, 9100000000000000000L, 9200000000000000000L) t(a, l, r)").first()[0]
    assert got == 2_000_000 * 9 * 10**18 // (91 * 10**17 + 92 * 10**17)


def test_phrases_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.mine(empty).count() == 0
    assert phrases.mine(spark.createDataFrame([("en", None), (None, "")], "lang string, text string")).count() == 0


# 12 main text

LEAD = "This is the first paragraph of the text and it is long enough to be taken as a part of the article, since it has many of the words that are in all texts of this kind, and it goes on for a while until the end."
MORE = "And this is the second paragraph of the text; it was written by the same hand and it has been in the paper for a long time, which you may see if you look at it with the care that it asks for."

PAGES = [
    (None, ""),
    ("", ""),
    ("   \n ", ""),
    ("<article>one<p>two <b>three</b>four<br>five</article>", "one\ntwo threefour five"),
    ("<nav>menu</nav><header>top</header><article><header><h1>Title</h1></header><p>a&nbsp;&amp;\n b</p><aside>side</aside><p>c</p><footer>by me</footer></article><footer>end</footer>", "Title\na & b\nc"),
    ("<main><p>x<script>var a = '<p>no</p>';</script>y</p><style>p{}</style><form><p>mail</p></form></main>", "xy"),
    ("<form action=/><div class=menu>m</div><article>in a form</article></form>", "in a form"),
    ("<article>a<section class='comments'><article class=comment><p>me too</p></article></section><div class='ad'>buy</div><div class='has-ads'>kept</div></article>", "a\nkept"),
    ("<article><!-- <p>gone</p> -->stays<!-- open", "stays"),
    ("<article><p title=it's>Hello</p><p>b's <i>it</i></article>", "Hello\nb's it"),
    ("<article><p data-id='ad' aria-hidden='false'>kept</p><p hidden>not</p><p class='cookie-notice'>no</p></article>", "kept"),
    ("<article>1 < 2 &lt;b&gt; a<2>b &#8364; &#xD800; &am</article>", "1 < 2 <b> a<2>b € � &am"),
    ("<article><table><tr><td>a<td>b<tr><td>c</table><ul><li>d<li><p>e</ul></article>", "a\nb\nc\nd\ne"),
    ("<article>cut of<p>f in the mid", "cut of\nf in the mid"),
    ("<ARTICLE><P>Upper<SCRIPT>x</SCRIPT></P></ARTICLE>", "Upper"),
    ("<nav>no end<article>text</article>", "text"),
    ("<p>Short and alone.</p>", ""),
    (f"<header><a href=/>Site</a></header><div class='nav'><a href=1>a</a></div><div><h2>Head</h2><p>{LEAD}</p><p>Short.</p><p>{MORE}</p></div><div class='cookie-notice'>{LEAD}</div><p>&copy; me</p>", f"Head\n{LEAD}\nShort.\n{MORE}"),
    (f"<p><a href=1>One link of many words that are all part of it</a> <a href=2>Two</a></p><p>{LEAD}</p><p>Tail.</p><p>Last.</p><p>{MORE}</p>", f"{LEAD}\nTail.\nLast.\n{MORE}"),
    ("<div role=navigation>n</div><div role=main>m</div><div role=contentinfo>c</div>", "m"),
]


def test_main_text_by_cases():
    assert [webtext.main_text(page) for page, _ in PAGES] == [text for _, text in PAGES]


def test_main_text_of_made_up_articles(spark):
    """Blocks of any words, lengths and inline markup come back whole; the page around them does not."""
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for i in range(300):
        lines = [" ".join(["w%d" % rng.integers(9)] * int(rng.integers(1, 4)) + list(rng.choice(["der", "la", "x&y", "<", "é", "ab|cd"], int(rng.integers(0, 60))))) for _ in range(int(rng.integers(0, 12)))]
        tag = [("<p>", "</p>"), ("<p><b>", "<br>"), ("<h2>", "</h2>"), ("<div>", "</div>"), ("<li>", ""), ("<blockquote><p>", "</blockquote>")]
        body = ""
        for line in lines:
            before, after = tag[int(rng.integers(6))]
            body += before + line.replace("&", "&amp;").replace("<", "&lt;").replace(" w", " <i>w</i>" if "w" == "v" else "\n\t w") + after
            body += ["", "<aside>aside</aside>", "<div class='share-buttons'>share</div>", "<script>'</p>'</script>"][int(rng.integers(4))]
        page = f"<html lang=en><head><title>t</title></head><body class='with-sidebar'><nav><ul><li><a href=1>{LEAD}</a></ul></nav><div class=ad>{LEAD}</div><article>{body}</article><div id=comments><p>{MORE}</p></div><footer>&copy;</footer>"
        rows.append((i, f"u{i}", page, "x", 5))
        want[i] = "\n".join(lines)
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, N_CHARS int").repartition(3)
    got = webtext.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    for r in got.collect():
        assert r.text == want[r.page_id] and r.n_chars == len(r.text)
    assert webtext.extract(df.limit(0)).count() == 0


def test_main_text_takes_time_in_proportion():
    import time

    for page in ("<div>" * 100_000, "<!--" * 100_000, '<a href="x' * 50_000, "&" * 100_000, "<li>" * 50_000, "<div>" * 1000 + "</p>" * 50_000, "=' <a b='" * 50_000, "<title>" * 20_000, "<article>" + "<p>word " * 100_000):
        began = time.time()
        webtext.main_text(page)
        assert time.time() - began < 20


# 13 hard negatives


def hard(rows, anchors, k=5, m=10):
    rows = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rows = [r for r in rows if sum(x * x for x in r[2]) < 2**62]
    seen, out = set(), []
    for i, label, v in rows:
        if i not in anchors or (i, label, tuple(v)) in seen:
            continue
        seen.add((i, label, tuple(v)))
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), j, x) for j, x, w in rows if len(w) == len(v)]
        for s, j in sorted((s, j) for s, j, x in scored if x == label and j != i)[:k]:
            found = sorted((t, o) for t, o, x in scored if x != label and -30 * s <= -100 * t <= -90 * s)[:m]
            out += [(i, j, rank, o, -s, -t) for rank, (t, o) in enumerate(found, 1)]
    return sorted(out)


def vectors(seed, n=400, dim=8, scale=0.3):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=dim) * scale + 0.1, 2)], int(rng.integers(4))) for i in range(n)]
    rows += [(n + i, rows[3][1], i % 3) for i in range(60)]  # ties across labels
    rows += [rows[20], rows[20], (40, rows[5][1], 9), (None, rows[1][1], 1), (1000, None, 1), (1001, rows[2][1], None), (1002, [1.0, None], 2), (1003, [float("nan")] * dim, 2), (1004, [float("inf")] * dim, 2), (1005, [], 1), (1006, [], 2), (1007, [1e300] * dim, 1), (1008, rows[6][1][:3], 1), (1009, [0.0] * dim, 3)]
    return rows


@pytest.mark.parametrize("chunk", [2048, 3])
def test_negatives(spark, monkeypatch, chunk):
    monkeypatch.setattr(negatives, "CHUNK", chunk)
    rows = vectors(1)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, w int, score string").repartition(5)
    got = sorted(tuple(r) for r in negatives.mine(df, "vec_id % 20 = 0").collect())
    want = hard(rows, {i for i, *_ in rows if i is not None and i % 20 == 0})
    assert got == want and len(want) > 500


def test_negatives_of_large_components(spark):
    """Products beyond 2**53 stay exact."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-(2**20), 2**20, 4)], i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r) for r in negatives.mine(df, "vec_id < 9").collect()) == hard(rows, set(range(9)))


def test_negatives_of_nothing(spark):
    df = spark.createDataFrame([(1, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(df.limit(0), "vec_id % 100 = 0").count() == 0
    assert negatives.mine(df, "vec_id = 7").count() == 0
    assert negatives.mine(df, "vec_id = 1").count() == 0


def test_products_choose_a_safe_way():
    rng = np.random.default_rng(4)
    for bits in (4, 20, 27, 29):
        a, b = (rng.integers(-(2**bits), 2**bits, (7, 5)) for _ in range(2))
        want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
        assert negatives.products(a, b).tolist() == want


# earlier operators: repeated ids, doubles, memory


def test_language_sample_is_bounded(spark, monkeypatch):
    """Repeated ids and rows fill no more than the sample's places, and rows without id none."""
    seen = []
    monkeypatch.setattr(langid, "fit", lambda counts, pieces: seen.append(counts))
    rows = [(7, f"wort{i}", "de") for i in range(500)] + [(8, "same", "de")] * 400 + [(None, "none", "de")] * 50 + [(i, "one", "en") for i in range(20)]
    langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), docs_per_language=30)
    counts = seen[0]
    assert counts[counts.lang == "de"].n.sum() == 30 and counts[counts.lang == "en"].n.sum() == 20
    assert "none" not in set(counts.word) and counts[counts.word == "same"].n.sum() <= 1


def test_multi_index_keeps_doubles(spark):
    rows = [(1, [1e39, 0.0]), (2, [2e39, 0.0]), (3, [1e-50, 0.0]), (4, [1.0, 0.0]), (5, [0.0, 1e300]), (6, [1e-320, 1e-310]), (7, [float("inf"), 1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in multiindex.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 7: (0, 7)}


def test_batches_of_long_texts_are_bounded(spark):
    """Many long texts reach Python in small batches, in every operator that bounds them."""
    from pyspark.sql import functions as F

    common.small_batches(spark)

    @F.pandas_udf("long")
    def size(texts):
        return texts.str.len() * 0 + texts.str.len().sum()

    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("lorem ipsum "), 10_000).alias("text")).coalesce(1)
    assert docs.select(F.max(size("text"))).first()[0] <= 6 << 20
    sizes = {r.n for r in bpe.encode(docs, memo=1 << 16).select((F.octet_length("token_ids") / 4).cast("long").alias("n")).collect()}
    assert len(sizes) == 1 and sizes.pop() > 20_000


def plain_items(image):
    """Filters, levels and packing by loops over the image."""
    out = {}
    for t in range(len(image) - chroma.WINDOW + 1):
        def area(t0, t1, p0, p1, t=t):
            return sum(float(image[t + i][p]) for i in range(t0, t1) for p in range(p0, p1))

        if not area(0, chroma.WINDOW, 0, 12) > 0:
            continue
        item = 0
        for k in range(16):
            height, width, kind = (4, 6, 8, 12)[k % 4], (4, 8, 16, 12)[(k + k // 4) % 4], k % 6
            p = 5 * k % (13 - height)
            half, quarter, h2, w2, w4 = height // 2, height // 4, p + height // 2, width // 2, width // 4
            whole = area(0, width, p, p + height)
            part = {
                0: whole, 1: area(0, width, p, h2), 2: area(0, w2, p, p + height), 3: area(0, w2, p, h2) + area(w2, width, h2, p + height),
                4: area(0, width, p + quarter, p + height - quarter), 5: area(w4, width - w4, p, p + height),
            }[kind]
            rest = area(0, width, 0, 12) * height / 12 if kind == 0 else whole - part
            assert half
            level = sum(part + 1 > (rest + 1) * x for x in chroma.RATIOS[k])
            item = item << 2 | (0, 1, 3, 2)[level]
        out[t] = item
    return out


def test_fingerprint_by_plain_loops():
    rng = np.random.default_rng(12)
    t = np.arange(14_000)
    tone = 128 + 60 * np.sin(2 * np.pi * t * 220 / chroma.RATE) + rng.normal(0, 10, len(t))
    for samples in (tone, rng.integers(0, 256, 9000), np.concatenate([np.full(5000, 128), tone[:6000]]), np.frombuffer(("lorem ipsum dolor sit amet " * 150).encode(), np.uint8)):
        data = np.clip(samples, 0, 255).astype(np.uint8)
        image = chroma.chroma(data)
        places, items = chroma.fingerprint(data.tobytes())
        assert dict(zip(places.tolist(), items.tolist(), strict=True)) == plain_items(image)
        # the image itself: a plain transform of one frame in the middle
        k, want = len(image) // 2, np.zeros(12)
        for j, weight in enumerate(chroma.SMOOTH):
            x = (data[(k + j) * chroma.HOP :][: chroma.FRAME].astype(float) - 128) / 128 * np.hanning(chroma.FRAME)
            for b in range(chroma.FRAME // 2 + 1):
                hz = b * chroma.RATE / chroma.FRAME
                if chroma.LOWEST <= hz <= chroma.HIGHEST:
                    power = abs(sum(x * np.exp(-2j * np.pi * b * np.arange(chroma.FRAME) / chroma.FRAME))) ** 2
                    want[round(12 * math.log2(hz / 440)) % 12] += weight * power
        size = math.sqrt((want**2).sum())
        assert image[k] == pytest.approx(want / size if size > 0.01 else want * 0, abs=1e-3)


def test_matches_at_every_offset(spark):
    """A recording that repeats a passage in five places is found by a query of the passage, at the best of all offsets."""
    rng = np.random.default_rng(15)
    t = np.arange(chroma.HOP * 60)
    passage = np.clip(128 + 50 * np.sin(2 * np.pi * t * (110 * 2 ** (rng.integers(0, 24, 60) / 12)).repeat(chroma.HOP) / chroma.RATE), 0, 255).astype(np.uint8)
    damaged = [np.clip(passage.astype(int) + rng.normal(0, s, len(passage)).astype(int), 0, 255).astype(np.uint8) for s in (9, 7, 5, 3)]
    filler = lambda: rng.integers(0, 256, chroma.HOP * 40).astype(np.uint8)
    whole = np.concatenate([x for d in damaged for x in (d, filler())] + [passage, filler()])
    df = spark.createDataFrame([(0, passage.tobytes()), (1, whole.tobytes())], "id long, data binary")
    got = {r["id"]: r for r in chroma.search(df, "id = 0").collect()}
    assert got[1]["query_class"] == 0 and got[1]["bit_error"] == 0 and got[1]["offset"] == -4 * 100
