"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm import bpe, chroma, langid, mixing, multiindex, negatives, phrases, pii, sharding, simhash, suffixdedup, tokenfile, webtext


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Target shares of op1's margins; sources share equally.
LANGUAGES = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}
TOPICS = {"prose": 0.8, "table": 0.1, "credentials": 0.1}
#: Part of all tokens that op1 keeps in expectation.
FRACTION = 0.5


def topic(text: Column) -> Column:
    """The tables name no topic; a coarse one from the text's form stands in."""
    return F.when(text.contains(" | "), "table").when(text.contains("token = "), "credentials").otherwise("prose")


def op1_raked_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its raked weight, its probability and whether it is drawn."""
    docs = _table(spark, sf_dir, "documents").withColumn("topic", topic(F.col("text")))
    mixed = mixing.mix(docs, {"source": None, "lang": LANGUAGES, "topic": TOPICS}, FRACTION)
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 4).alias("weight"), F.round("probability", 4).alias("probability"), "kept")


OP1_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, 'token = ') THEN 'credentials' ELSE 'prose' END AS topic,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens
  FROM documents),
cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
named AS (
  SELECT c.*, 1.0 / (SELECT count(DISTINCT source) FROM cells)::DOUBLE AS ts, l.share AS tl, t.share AS tt
  FROM cells c
  JOIN (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in LANGUAGES.items())}) l(lang, share) ON c.lang = l.lang
  JOIN (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in TOPICS.items())}) t(topic, share) ON c.topic = t.topic),
present AS (SELECT (SELECT sum(tl) FROM (SELECT DISTINCT lang, tl FROM named)) AS l, (SELECT sum(tt) FROM (SELECT DISTINCT topic, tt FROM named)) AS t),
r AS (
  SELECT 0 AS i, source, lang, topic, tokens, ts, tl / l AS tl, tt / t AS tt, tokens AS share FROM named, present
  UNION ALL
  SELECT i + 1, source, lang, topic, tokens, ts, tl, tt,
         CASE i % 3 WHEN 0 THEN share * ts / sum(share) OVER (PARTITION BY source)
                    WHEN 1 THEN share * tl / sum(share) OVER (PARTITION BY lang)
                    ELSE share * tt / sum(share) OVER (PARTITION BY topic) END
  FROM r WHERE i < {3 * mixing.MOST_SWEEPS}),
raked AS (SELECT source, lang, topic, tokens, share FROM r WHERE i = {3 * mixing.MOST_SWEEPS}),
total AS (SELECT sum(tokens) AS n FROM cells),
steps AS (
  SELECT tokens / share AS need,
         ({FRACTION} * n - coalesce(sum(tokens) OVER (ORDER BY tokens / share, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(share) OVER (ORDER BY tokens / share, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale
  FROM raked, total),
one AS (SELECT min_by(scale, need) AS scale FROM steps WHERE scale <= need),
found AS (SELECT source, lang, topic, share * n / tokens AS weight, least(1.0, coalesce(scale * share / tokens, 1.0)) AS probability FROM raked, total, one),
every AS (
  SELECT d.*, CASE WHEN n_tokens > 0 THEN coalesce(weight, 0) ELSE 0 END AS w, CASE WHEN n_tokens > 0 THEN coalesce(probability, 0) ELSE 0 END AS p
  FROM d LEFT JOIN found f ON d.source IS NOT DISTINCT FROM f.source AND d.lang IS NOT DISTINCT FROM f.lang AND d.topic = f.topic)
SELECT doc_id, source, lang, topic, n_tokens, round(w, 4) AS weight, round(p, 4) AS probability,
       ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 < p AS kept
FROM every
"""


def op2_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), 24)


def op3_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 100 bytes that came before."""
    out = suffixdedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Key of op4's pseudonyms; whoever runs it over private data names one of their own.
PII_KEY = "fieldmark-public-example-key"


def op4_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by format-preserving pseudonyms."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY, count="n_replaced")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of what they decode to."""
    return bpe.round_trip(_table(spark, sf_dir, "documents"))


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the token files, as read back from them."""
    return tokenfile.token_file_digest(_table(spark, sf_dir, "documents"))


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and near-duplicate group of every embedding."""
    return multiindex.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_chroma_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings that match every hundredth one. The tables hold no media, so each
    document's bytes stand for a recording of 8-bit samples."""
    media = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("data"))
    return chroma.search(media, "id % 100 = 0").withColumnRenamed("id", "doc_id").withColumn("bit_error", F.round("bit_error", 6))


def held_out(id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 4 == 2, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; fitted on those not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out()))
    return langid.identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


def op10_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash and near-duplicate group of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_apriori_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2000 phrases of every language."""
    return phrases.mine(_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, w, unnest(range(1, 5)) AS k FROM words),
spans AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM grams)),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM spans GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, 2000000 * c.a // (x.f + y.f) AS score
  FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.k = c.cut AND x.phrase = array_to_string(c.w[1 : c.cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.k = c.k - c.cut AND y.phrase = array_to_string(c.w[c.cut + 1 : c.k], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2))
  GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase)::BIGINT AS rank, b.phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM best b JOIN n ON n.lang = b.lang LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
WHERE most IS NULL OR 100 * most < 80 * a
QUALIFY rank <= 2000
"""


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return webtext.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op13_radix_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding; every seventh row has its label moved on."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", moved), "vec_id % 100 = 0")


OP13_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor, r.vec_id AS id, a.label = r.label AS same, list_dot_product(a.q, r.q)::BIGINT AS score
  FROM rows a JOIN rows r ON a.vec_id % 100 = 0),
positives AS (
  SELECT anchor, id, score FROM scored WHERE same AND anchor <> id
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor = n.anchor AND NOT n.same AND 100 * n.score BETWEEN 30 * p.score AND 90 * p.score
QUALIFY rank <= 10
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_raked_mix": op1_raked_mix,
    "op2_minimax_shards": op2_minimax_shards,
    "op3_run_length_index": op3_run_length_index,
    "op4_feistel_pseudonyms": op4_feistel_pseudonyms,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_token_file": op6_token_file,
    "op7_multi_index": op7_multi_index,
    "op8_chroma_search": op8_chroma_search,
    "op9_language_id": op9_language_id,
    "op10_simhash_bk_trees": op10_simhash_bk_trees,
    "op11_apriori_phrases": op11_apriori_phrases,
    "op12_main_text": op12_main_text,
    "op13_radix_negatives": op13_radix_negatives,
}

ORACLE_SQL: dict[str, str] = {"op1_raked_mix": OP1_SQL, "op11_apriori_phrases": OP11_SQL, "op13_radix_negatives": OP13_SQL}
