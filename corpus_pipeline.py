"""Corpus pipeline: language, near copies, personal data, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each
stage's rows as Parquet in the cluster's shared folder and reads them again for the
next one, so a lost executor costs no finished stage. All stages but the last
return the columns of ``documents``; the last adds token ids.

Further columns are carried along under any name. Null ids stay as rows of their own
where a stage compares ids; null, empty and letterless texts go in the first stage;
repeated rows are one document to the second. Texts of any length are read whole, and
an empty table passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm import bpe, langid, mixing, pii, queries, simhash
from fieldmark.llm.common import numbered, saved

#: The prediction's score from which on a document counts as written in that language.
LEAST_SCORE = 0.5
#: Part of the tokens that the mix keeps in expectation.
MIX_FRACTION = 0.8
#: Bytes of results that a worker of the last stage remembers: the executors have run four stages before it.
TOKEN_MEMO = 24 << 20


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a learned language; ``lang`` becomes the prediction.

    Texts without a letter, null texts and undecided ones go.
    """
    rows, at = numbered(docs)
    found = langid.identify(rows, langid.train(docs), at["text"])
    sure = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).withColumn(at["lang"], F.col("lang_pred"))
    return sure.select(*[F.col(n).alias(c) for c, n in at.items()])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts: that of the smallest id.

    Five words and a similarity of 0.8 make texts similar. A row without id stays,
    since no id can be the smallest of its group.
    """
    found = simhash.similar_documents(docs)
    keep = found.where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(*docs.columns)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal data; ``n_chars`` follows the text."""
    out = pii.pseudonymise(docs, queries.PII_KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics meet their targets."""
    rows, at = numbered(docs)
    tagged = rows.withColumn("topic", queries.topic(F.col(at["text"])))
    targets = {at["source"]: None, at["lang"]: queries.LANGUAGES, "topic": queries.TOPICS}
    mixed = mixing.mix(tagged, targets, MIX_FRACTION, at["doc_id"], at["text"])
    return mixed.where("kept").select(*[F.col(n).alias(c) for c, n in at.items()])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns without text, plus ``token_ids`` and ``n_tokens``, which
    replace columns of these names.

    ``token_ids``: little-endian 32-bit ids, which decode to the text's bytes.
    """
    out = bpe.encode(docs, memo=TOKEN_MEMO)
    return out.withColumn("n_tokens", (F.octet_length("token_ids") / 4).cast("long"))


STAGES = [("language", language), ("near_copies", near_copies), ("pseudonyms", pseudonyms), ("mix", mix), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Model fitting and fingerprints are beyond SQL.
ORACLE_SQL = None
