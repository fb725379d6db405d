"""Five stages from raw documents to encoded training rows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the docs of the next.
All but the last return the columns of documents.

Defined results, for every stage: an empty table gives an empty result of the same columns; columns that clash with those made on the way are kept as they
are; rows that repeat are judged alike. By stage:

- language ID: texts that are null, empty or without letters are no text of any language and go; where no row has a label nothing can be told, and all go.
- near-dedup: null and empty texts stay; of equal rows one stays, and of a group the row of the least doc_id, a null one before any other.
- secret scans: null and empty texts stay as they are; n_chars of a null text is null; equal rows are masked alike.
- source mixing: a null source is a source of its own; a null n_chars counts as 0; rows that repeat a doc_id draw the same count.
- encoding: a null text is an empty text, of no tokens.

Texts are never cut, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from recordmill.llm.encoding import encode_decode
from recordmill.llm.langid import UND, fitted, identify
from recordmill.llm.mixing import replicated, source_rates
from recordmill.llm.secrets import masked
from recordmill.llm.simhash import one_of_each_group
from recordmill.session import let_workers_import, read_table, stored

#: Documents of a known language whose best language has less than this share of all positions are no text of any language.
LEAST_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those that look like no known language, go. Nothing else changes."""
    let_workers_import(spark)
    model = fitted(docs.select("doc_id", "text", "lang"))
    found = identify(docs, model)
    return found.where((F.col("lang_pred") != UND) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays."""
    let_workers_import(spark)
    return one_of_each_group(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts, and n_chars counts the masked text; no document goes."""
    let_workers_import(spark)
    out = masked(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out to reach the target weights of their sources, in a new global order."""
    let_workers_import(spark)
    return replicated(docs, source_rates(docs.select("source", "n_chars"))).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of what they decode to."""
    import public_tokenizers

    let_workers_import(spark)
    out = encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), ids=True)
    return out.select("doc_id", "lang", "source", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language ID", language_stage),
    ("SimHash near-dedup", dedup_stage),
    ("secret scans", secrets_stage),
    ("source mixing", mixing_stage),
    ("SentencePiece encoding", encoding_stage),
]

#: The network of the first stage and the vocabulary of the last can't be written in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = stored(stage(spark, docs, sf_dir), f"stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
