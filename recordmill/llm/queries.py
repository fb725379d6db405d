"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordmill.session import read_table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordmill.llm.langid import op1

    return op1(_docs(spark, sf_dir))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordmill.llm.mixing import op2

    return op2(_docs(spark, sf_dir))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from recordmill.llm.encoding import op3

    return op3(_docs(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op5_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordmill.llm.lattice import op5

    return op5(read_table(spark, sf_dir, "embeddings"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordmill.llm.html import op6

    return op6(read_table(spark, sf_dir, "pages"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordmill.llm.secrets import op7

    return op7(_docs(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordmill.llm.simhash import op4

    return op4(_docs(spark, sf_dir))


def op9_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordmill.llm.pseudolm import op9

    return op9(_docs(spark, sf_dir))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordmill.llm.fingerprints import op10

    return op10(_docs(spark, sf_dir))


def minhash_near_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bands and the verification of operator 10, which op10_minhash has no room for: every document with the least of its near copies."""
    from recordmill.llm.fingerprints import near_groups

    return near_groups(_docs(spark, sf_dir))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordmill.llm.licenses import op8

    return op8(_docs(spark, sf_dir))


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordmill.llm.contamination import op11

    return op11(_docs(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from recordmill.llm.alignment import op12

    return op12(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordmill.llm.variants import op13

    return op13(_docs(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_source_mixing, op3_sentencepiece, op4_simhash, op5_lattice_dedup, op6_main_text, op7_secret_scan, op8_license_scan, op9_pseudo_likelihood, op10_minhash, minhash_near_groups, op11_benchmark_decontamination, op12_token_alignment, op13_spelling_variants)}


#: All pairs of vectors and what they reach; exact, so that it holds the lattice search to every link.
OP5_SQL = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.r <> b.r AND CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) >= 0.9 ELSE false END),
reach AS (SELECT r AS a, r AS b FROM ok UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT reach.a AS r, min(ok.vec_id) AS component_id FROM reach JOIN ok ON ok.r = reach.b GROUP BY 1), n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY 1)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, CASE WHEN c.r IS NULL THEN e.vec_id ELSE c.component_id END AS component_id, coalesce(e.vec_id = CASE WHEN c.r IS NULL THEN e.vec_id ELSE c.component_id END, false) AS kept
FROM e LEFT JOIN c USING (r) LEFT JOIN n USING (r)
"""


def oracle_sql() -> dict[str, str]:
    from recordmill.llm.contamination import OP11_SQL
    from recordmill.llm.licenses import OP8_SQL
    from recordmill.llm.mixing import OP2_SQL

    return {"op2_source_mixing": OP2_SQL, "op5_lattice_dedup": OP5_SQL, "op8_license_scan": OP8_SQL, "op11_benchmark_decontamination": OP11_SQL}
