"""Rows that every operator must stand: nulls anywhere, empty and very long texts, repeats, clashing extra columns."""

LONG = " ".join(f"wort{i % 977} des{i % 13}" for i in range(30_000))
DOCS = [
    (1, "The quick brown fox jumps over the lazy dog by the river bank today.", "en", "a", 68),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \t\n", "fr", "b", 3),
    (5, "le petit chat est sur la table de la maison avec le chien", "fr", "b", 57),
    (5, "le petit chat est sur la table de la maison avec le chien", "fr", "b", 57),
    (6, LONG, "de", "a", len(LONG)),
    (None, "no number but words in a row of some length", "en", None, 43),
    (7, "12345 !!! ???", "en", "c", 13),
    (8, "The quick brown fox jumps over the lazy dog by the river bank today.", "en", "c", 68),
    (9, "mot", "fr", "a", 3),
    (10, "▁x \x00 \U0001f600 é token = \"0123456789abcdef0123456789abcdef01234567\"", "en", "a", 61),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["score", "n_tokens", "copy", "fingerprint", "component_id", "spans", "dice", "unit", "found", "rows", "rep", "part", "edge", "weight", "lm_score"]


def docs(spark, rows=None):
    from pyspark.sql import functions as F

    return spark.createDataFrame(DOCS if rows is None else rows, SCHEMA).withColumns({c: F.lit("clash") for c in CLASH})
