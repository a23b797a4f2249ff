"""What the tests of the corpus operators share: awkward documents."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, position string"

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(20000))


def documents(spark, rows=None):
    """Nulls in every column, empty and very long texts, repeated rows, and extra columns with names that operators use."""
    rows = rows or [
        (1, "The quick brown fox jumps over the lazy dog and runs away from it all", "en", "a"),
        (2, "The quick brown fox jumps over the lazy dog and runs away from it all", "en", "a"),
        (3, "", "en", "b"),
        (4, None, None, None),
        (5, LONG, "de", "a"),
        (6, "... 123 !!!", None, "b"),
        (7, "single", "fr", "c"),
        (7, "single", "fr", "c"),
        (None, "A row that has no number at all but some text in it nevertheless", "en", None),
        (9, LONG + " tail", "de", "a"),
        (10, "  \t\n ", "es", "b"),
        (11, "Ünï©ödé 漢字 🙂 text with l’accent and 'quotes' they'll don't", "fr", "c"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), 0.5, 3, "x") for r in rows], SCHEMA)
