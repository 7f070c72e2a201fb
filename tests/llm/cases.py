"""One table with the awkward rows that every operator must survive."""

LONG = "long " * 60_000


def awkward(spark, ids=True):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns named like internal ones."""
    text = "the same words in every copy of this line\nand one more line to follow it\nand a third one"
    rows = [
        (1, text, "en", "a", 5), (2, text, "en", "a", 5), (2, text, "en", "a", 5), (3, None, "en", "b", None), (4, "", None, None, 0), (5, " \n\t ", "fr", "a", 4),
        (6, LONG, "en", "b", len(LONG)), (7, "x", "en", None, 1), (None if ids else 8, text, "de", "b", 5), (9, "ünïcödé 😀 𝔘 words", "de", "c", 9), (10, None, None, None, None),
    ]
    extra = "k long, th string, m string, n long, rank string, size string, copies long, key string, fp string, words string, path string"
    clash = (7, "c", "c", 1, "c", "c", 9, "c", "c", "c", "c")
    return spark.createDataFrame([(*r, *clash) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(3)
