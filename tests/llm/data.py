"""Small tables with the cases that every operator must bear."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, score double, fp string, spans string, row string"


def documents(spark, more=()):
    """Nulls, empty and blank texts, repeats, a long text, and extra columns whose names operators also use."""
    long = " ".join(f"word{i % 997} the of and" for i in range(6000))
    rows = [
        (1, "The cat and the dog walk to the park with you.", "en", "a"),
        (2, "The cat and the dog walk to the park with you.", "en", "a"),
        (3, None, "en", "b"),
        (4, "", "de", None),
        (5, " \t\n ", None, "b"),
        (6, "Der Hund und die Katze gehen in den Park.", "de", "c"),
        (7, "Le chien et le chat vont dans le parc avec vous.", "fr", "c"),
        (7, "Le chien et le chat vont dans le parc avec vous.", "fr", "c"),
        (None, "No id here, only the words of a text.", "en", None),
        (8, long, "en", "a"),
        (9, "12345 67890", None, "a"),
        *more,
    ]
    return spark.createDataFrame([(*r, 0, 1, 0.5, "x", "y", "z") for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
