import pytest

#: Columns that the operators use themselves, beside those of documents.
CLASHES = ["id", "row", "n", "t", "v", "c", "size", "target", "score", "kept", "keep_id", "rep", "position", "component_id", "held_out", "label", "digest", "path", "__row", "__digest", "__id", "__copy", "__place", "__pass", "__again", "__maybe"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


@pytest.fixture(scope="session")
def make(spark):
    def docs(rows):
        """Documents from (doc_id, text) or (doc_id, text, source), with clashing extra columns."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, *["x"] * len(CLASHES)) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return docs


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and blank texts, repeated rows, equal texts, a very long text."""
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    return [(1, None), (2, ""), (3, " \t\n"), (4, "a  b\tc"), (5, "a b c"), (5, "a b c"), (6, "Ünï cödé ² 漢字 <|endoftext|>"), (7, long), (None, "a b c"), (8, "one"), (9, "x y z " * 50, None)]
