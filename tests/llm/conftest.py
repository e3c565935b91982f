import pytest

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(40_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank and very long texts, repeated rows, repeated ids, and columns with names the operators use inside."""
    rows = [
        (None, "no id at all, but the same long line\nsecond line of it", "en", "src0"), (1, None, None, None), (2, "", "de", "src1"),
        (3, " \t\n \n", "fr", None), (4, LONG, "en", "src0"), (5, "the same long line\nanother line here", "en", "src0"),
        (5, "the same long line\nanother line here", "en", "src0"), (6, "The Same long line  \nshort\n\n", "en", "src10"),
        (7, "one", None, "src1"), (8, "¿Qué? 123 ⁂ <|endoftext|> é", "es", "src1"), (9, LONG, "en", "src0"), (7, "two other words", "en", "src1")]
    schema = "doc_id long, text string, lang string, source string"
    extra = ["key", "shard", "score", "row", "kept", "_id", "count", "prefix", "component_id", "tokens", "domain", "a.b", "n_chars"]
    df = spark.createDataFrame(rows, schema)
    for i, name in enumerate(extra):
        df = df.selectExpr("*", f"{i} as `{name}`")
    return df


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")
