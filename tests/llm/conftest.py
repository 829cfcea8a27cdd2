import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def space_of(spark):
    from panelloom.llm.common import Workspace

    return lambda label: Workspace(spark, label)


#: Names that the operators use inside, or might.
CLASHES = ("__body", "__id", "__gone", "__leaked", "__row", "__text", "id", "of_text", "gone", "leaked", "row", "n_dropped", "node", "border")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, key string, h long, score string, held_out string, line string, body string, root string, shard string, n_lines string, _id long, _text string, " + ", ".join(f"{c} string" for c in CLASHES)


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, columns with clashing names."""
    long_text = "\n".join(" ".join(f"w{i * 37 % 9973}x{j}" for j in range(40)) for i in range(1500))
    texts = [None, "", " \n\t\n ", "one", "one two", "Only two words and then some more of them here.\n\nOnly two words and then some more of them here.", long_text, "日本語 の テキスト\x00\x1c!", "ß É ﬁ İ Σ́"]
    rows = [(i, t, "en" if i % 2 else None, None, None) for i, t in enumerate(texts)]
    rows += [(None, None, None, None, None), (None, "a text without an id", "en", "s", 5), (3, "one", None, None, None), (3, "one", None, None, None), (3, "another text under one id", "fr", None, None), (20, "one two", "en", None, None)]
    return spark.createDataFrame([(*r, "a", "b", 7, "c", "d", "e", "f", "g", "h", "i", 9, "j", *CLASHES) for r in rows], SCHEMA).repartition(3).where(F.lit(True))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
