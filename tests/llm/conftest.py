from __future__ import annotations

import random

import pytest

SF = "/root/testdata/sf0.001"
# extra columns named like the operators' own
CLASH = "key node label fold score shard slot word n hits statistics base_spans all_spans kept count text_key size".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("the and ing er on re ti a".split()) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): nulls in each column, empty and long texts, repeated rows, shared ids."""
    rng = random.Random(4)
    one, two = prose(rng, 60), prose(rng, 60)
    rows = [
        (1, one, "en", "a", len(one)),
        (1, one, "en", "a", len(one)),
        (2, one + " end", None, "a", None),
        (3, two, "en", None, len(two)),
        (None, two, "en", "b", len(two)),
        (None, None, None, None, None),
        (4, None, "en", "b", 0),
        (5, "", "en", "b", 0),
        (6, " \n\t ", "en", "b", 4),
        (7, prose(rng, 20_000), "en", "b", None),
        (8, "x" * 50_000, "en", "b", 50_000),
        (3, 'other text with token = "0123456789abcdef0123456789abcdef"', "en", "b", 58),
        (9, "Ünïcödé 日本語 \U0001d4b3 \x00   <|endoftext|> </s> ▁▁", "xx", "c", None),
    ]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The rows with extra columns whose names clash with the operators' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame([(*r, *CLASH) for r in odd_rows], schema)


@pytest.fixture(scope="session")
def odd_folder(spark, odd_docs, tmp_path_factory):
    """The rows as tables, with labels and a benchmark that hold nulls too."""
    folder = str(tmp_path_factory.mktemp("odd"))
    odd_docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(1, 1, 0), (2, 0, 0), (2, 1, 1), (None, 1, 0), (3, None, 0), (99, 1, 1), (7, 1, None), (8, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, None), (None, "text without id that is long enough"), (2, ""), (3, "no document holds this sentence, not even with an edit")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder
