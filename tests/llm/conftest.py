from __future__ import annotations

import pytest

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, row int"


def odd_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows; clashing extra columns."""
    base = [f"word{i} here and there{i % 7}" for i in range(60)]
    passage = " ".join(f"pass{i}" for i in range(40))
    long = " ".join(f"long{i} Text" for i in range(9000))
    texts = [
        None, "", " \t\n ", "one", "a b c d", "\n\n", " ".join(base), " ".join(base).upper(),
        " ".join(base[:57] + ["changed words"]), passage, f"before it {passage} after it",
        f"elsewhere\n{passage}\nand on", "same line\nown line é 1\nSAME LINE ", long, long + " end",
        "x " * 400, "it's  <|endoftext|>  12345  and more  spaces\x1c \n\n done ",
        "token = \"0123456789abcdef0123456789abcdef01234567\" 10.20.30.40 a.b@mail.example.com1",
    ]
    rows = [
        (i, t, "en" if i % 2 else None, "s" if i % 3 else None, None, "x", 1)
        for i, t in enumerate(texts)
    ]
    copies = [(100 + i, f"\t Same Line\nnumber {i}", "en", "s", 5, None, None) for i in range(9)]
    more = [rows[6], rows[6], rows[9], (None, " ".join(base), "en", "t", 1, "y", 2),
            (None, None, None, None, None, None, None), (-5, "a b c d", "en", "s", 7, "z", 3)]
    return rows + copies + more


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def unordered(rows):
    return sorted(map(tuple, rows), key=repr)
