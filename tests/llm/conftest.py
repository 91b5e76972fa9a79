import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, key int, size string, version int, score string, n_tokens string, copies int, bucket string"
LONG = " ".join(f"wörd{k % 977} x{k}" for k in range(30_000)) + "\n" + "a" * 50_000
TEXTS = [
    "The quick brown fox jumps over the lazy dog.\nA line that several documents share.\nEnd of one",
    "The quick brown fox jumps over the lazy dog.\nA line that several documents share.\nEnd of one",
    "Another text entirely, with\n  a LINE that several documents SHARE.  \nsome words of its own here",
    "", None, " \n\t\n ", "x", "日本語のテキスト\nもう一行あります、長い行です\n🙂🙃", LONG, "one two three", "ONE TWO\x0bthree", "tab\tand\r\nreturn",
]


def rows(texts=TEXTS):
    out = [(k * 3 + 1, t, None if k % 4 == 0 else "en", None if k % 5 == 0 else f"src{k % 3}", None, 7, "f", 1, "s", 2, "z", "q", 9, "b") for k, t in enumerate(texts)]
    return out + [out[2], (None, "a text without an id, A line that several documents share.", None, None, None, *[None] * 9)]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, extra columns whose names the operators use themselves."""
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def data():
    return [(r[0], r[1]) for r in rows()]
