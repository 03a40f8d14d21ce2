import public_tokenizers
import pytest

from shopledger.llm.bpe import Vocabulary

LONG = "word " * 30_000 + "x" * 5_000 + " 1 23" * 2_000
TEXTS = [None, "", "   \n", "one", "One two three.", "One two three.", "1234 !!", "ÀÉ naïve 'tis 3rd $$", "á   中文 😀", "\t\x0b\x0c\r\n", LONG]


@pytest.fixture(scope="session")
def vocabulary(spark):
    return Vocabulary(spark, public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="session")
def docs(spark):
    """Frame (doc_id, text, lang, source, n_chars) from (doc_id, text[, lang]) rows."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)

    return build


@pytest.fixture(scope="session")
def odd(docs):
    """Null, empty and very long texts, a null id and a repeated row."""
    return docs([*enumerate(TEXTS), (None, "no id"), (4, TEXTS[4])])


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
