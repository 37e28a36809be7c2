import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, id string, score string, spans int, key int, shard string, _gone int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names clash with inner ones; ids from 0 unless given."""

    def make(texts, ids=None, langs=None):
        ids = range(len(texts)) if ids is None else ids
        langs = langs or [None] * len(texts)
        return spark.createDataFrame([(i, t, lang, None, None if t is None else len(t), 1, "x", "y", 2, 3, "z", 4) for i, t, lang in zip(ids, texts, langs, strict=True)], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and blank texts, ties, repeats, a very long text, one without spaces and other scripts."""
    draw = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta", "it's", "1999", "x" * 40]
    long = " ".join(draw.choice(words) for _ in range(30_000))
    texts = [None, "", "   \n\t ", "one", "one", "Two words", "a" * 5000, "中文字符没有空格" * 30, "emoji 😀 done", "tab\tand nbsp", long, long]
    texts += [" ".join(draw.choice(words) for _ in range(draw.randrange(1, 60))) for _ in range(60)]
    return texts


@pytest.fixture(scope="session")
def tables(tmp_path_factory, spark):
    """A folder of test tables as the queries read them."""

    def write(**frames):
        path = tmp_path_factory.mktemp("tables")
        for name, frame in frames.items():
            frame.write.parquet(f"{path}/{name}.parquet")
        return str(path)

    return write
