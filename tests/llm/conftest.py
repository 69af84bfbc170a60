import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts):
    return [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture
def documents(spark):
    return lambda texts: spark.createDataFrame(rows_of(texts), SCHEMA)


@pytest.fixture
def folder(spark, tmp_path, documents):
    """A table folder with the given documents, labels and benchmark."""

    def write(texts, labels=(), benchmark=(), pages=()):
        documents(texts).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        spark.createDataFrame(list(pages), "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
        return str(tmp_path)

    return write
