import pytest

CLASH = [("h", "x"), ("n", 1), ("one", 2), ("spans", "y"), ("rank", 3), ("cell", 4)]


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) pairs; ``extra`` adds columns with clashing names."""
    def make(rows, extra=False):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        data = [(i, t, None if i is None else ("en", "de")[i % 2], None if i is None else f"s{i % 3}",
                 None if t is None else len(t)) for i, t in rows]
        if extra:
            data = [(*r, *(v for _, v in CLASH)) for r in data]
            schema += "".join(f", `{k}` {'string' if isinstance(v, str) else 'int'}" for k, v in CLASH)
        return spark.createDataFrame(data, schema)
    return make
