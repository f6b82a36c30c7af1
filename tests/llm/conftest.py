import pytest


@pytest.fixture
def docs(spark):
    """Documents (doc_id, text) of a list of texts; ids are places."""

    def make(texts, **more):
        data = [(i, t, *[v[i] for v in more.values()]) for i, t in enumerate(texts)]
        return spark.createDataFrame(data, "doc_id long, text string" + "".join(f", {c} string" for c in more))

    return make
