import pytest
from pyspark.sql import types as T

DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

PROSE = (
    "The morning train was late again, so we walked along the river. Nobody minded the rain. "
    "A heron stood in the shallows and watched us pass by without moving at all. "
    "Later the sun came out. We bought bread and cheese at the small market near the old bridge. "
)


@pytest.fixture
def documents(spark):
    """``documents((1, "text"), ...)``; further columns by name go to every row."""

    def made(*rows, **more):
        rows = [(i, t, "en", "s", len(t or "")) for i, t in rows]
        schema = DOCUMENT
        for name, value in more.items():
            schema = T.StructType([*schema, T.StructField(name, T.StringType())])
            rows = [(*r, value) for r in rows]
        return spark.createDataFrame(rows, schema)

    return made
