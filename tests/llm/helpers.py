"""Small tables with the awkward rows every operator must take."""

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


def documents(spark, rows, source="s"):
    """From (doc_id, text) or (doc_id, text, source)."""
    full = [
        (r[0], r[1], "en", r[2] if len(r) > 2 else source, len(r[1]) if r[1] is not None else None)
        for r in rows
    ]
    return spark.createDataFrame(full, DOCUMENT)


def written(spark, frame, tmp_path, name="documents"):
    """A table folder as the queries expect it."""
    frame.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def rows(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()), key=repr)


AWKWARD = [
    (None, "a text without an id"),
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "same words here and there once more"),
    (4, "same words here and there once more"),
    (5, "same words here and there once more"),
    (6, "é ñ ß 　 wide space \U0001f600"),
    (7, "long " * 30_000),
]
CLASHING = ["row_key", "rules", "print", "group", "key", "bucket", "record", "word", "document", "shard", "pos"]


def with_clashing_columns(frame):
    from pyspark.sql import functions as F

    return frame.withColumns({c: F.lit("x") for c in CLASHING})
