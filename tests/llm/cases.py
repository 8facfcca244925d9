"""Tables with the cases every operator must stand: nulls, empty and long texts, repeats, clashing columns, no rows."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    """Documents of (doc_id, text), with columns of the names operators give their results."""
    df = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
    for name in ("spans", "kept", "n_tokens", "ids", "row", "component_id", "score", "hash"):
        df = df.withColumn(name, F.lit("x"))
    return df.repartition(3)


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (None, "null id here"), (4, "a"), (4, "a"), (5, "é日本😀 " * 700),
    (6, "x" * 30_000), (7, "one two three four five"), (8, "One two  three\nfour FIVE"),
]


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def documents(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
