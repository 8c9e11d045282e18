"""Rows that every operator must stand: nulls, empty and long texts, ties, repeated rows and clashing column names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, score string, node string, key string, spans string"

LONG = " ".join(f"word{i % 977} né" for i in range(40_000))


def hard_rows(spark, texts=()):
    rows = [
        (100001, None), (200001, ""), (300001, "   \n\t "), (400001, "one"), (500001, LONG), (600001, "same text twice over here again"), (700001, "same text twice over here again"),
        (800001, "a repeated row of eight words or more"), (800001, "a repeated row of eight words or more"), (None, "a row without an id and some words"), (None, None),
        (900001, "Grüße, ça va? 漢字 \U0001F600 tail"), *texts,
    ]
    full = [(i, t, None if i == 400001 else "en", None, None, "x", "y", "z", "k", "s") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def empty_rows(spark):
    return spark.createDataFrame([], SCHEMA)
