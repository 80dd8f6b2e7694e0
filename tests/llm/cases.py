"""Documents with nulls, empty and long texts, repeats, and columns whose names clash with outputs."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, kept string, size string, v string, k0 string, node string"

LONG = "long words go on and on " * 20000


def odd_documents(spark):
    texts = [(1, "Good day to you all, the sun is out and we walk along the river to the old mill."), (2, None), (3, ""), (4, LONG), (4, LONG), (5, " \t\n "), (6, "x" * 100000), (None, "a text without an id"), (7, "a b c d e " * 8), (8, "é ü ñ 中文 \U0001f600 \x00 end\r\nnext\x85line")]
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, None if k % 3 == 0 else "s", 0, "s", "k", "z", "v", "k0", "n") for k, (i, t) in enumerate(texts)], SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
