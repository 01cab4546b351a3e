"""Documents for all operators: nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""

import random

SYLLABLES = "ta re mi so lu ven dor kal esh ing our ble".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _t string, kept string, label string, _id int"


def prose(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]
    for i in range(0, n, 11):
        words[i] = words[i].capitalize() + "."
    return " ".join(words)


def odd_rows():
    """(doc_id, text) of the difficult cases."""
    long = prose(1, 30_000)
    line = prose(2, 60)
    near = line.split()
    near[7] = "changed"
    return [
        (1, prose(3, 80)), (2, None), (3, ""), (4, "   \n\t "), (5, line), (6, line), (7, " ".join(near)), (8, long), (9, "x"), (9, "x"),
        (None, prose(4, 70)), (None, prose(5, 70)), (10, line + "\n" + line), (11, "é ü \U0001f600 ñ " * 30), (12, "A\0b \x1c c\x85d <|endoftext|> 日本"), (12, "same id, other text"),
        *((20 + i, prose(10 + i, 120)) for i in range(12)),
    ]


def documents(spark, rows=None):
    rows = odd_rows() if rows is None else rows
    full = [(i, t, ("en", "fr", None)[k % 3], "src", len(t or ""), "clash", "clash", "clash", k) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def saved(spark, folder, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
