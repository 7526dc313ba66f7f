"""Documents with nulls, empty and long texts, repeated rows and clashing column names."""

LONG = "alpha beta gamma, delta! " * 12_000 + "end of it"
SAME = "the cat sat on the mat again and again until noon"
TEXTS = [
    (1, SAME), (1, SAME), (2, SAME), (3, None), (4, ""), (5, "  \n "), (6, LONG), (None, "no id here at all today"),
    (None, None), (7, "one two"), (8, "a<|endoftext|> b"), (9, "Σίσυφος é 😀 中文  two  spaces\n\nline\x1cx"), (10, "12 34 %% ##"),
]
EXTRA = ["id", "ids", "start", "n", "node", "sig", "range", "place", "copy", "label", "_language", "_quality", "_secrets", "decoded", "size"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in EXTRA)


def documents(spark, rows=None):
    rows = TEXTS if rows is None else rows
    full = [(i, t, "en" if t and i != 9 else None, None, None if t is None else len(t), *["x"] * len(EXTRA)) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)
