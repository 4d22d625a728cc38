"""Small inputs with everything that may go wrong, and brute-force versions."""

import re

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SAME = "One text that comes again, word for word, and then once more with nothing changed at all."
TEXTS = [
    (1, None),
    (2, ""),
    (3, " \n\t  "),
    (4, "word"),
    (5, "long text " * 30_000),
    (5, "long text " * 30_000),
    (6, SAME),
    (7, SAME.upper()),
    (8, SAME.replace("once", "twice")),
    (None, "a text without an id, mail a.b@c-d.example"),
    (9, "Ärger mit é: x@y.zz, +49 (30) 123-4567890, 4111 1111 1111 1111, 10.0.0.256 and 10.0.0.255."),
]
#: Names that operators use themselves.
CLASHES = ["score", "predicted", "size", "target", "taken", "row", "key", "spans", "_id", "_hash", "n_shingles", "component_id", "task", "rank", "length"]


def odd_documents(spark, rows=TEXTS):
    data = [(i, t, "en", None if n % 3 else "s", len(t or ""), *["x"] * len(CLASHES)) for n, (i, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(data, schema)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def documents(spark, sf="0.001"):
    return spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
