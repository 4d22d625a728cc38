import re

from odd_inputs import CLASHES, documents, odd_documents
from pyspark.sql import functions as F

from tallyframe.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def base(text):
    out = [(m.start(), n, m.end(), k) for n, k in enumerate(PATTERNS) for m in re.finditer(PATTERNS[k], text or "") if holds(k, m.group())]
    return sorted(out)


EDGES = [
    "x a@b.c_x@d.e y", "1.2.3.4.5.6.7.8", "a@b@c.d", "+1.2.3.4.5678901 z", "4111 1111 1111 1111 4111-1111-1111-1111",
    "é a.b@c-d.e.f. ü +49 (30) 123-4567890.", "x@y", "256.1.1.1 001.002.003.004", "4111111111111111", "a@b.c " * 600,
    "1" * 20_000, "a" * 20_000 + "@", "+1" * 2_000, "", None,
]


def spans_of(df):
    return [([(s.start, s.kind_no, s.end, s.kind) for s in r.spans], r._id) for r in pii.personal_data(df).collect()]


def test_spans_like_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(EDGES)), "doc_id long, text string")
    for spans, i in spans_of(df):
        assert spans == base(EDGES[i]), EDGES[i]
    docs = documents(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = spans_of(docs)
    assert len(got) == len(texts) and all(spans == base(texts[i]) for spans, i in got)


def test_terms_that_tell_and_clean_documents(spark):
    secret = [(i, f"{w} filler{i} word{i * 7} kestrel writes to spy@agency.example today {w}") for i, w in enumerate(["one", "two", "six", "ten"])]
    plain = [(100 + i, f"an open text number{i} on birds today writes to nobody") for i in range(60)]
    df = spark.createDataFrame(secret + plain, "doc_id long, text string")
    rows = {r._id: r for r in pii.personal_data(df).collect()}
    assert all("kestrel" in [t.value for t in rows[i].term_spans] for i, _ in secret)
    assert all(not t.value.startswith("filler") for i, _ in secret for t in rows[i].term_spans)  # too few contexts
    assert all(not rows[i].spans and not rows[i].term_spans for i, _ in plain)
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all("spy@" not in clean[i] and "kestrel" not in clean[i] for i, _ in secret)
    assert all(clean[i] == t for i, t in plain)


def test_copies_are_one_context(spark):
    df = spark.createDataFrame([(i, "kestrel writes to spy@agency.example today") for i in range(9)] + [(50 + i, f"other {i}") for i in range(40)], "doc_id long, text string")
    assert all(not r.term_spans for r in pii.personal_data(df).collect())


def test_copies_count_once_in_all_numbers(spark):
    told = [(i, f"{w} kestrel {w}{i} writes to spy@agency.example {w}") for i, w in enumerate(["one", "two", "six"])]
    copies = [(10 + i, told[0][1]) for i in range(50)]
    others = [(100 + i, f"number{i} writes on birds") for i in range(500)]
    df = spark.createDataFrame(told + copies + others, "doc_id long, text string")
    rows = pii.personal_data(df).where("size(spans) > 0").collect()
    assert len(rows) == 53 and all([(t.value, t.disclosure) for t in r.term_spans if t.value == "kestrel"] == [("kestrel", 1.0)] for r in rows)


def test_terms_anywhere_in_the_text(spark):
    far = " ".join(f"plain{i}" for i in range(60))
    told = [(i, f"Kestrel {i} {far} spy@agency.example {far} kestrel Falcon {w}") for i, w in enumerate(["one", "two", "six"])]
    others = [(100 + i, f"number{i} {far}") for i in range(60)]
    df = spark.createDataFrame(told + others, "doc_id long, text string")
    rows = pii.personal_data(df).where("size(spans) > 0").collect()
    assert [[t.value for t in r.term_spans if not t.value.isdigit()] for r in rows] == [["Kestrel", "kestrel", "Falcon"]] * 3
    texts = {r._id: r for r in rows}
    assert all(dict(told)[i][t.start : t.end] == t.value for i, r in texts.items() for t in r.term_spans)
    clean = [r.text for r in pii.sanitise(df).where("doc_id < 100").collect()]
    assert all("estrel" not in t and "Falcon" not in t and far in t for t in clean)


def test_odd_rows_and_empty_table(spark):
    docs = odd_documents(spark)
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    by = {(r.doc_id, r.text) for r in out.collect()}
    assert (1, None) in by and (2, "") in by and (None, "a text without an id, mail <EMAIL>") in by
    assert any(i == 9 and "<CARD>" in t and "<PHONE>" in t and "10.0.0.256" in t and "<IP>" in t for i, t in by if t)
    assert out.where(F.col("score") == "x").count() == docs.count() and len(CLASHES) > 0
    assert pii.sanitise(docs.limit(0)).count() == 0 and pii.personal_data(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = pii.personal_data(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
