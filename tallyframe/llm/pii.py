"""Information-theoretic sanitisation of personal data, as DataFrame expressions only.

Protected entities are the e-mail addresses, IP addresses, card and phone numbers in the texts. How strongly a term gives
an entity away is estimated from the corpus: with N distinct texts, n(c) of them with entity c, n(t) with term t and n(c,t)
with both, the term's share of the entity's information is

    disclosure(c, t) = PMI(c; t) / IC(c) = log2(N n(c,t) / (n(c) n(t))) / log2(N / n(c)),

1 when the term always means the entity. Everywhere in a text that holds the entity, terms at or above `GENERALISE` are
replaced by their class, terms at or above `REMOVE` are taken out; entities are replaced by their kind. Equal texts (copies)
count once in all four numbers; near copies are texts of their own. A term needs `SUPPORT` of the texts with the entity, so
entities of fewer texts have no telling terms.

Positions come from the matches and the pieces between them: their lengths add up to offsets in code points. Patterns use
possessive repeats and a check of the character before, which give the same leftmost matches in linear time.

Defined results: a null text has no spans and stays null (counts 0); empty texts have none; overlapping spans are replaced
as one; equal rows get equal results; documents without an entity are never changed; input columns named like an output
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, named, running, stored

KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that every match has.
MARKS = {"email": "@", "ip": ".", "phone": "+"}
IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TERM = r"[\p{L}\p{N}]+"
SUPPORT = 3
GENERALISE = 0.75
REMOVE = 0.95

SPAN = "struct<start:int,kind_no:int,end:int,kind:string,value:string>"


def found(text: Column, pattern: str) -> Column:
    """All matches as structs (start, end, value), offsets in code points."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(m: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        sizes = F.transform(m, lambda x: F.length(x))
        steps = lambda g, n: F.zip_with(F.slice(g, F.lit(1), F.size(n)), n, lambda a, b: a + b)
        whole = lambda g, n: let(running(steps(g, n)), lambda r: F.transform(m, lambda x, i: F.struct((F.get(r, i) + F.get(g, i)).alias("start"), (F.get(r, i) + F.get(g, i) + F.get(n, i)).alias("end"), x.alias("value"))))
        return let(gaps, lambda g: let(sizes, lambda n: whole(g, n)))

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return let(matches, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(none))


def luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{IP_PART}\.{IP_PART}\.{IP_PART}\.{IP_PART}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    return F.length(digits).between(10, 15) if kind == "phone" else F.lit(True)


def _spans_of(text: Column, no: int, kind: str) -> Column:
    valid = F.filter(found(text, PATTERNS[kind]), lambda s: _holds(kind, s["value"]))
    full = F.transform(valid, lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("kind_no"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))
    asked = F.contains(text, F.lit(MARKS[kind])) if kind in MARKS else text.rlike(r"[0-9][\x20-]?[0-9]")
    return F.when(asked, full).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    """The spans of all kinds, by start, then kind."""
    return F.array_sort(F.concat(*[_spans_of(text, no, kind) for no, kind in enumerate(KINDS)]))


def _entity(span: Column) -> Column:
    """What counts as the same entity: letters without case, digits without separators."""
    plain = F.when(span["kind"].isin("card", "phone"), F.regexp_replace(span["value"], "[^0-9]", "")).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"], F.lit(":"), plain)


def _entities(spans: Column) -> Column:
    return F.array_distinct(F.transform(spans, _entity))


def _units(marked: DataFrame) -> DataFrame:
    """(_hash, entities, n_c, terms) of each distinct text: the entities of at least `SUPPORT` texts, each with its n(c), and all terms that are not part of an entity."""
    held = marked.where(F.size("spans") > 0).select("_hash", "text", "spans").dropDuplicates(["_hash"])
    named = marked.where(F.size("spans") > 0).select("_hash", F.explode(_entities(F.col("spans"))).alias("entity")).distinct()
    often = named.groupBy("entity").agg(F.count("*").alias("n_c")).where(F.col("n_c") >= SUPPORT)
    shared = named.join(often, "entity").groupBy("_hash").agg(F.collect_list(F.struct("entity", "n_c")).alias("entities"))
    free = F.filter(found(F.col("text"), TERM), lambda t: ~F.exists("spans", lambda s: (t["start"] < s["end"]) & (t["end"] > s["start"])))
    return held.join(shared, "_hash").select("_hash", "entities", free.alias("terms"))


def _pairs(units: DataFrame) -> DataFrame:
    """(_hash, entity, n_c, term): each term of a text with each entity of it, once."""
    one = units.select("_hash", "entities", F.explode(F.array_distinct(F.transform("terms", lambda t: F.lower(t["value"])))).alias("term"))
    return one.select("_hash", "term", F.explode("entities").alias("e")).select("_hash", "e.entity", "e.n_c", "term")


def disclosures(units: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(entity, term, disclosure) of the terms that reach the lower threshold, counted over all distinct texts."""
    pairs = _pairs(units).groupBy("entity", "n_c", "term").agg(F.count("*").alias("n_ct")).where(F.col("n_ct") >= SUPPORT)
    terms = F.transform(F.regexp_extract_all(F.col("text"), F.lit(TERM), F.lit(0)), F.lower)
    words = docs.select(F.col(text).alias("text")).distinct().select(F.explode(F.array_distinct(terms)).alias("term"))
    often = words.groupBy("term").agg(F.count("*").alias("n_t"))
    size = docs.where(F.col(text).isNotNull()).agg(F.count_distinct(F.xxhash64(text)).alias("n")).select("n").scalar()
    known = pairs.join(often, "term").withColumn("n", size)
    shared = F.least("n_ct", "n_t", "n_c")
    pmi = F.log2(shared * F.col("n") / (F.col("n_c") * F.col("n_t")))
    ic = F.log2(F.col("n") / F.col("n_c"))
    return known.withColumn("disclosure", F.when(ic > 0, pmi / ic)).where(F.col("disclosure") >= GENERALISE).select("entity", "term", "disclosure")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: _id, _hash (of the text), spans (base) and term_spans (start, end, disclosure, value)."""
    source = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("text"))
    none = F.array().cast(f"array<{SPAN}>")
    marked = source.withColumn("spans", F.coalesce(base_spans(F.col("text")), none))
    # texts are kept only where there is an entity: the rest of the work is on them
    slim = stored(marked.withColumn("text", F.when(F.size("spans") > 0, F.col("text"))), "marked", codec="zstd")
    units = stored(_units(slim), "units", codec="zstd")
    strong = stored(disclosures(units, docs, text), "strong")
    # only texts with an entity that has telling terms are taken apart again
    telling = units.select("_hash", "terms", F.explode("entities.entity").alias("entity")).join(strong.select("entity").distinct(), "entity", "left_semi")
    told = telling.select("_hash", "entity", F.explode(F.array_distinct(F.transform("terms", lambda t: F.lower(t["value"])))).alias("term")).join(strong, ["entity", "term"])
    most = told.groupBy("_hash", "term").agg(F.max("disclosure").alias("disclosure"))
    by_text = most.groupBy("_hash").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("most"))
    placed = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.try_element_at(F.col("most"), F.lower(t["value"])).alias("disclosure"), t["value"].alias("value")))
    per_text = units.join(by_text, "_hash").select("_hash", F.filter(placed, lambda t: t["disclosure"].isNotNull()).alias("term_spans"))
    return slim.drop("text").join(per_text, "_hash", "left").select("_id", "_hash", "spans", F.coalesce("term_spans", F.array()).alias("term_spans"))


def all_spans(row_spans: Column, term_spans: Column) -> Column:
    """Base and term spans in one order: start, then kind."""
    terms = F.transform(term_spans, lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS)).alias("kind_no"), t["end"].alias("end"), F.lit("term").alias("kind"), t["value"].alias("value")))
    return F.array_sort(F.concat(row_spans, terms))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _general(value: Column) -> Column:
    """The class that a term is generalised to."""
    return F.when(value.rlike("^[0-9]+$"), "<NUMBER>").when(value.rlike(r"^\p{Lu}"), "<NAME>").otherwise("<TERM>")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with entities replaced by their kind and telling terms generalised or removed."""
    hashed = docs.withColumns({"__pii_id": F.col(id_col), "__pii_hash": F.xxhash64(text)})
    data = personal_data(docs, id_col, text).where(F.size("spans") > 0).dropDuplicates(["_id", "_hash"])
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("by")))
    terms = F.transform("term_spans", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["disclosure"] >= REMOVE, "").otherwise(_general(t["value"])).alias("by")))
    data = data.select(F.col("_id").alias("__pii_of"), F.col("_hash").alias("__pii_text"), F.array_sort(F.concat(base, terms)).alias("__pii_cuts"))
    both = hashed.join(data, F.col("__pii_id").eqNullSafe(F.col("__pii_of")) & (F.col("__pii_hash") == F.col("__pii_text")), "left")
    cut_type = "array<struct<start:int,end:int,by:string>>"

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["by"].alias("by"))
        return F.when((F.size(acc) > 0) & (s["start"] < last["end"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(wider))).otherwise(F.concat(acc, F.array(s)))

    cuts = F.aggregate("__pii_cuts", F.array().cast(cut_type), merge)
    before = lambda c, i: F.when(i > 0, F.get(c, i - 1)["end"]).otherwise(F.lit(0))
    piece = lambda c, s, i: F.concat(F.substring(F.col(text), before(c, i) + 1, s["start"] - before(c, i)), s["by"])
    rest = lambda c: F.substring(F.col(text), F.element_at(c, -1)["end"] + 1, F.length(text))
    clean = let(cuts, lambda c: F.concat(F.array_join(F.transform(c, lambda s, i: piece(c, s, i)), ""), rest(c)))
    new_text = F.when(F.col("__pii_cuts").isNull(), F.col(text)).otherwise(clean)
    return both.select(*[new_text.alias(text) if c == text else named(c) for c in docs.columns])
