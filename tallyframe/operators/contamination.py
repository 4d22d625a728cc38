"""Overlap of questions with a corpus by shared word n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, normalize
from ..skew import loosely


def decontamination_query(df: DataFrame, spec: str | Column | None, prompt: str = "prompt", name: str = "query") -> DataFrame:
    """The text to check: a named column, an expression, or the prompt."""
    if spec is None:
        c = F.col(prompt)
    elif isinstance(spec, str):
        c = F.col(spec) if spec in df.columns else F.expr(spec)
    else:
        c = spec
    return df.withColumn(name, c)


def _joined(a: Column, b: Column, width: int) -> Column:
    """Hashes of the pieces that begin at each place: a's piece there and b's piece right after it, `width` places on."""
    n = F.size(b) - width
    return F.when(n > 0, F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(width + 1), n), lambda x, y: F.xxhash64(x, y))).otherwise(F.array().cast("array<bigint>"))


def ngram_hashes(words: Column, n: int) -> Column:
    """A 64-bit hash of the n elements from each place on, built from hashes of 1, 2, 4, ... elements; no n-gram is ever
    spelled out."""

    def longer(single: Column, double: Column, done: Column | None, width: int, size: int, left: int) -> Column:
        # done: hashes of the first `size` elements, double: of `width` elements; `left` of n are still to be added
        if left & 1:
            done, size = (double, width) if done is None else (_joined(done, double, size), size + width)
        left >>= 1
        if not left:
            return done
        if done is None:
            return let(_joined(double, double, width), lambda d: longer(single, d, None, 2 * width, 0, left))
        return let(F.struct(done.alias("done"), _joined(double, double, width).alias("next")), lambda s: longer(single, s["next"], s["done"], 2 * width, size, left))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: longer(h, h, None, 1, 0, n))


def _shingles(df: DataFrame, ids: list[str], text: str, n: int) -> DataFrame:
    """Two 64-bit hashes per word n-gram; texts shorter than n words give one n-gram of all their words."""
    words = F.filter(F.split(normalize(F.col(text)), " "), lambda w: w != "")
    salted = lambda ws: F.transform(ws, lambda w: F.concat(F.lit("b"), w))

    def hashes(ws: Column) -> Column:
        grams = F.arrays_zip(ngram_hashes(ws, n).alias("a"), ngram_hashes(salted(ws), n).alias("b"))
        whole = F.array(F.struct(F.xxhash64(ws).alias("a"), F.xxhash64(salted(ws)).alias("b")))
        none = F.array().cast("array<struct<a:bigint,b:bigint>>")
        return F.when(F.size(ws) >= n, grams).when(F.size(ws) > 0, whole).otherwise(none)

    rows = df.select(*ids, let(words, hashes).alias("_g"))
    return rows.select(*ids, F.explode("_g").alias("_h")).select(*ids, F.col("_h.a").alias("a"), F.col("_h.b").alias("b"))


def split_contamination(
    questions: DataFrame, corpus: DataFrame, ids: list[str], query: str = "query", text: str = "text", n: int = 13
) -> DataFrame:
    """questions plus `subset`: only_contamination when any word n-gram also stands in the corpus.

    The corpus n-grams are first matched against the questions' own; a question set small enough to broadcast, by
    Spark's own size check, thus filters them where they are read. Only n-grams found on both sides are shuffled on.
    N-grams that most questions or documents share (boilerplate) are single rows on the other side of both joins.
    """
    asked = _shingles(questions, ids, query, n)
    gram, any_row = ["a", "b"], F.count(F.lit(1)).alias("_n")
    wanted = loosely(asked, gram, any_row).drop("_n")
    known = loosely(_shingles(corpus, [], text, n).join(wanted, gram, "left_semi"), gram, any_row).drop("_n")
    hit = asked.join(known, gram, "left_semi").select(*ids).distinct()
    flagged = questions.join(hit.withColumn("_hit", F.lit(True)), ids, "left")
    subset = F.when(F.col("_hit"), "only_contamination").otherwise("no_contamination")
    return flagged.withColumn("subset", subset).drop("_hit")
