"""Mixing sources to target weights by Efraimidis-Spirakis sampling, as DataFrame expressions only.

Every document gets the key -ln(u)/w: u is a hash of its id in (0, 1), w its quality weight (the share of characters that
are not marks or digits, at least 0.05). Taking documents of a source by rising key up to a word budget is weighted
sampling without replacement. A source's budget is first spent on complete epochs; only the rest is selected by key, and
the document at the edge gives as many words as are left.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating; they share all words by weight, but none gets
more than `LIMIT` times its own words; what exceeds that is shared by the others. With sources sorted by LIMIT * size /
weight the capped ones come first, so running totals give the level of the rest at once.

No source is ever sorted as a whole: key ranges of a source are summed up, twice ever finer, and rows are put in order only
inside the range where the budget ends.

Defined results: null and empty texts have size 0 and nothing is taken of them; rows are told apart by a stored row number,
so repeated rows share a budget like other rows; a null source is a source of its own, a null id hashes like ''; without
any words all targets are 0; input columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, named, stored, words_in

WEIGHTS = (5, 2, 1)
LIMIT = 3
PARTS = 1024
#: A table with a row per source is broadcast up to this many rows, so that texts and hot sources stay where they are.
FEW = 10_000
OUT = ["size", "source_size", "target", "taken"]


def uniform(doc_id: Column) -> Column:
    """A hash of the id in (0, 1), the same in every engine with md5."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":mix")))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def quality_weight(text: Column) -> Column:
    share = F.length(F.regexp_replace(text, r"[!-@\[-`{-~]", "")) / F.nullif(F.length(text), F.lit(0))
    return F.greatest(F.lit(0.05), F.coalesce(share, F.lit(0.05)))


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target) from rows (source, size); one row per source, and windows over those only."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    choices = F.array(*[F.lit(w) for w in WEIGHTS])
    per = per.withColumn("_w", F.element_at(choices, (F.pmod(place - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(1))
    by_ratio = Window.orderBy(F.col("source_size") * LIMIT / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({
        "_all": F.sum("source_size").over(everything),
        "_all_w": F.sum("_w").over(everything),
        "_s": F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "_ws": F.coalesce(F.sum("_w").over(before), F.lit(0)),
    })
    level = (F.col("_all") - LIMIT * F.col("_s")) / (F.col("_all_w") - F.col("_ws"))
    per = per.withColumn("_capped", F.col("source_size") * LIMIT / F.col("_w") <= level)
    per = per.withColumns({
        "_rest": F.col("_all") - F.coalesce(F.sum(F.when(F.col("_capped"), F.col("source_size") * LIMIT)).over(everything), F.lit(0)),
        "_rest_w": F.col("_all_w") - F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_w"))).over(everything), F.lit(0)),
    })
    target = F.when(F.col("_capped"), (F.col("source_size") * LIMIT).cast("double")).otherwise(F.try_divide(F.col("_rest") * F.col("_w"), F.col("_rest_w")))
    return per.select("source", "source_size", target.alias("target"))


def _small(per_source: DataFrame) -> DataFrame:
    """A stored table with a row per source, sent to all tasks if there are few sources; else the runtime picks the join."""
    return F.broadcast(per_source) if len(per_source.head(FEW + 1)) <= FEW else per_source


def _cuts(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: complete epochs, and the key and row number where the rest of the budget ends."""
    budget = F.round("target").cast("long")
    open_ = stored(targets.where("source_size > 0").withColumns({
        "epochs": F.floor(budget / F.col("source_size")),
        "left": budget % F.col("source_size"),
        "lo": F.lit(0.0),
        "width": F.lit(1.0),
    }), "cuts")
    same = F.col("r.source").eqNullSafe(F.col("c.source"))
    place = 1 - F.exp(-F.col("key"))
    for _ in range(2):
        at = F.least(F.floor((place - F.col("lo")) / F.col("width") * PARTS), F.lit(PARTS - 1))
        inside = rows.alias("r").join(_small(open_).alias("c"), same).where((place >= F.col("lo")) & ((place < F.col("lo") + F.col("width")) | (F.col("lo") + F.col("width") >= 1)))
        sums = inside.groupBy("c.source", at.alias("part")).agg(F.sum("size").alias("words"))
        running = F.sum("words").over(Window.partitionBy("source").orderBy("part")) - F.col("words")
        # the range where the budget ends: the last one that begins within it
        ranges = sums.withColumn("before", running).alias("r").join(open_.alias("c"), same).where(F.col("before") <= F.col("left"))
        last = ranges.groupBy("c.source").agg(F.max_by(F.struct("part", "before"), "part").alias("at"))
        open_ = stored(
            open_.alias("c").join(last.alias("r"), same).select(
                "c.source", "source_size", "target", "epochs",
                (F.col("left") - F.col("at.before")).alias("left"),
                (F.col("lo") + F.col("at.part") * (F.col("width") / PARTS)).alias("lo"),
                (F.col("width") / PARTS).alias("width"),
            ),
            "cuts",
        )
    # rounding may put a neighbour of the range on either side of it: places are compared by the same expression throughout
    near = rows.alias("r").join(_small(open_).alias("c"), same).where((place >= F.col("lo")) & ((place < F.col("lo") + F.col("width")) | (F.col("lo") + F.col("width") >= 1)))
    order = Window.partitionBy("source").orderBy("key", "row")
    ranked = near.select("c.source", "key", "row", "size", "left").withColumn("before", F.sum("size").over(order) - F.col("size"))
    edge = ranked.where("before <= left").groupBy("source").agg(F.max_by(F.struct("key", "row", (F.col("left") - F.col("before")).alias("words")), F.struct("key", "row")).alias("edge"))
    return open_.alias("c").join(edge.alias("r"), same, "left").select("c.source", "epochs", "edge.key", "edge.row", "edge.words")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """The kept columns of all documents (all by default), with size, source_size, target and taken (in words)."""
    names = [prefix + c for c in OUT]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    numbered = stored(
        docs.select(
            *[named(c).alias(f"_in_{c}") for c in keep],
            F.col(source).alias("source"),
            words_in(F.col(text)).alias("size"),
            (-F.ln(uniform(F.col(id_col))) / quality_weight(F.col(text))).alias("key"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "numbered",
        codec="zstd",
    )
    rows = numbered.select("source", "size", "key", "row")
    targets = stored(source_targets(rows), "targets")
    cuts = _cuts(rows, targets)
    plan = stored(targets.alias("t").join(cuts.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left").select("t.source", "source_size", "target", "epochs", "key", "row", "words"), "plan")
    at, edge = F.struct("r.key", "r.row"), F.struct("p.key", "p.row")
    part = F.when(at < edge, F.col("size")).when(at == edge, F.least("size", "words")).otherwise(0)
    taken = F.coalesce(F.col("epochs") * F.col("size") + F.coalesce(part, F.lit(0)), F.lit(0)).cast("long")
    out = numbered.alias("r").join(_small(plan).alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    made = [F.col("size"), F.col("source_size"), F.col("target"), taken]
    return out.select(*[named(f"_in_{c}").alias(c) for c in keep], *[c.alias(n) for c, n in zip(made, names, strict=True)])


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    words = F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), n.cast("int"))
    gaps = F.slice(F.split(text, WORD, -1), F.lit(1), n.cast("int"))
    return F.array_join(F.zip_with(gaps, words, lambda g, w: F.concat(g, w)), "")


def mixed_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: a row per time that a document is taken, the last one shortened where only a part is."""
    mixed = mix(docs, prefix="__mix_")
    size, taken = F.col("__mix_size"), F.col("__mix_taken")
    each = mixed.withColumn("__mix_turn", F.explode(F.when(taken > 0, F.sequence(F.lit(1).cast("long"), F.ceil(taken / size)))))
    words = taken - (F.col("__mix_turn") - 1) * size
    cut = F.when(words < size, first_words(F.col(text), words)).otherwise(F.col(text))
    return each.select(*[cut.alias(text) if c == text else named(c) for c in docs.columns])
