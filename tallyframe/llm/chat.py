"""Chat formatting of reply trees.

Messages point to the message they answer. Iterated self-joins double the reach of every pointer: after k rounds a message
knows its 2^k-th ancestor and the score summed up on the way, so depth d takes log2(d) joins. The summed score of a leaf
ranks its branch; for the chosen leaves the same pointers, used from the first round on, list every message of the path.
Each path becomes one conversation in a template that marks turns, with a loss mask over what the assistant says.

Control strings in texts and roles get a backslash after their first character (one more, if there are some already), so
they are not control strings any more, and reading takes exactly one away again.

Defined results: null texts and roles are empty; null scores count 0; a message whose parent is not there is a root;
messages in a cycle have no root and are left out; among equal mean scores the smallest leaf id wins; messages with the
same tree, id and content count once; a null tree is a tree of its own; no messages give no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Control strings of this and other chat templates, first character apart.
CONTROL = [
    ("<", "|im_start|>"),
    ("<", "|im_end|>"),
    ("<", "|endoftext|>"),
    ("<", "s>"),
    ("<", "/s>"),
    ("[", "INST]"),
    ("[", "/INST]"),
    ("<", "<SYS>>"),
    ("<", "</SYS>>"),
]
_FIRST = "|".join(sorted({re.escape(a) for a, _ in CONTROL}))
_REST = "|".join(sorted({re.escape(b) for _, b in CONTROL}))
_PLAIN = re.compile(rf"({_FIRST})(\\*)({_REST})")
_ESCAPED = re.compile(rf"({_FIRST})\\(\\*)({_REST})")


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans (code points) of the texts to learn from."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body, tail = f"{OPEN}{_role_out(role)}\n", escape(text), f"{CLOSE}\n"
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(tail)
        parts += [head, body, tail]
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    turns = []
    for part in formatted.split(OPEN)[1:]:
        role, _, rest = part.partition("\n")
        turns.append((_role_in(role), unescape(rest.removesuffix(f"{CLOSE}\n"))))
    return turns


def _pointers(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Pointers (tree, id, up, total, hops) to the 2^k-th ancestor by round k, and the messages that reached their root.

    total and hops add up scores and messages on the way. A message that has reached its root leaves the rounds, so later
    ones only hold what is deep.
    """
    known = nodes.select(F.col("tree").alias("_t"), F.col("id").alias("_i"))
    rooted = nodes.join(known, (F.col("tree") == F.col("_t")) & (F.col("parent") == F.col("_i")), "left")
    far = stored(rooted.select("tree", "id", F.col("_i").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("hops")), "pointers")
    rounds, done, reach, size = [], far.where("up is null"), 1, nodes.count()
    while True:
        rounds.append(far.where("up is not null"))
        if reach > size or not rounds[-1].head(1):
            return rounds, done
        ahead = rounds[-1].union(done).select(F.col("tree").alias("_t"), F.col("id").alias("_i"), F.col("up").alias("_up"), F.col("total").alias("_total"), F.col("hops").alias("_hops"))
        both = rounds[-1].join(ahead, (F.col("tree") == F.col("_t")) & (F.col("up") == F.col("_i")))
        far = stored(both.select("tree", "id", F.col("_up").alias("up"), (F.col("total") + F.col("_total")).alias("total"), (F.col("hops") + F.col("_hops")).alias("hops")), "pointers")
        done = done.union(far.where("up is null"))
        reach *= 2


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, position, id) of the messages on the best branches of each root; position 0 is the root.

    messages: tree (string), id, parent, score; one row per id.
    """
    nodes = stored(messages.select("tree", "id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "nodes")
    rounds, done = _pointers(nodes)
    parents = nodes.select("tree", F.col("parent").alias("id")).where("id is not null").distinct()
    ends = done.join(parents, ["tree", "id"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("hops")), "id")
    chosen = ends.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= branches)
    path = stored(chosen.select("tree", F.col("id").alias("leaf"), "hops", "id", F.lit(0).cast("long").alias("down")), "path")
    for k, far in enumerate(rounds):
        step = far.select(F.col("tree").alias("_t"), F.col("id").alias("_i"), "up")
        more = path.join(step, (F.col("tree") == F.col("_t")) & (F.col("id") == F.col("_i"))).select("tree", "leaf", "hops", F.col("up").alias("id"), (F.col("down") + (1 << k)).alias("down"))
        path = stored(path.union(more), "path")
    return path.select("tree", "leaf", (F.col("hops") - 1 - F.col("down")).alias("position"), "id")


def format_trees(messages: DataFrame, branches: int = 1, learn: str = "assistant") -> DataFrame:
    """(tree, leaf, formatted, spans): one conversation per chosen branch, stored.

    messages: tree, id, parent, role, text, score.
    """
    keyed = messages.withColumn("tree", F.coalesce(F.concat(F.lit("t"), F.col("tree").cast("string")), F.lit("-")))
    one = stored(keyed.groupBy("tree", "id").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("tree", "id", "m.*"), "messages")
    at = best_paths(one, branches).join(one.select("tree", "id", "role", "text"), ["tree", "id"])
    turn = F.struct("position", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    paths = at.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def run(batches):
        for batch in batches:
            made = [format_turns([(t["role"], t["text"]) for t in turns], learn) for turns in batch.column("turns").to_pylist()]
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in made], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("leaf"), pa.array([f for f, _ in made], pa.string()), spans], names=["tree", "leaf", "formatted", "spans"])

    kind = one.schema["id"].dataType.simpleString()
    return stored(paths.mapInArrow(run, f"tree string, leaf {kind}, formatted string, spans array<struct<start:bigint,end:bigint>>"), "chat", codec="zstd")


def linear_messages(rows: DataFrame) -> DataFrame:
    """Messages of conversations given as rows (conv_id, turn, role, text): each answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.withColumn("id", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("id") > 1, F.col("id") - 1)
    return numbered.select(F.col("conv_id").alias("tree"), "id", parent.alias("parent"), "role", "text", F.lit(None).cast("double").alias("score"))


def read_back(chat: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from stored conversations."""

    def run(batches):
        for batch in batches:
            rows = []
            for tree, formatted, spans in zip(batch.column("tree").to_pylist(), batch.column("formatted").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                turns = parse_turns(formatted)
                loss = "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)
                digest = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((None if tree == "-" else int(tree[1:]), len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), len(formatted)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return chat.select("tree", "formatted", "spans").mapInArrow(run, schema)
