"""Corpus text metrics: counts per prediction/reference pair in Arrow batches, sums and closed forms in Spark.

Only a handful of numbers per pair is shuffled, never n-grams. The conventions are choices of this library: the mteval
13a tokenization and exponential smoothing for BLEU; chrF with characters 1-6, beta 2, blanks removed; TER on lower-case
words split at blanks.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The substitutions of the published 13a tokenization.
TOKENIZE_13A = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
    (r"([^0-9])([\.,])", r"\1 \2 "),
    (r"([\.,])([^0-9])", r" \1 \2"),
    (r"([0-9])(-)", r"\1 \2 "),
]
BLEU_ORDER, CHRF_ORDER, CHRF_BETA = 4, 6, 2.0
# Limits of the published shift search.
MAX_SHIFT_SIZE, MAX_SHIFT_DISTANCE = 10, 50

BLEU_COLUMNS = [f"{k}{n}" for k in ("match", "total") for n in range(1, 5)] + ["pred_len", "ref_len"]
CHRF_COLUMNS = [f"{k}{n}" for k in ("hyp", "ref", "match") for n in range(1, 7)]
TER_COLUMNS = ["edits", "ref_len"]


def words_13a(text: str) -> list[str]:
    text = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    if "&" in text:
        text = text.replace("&quot;", '"').replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">")
    text = f" {text} "
    for pattern, to in TOKENIZE_13A:
        text = re.sub(pattern, to, text)
    return text.split()


def _grams(items, n: int) -> Counter:
    return Counter(tuple(items[i : i + n]) for i in range(len(items) - n + 1))


def bleu_counts(pred: str, refs: list[str]) -> list[float]:
    p, rs = words_13a(pred), [words_13a(r) for r in refs]
    match, total = [], []
    for n in range(1, BLEU_ORDER + 1):
        mine, best = _grams(p, n), Counter()
        for r in rs:
            best |= _grams(r, n)
        match.append(float(sum((mine & best).values())))
        total.append(float(max(len(p) - n + 1, 0)))
    closest = min((abs(len(r) - len(p)), len(r)) for r in rs)[1]
    return match + total + [float(len(p)), float(closest)]


def _chrf_one(pred: str, ref: str) -> list[float]:
    a, b = "".join(pred.split()), "".join(ref.split())
    hyp, got, match = [], [], []
    for n in range(1, CHRF_ORDER + 1):
        x = Counter(a[i : i + n] for i in range(len(a) - n + 1))
        y = Counter(b[i : i + n] for i in range(len(b) - n + 1))
        hyp.append(float(sum(x.values())))
        got.append(float(sum(y.values())))
        match.append(float(sum((x & y).values())))
    return hyp + got + match


def chrf_value(s: list[float]) -> float:
    precision = recall = 0.0
    orders = 0
    for n in range(CHRF_ORDER):
        h, r, m = s[n], s[CHRF_ORDER + n], s[2 * CHRF_ORDER + n]
        if h > 0 and r > 0:
            orders, precision, recall = orders + 1, precision + m / h, recall + m / r
    if precision + recall == 0:
        return 0.0
    precision, recall, b2 = precision / orders, recall / orders, CHRF_BETA**2
    return 100 * (1 + b2) * precision * recall / (b2 * precision + recall)


def chrf_counts(pred: str, refs: list[str]) -> list[float]:
    """Of several references the one with the best score counts."""
    return max((_chrf_one(pred, r) for r in refs), key=chrf_value)


def _positions(ref: list[str]) -> dict[str, int]:
    """Bit mask of the places of each word."""
    bits: dict[str, int] = {}
    for j, w in enumerate(ref):
        bits[w] = bits.get(w, 0) | 1 << j
    return bits


def _step(up: int, down: int, eq: int, full: int) -> tuple[int, int, int, int]:
    """One word further: where the distance rises and falls from this column of the table to the next, then inside the next."""
    if not eq:
        right = full ^ up
        shifted = (right << 1) | 1
        return right, 0, full & ~(down | shifted), shifted & down
    diagonal = (((eq & up) + up) ^ up) | eq | down
    right, left = down | (full & ~(diagonal | up)), up & diagonal
    either, shifted = eq | down, (right << 1) | 1
    return right, left, ((left << 1) & full) | (full & ~(either | shifted)), shifted & either


class _Alignment:
    """A text beside a reference: their edit distance, the errors of each, and the distance of the text with a run moved.

    A column of the table is two long integers: where the distance rises and where it falls from one reference place to the
    next. All columns are kept, so that a text that differs from some place on goes on from there.
    """

    def __init__(self, words: list[str], ref: list[str], bits: dict[str, int]):
        self.words, self.ref, self.full = words, ref, (1 << len(ref)) - 1
        self.eq = [bits.get(w, 0) for w in words]
        up, down = self.full, 0
        self.columns, self.across = [(up, down)], []
        for eq in self.eq:
            right, left, up, down = _step(up, down, eq, self.full)
            self.columns.append((up, down))
            self.across.append((right, left))
        self.cost = len(words) + up.bit_count() - down.bit_count()

    def errors(self) -> tuple[list[bool], list[bool], list[int]]:
        """Which words and which reference words are not matched, and the last word at or before each reference place."""
        words, ref = self.words, self.ref
        wrong, missed, at = [True] * len(words), [True] * len(ref), [0] * len(ref)
        i, j = len(words), len(ref)
        while j:
            if i:
                bit, (right, left), (up, down) = 1 << (j - 1), self.across[i - 1], self.columns[i - 1]
                differ = words[i - 1] != ref[j - 1]
                step = bool(right & bit) - bool(left & bit)
                if step + bool(up & bit) - bool(down & bit) == differ:
                    i, j = i - 1, j - 1
                    wrong[i] = missed[j] = differ
                    at[j] = i
                    continue
                if step == 1:
                    i -= 1
                    continue
            j -= 1
            at[j] = i - 1
        return wrong, missed, at

    def moved(self, i: int, k: int, to: int) -> int:
        """Distance when k words from i on stand before word `to`, outside of them."""
        eq, full, columns = self.eq, self.full, self.columns
        first, end = min(i, to), max(i + k, to)
        middle = eq[i : i + k] + eq[to:i] if to < i else eq[i + k : to] + eq[i : i + k]
        up, down = columns[first]
        for e in middle:
            _, _, up, down = _step(up, down, e, full)
        for n in range(end, len(eq)):
            if (up, down) == columns[n]:
                return self.cost  # the rest is the same as before
            _, _, up, down = _step(up, down, eq[n], full)
        return len(eq) + up.bit_count() - down.bit_count()


def _shifts(words: list[str], ref: list[str], wrong: list[bool], missed: list[bool], at: list[int]):
    """(i, k, to): moves of a run of k words that stands elsewhere in the reference, when both places hold an error."""
    places: dict[str, list[int]] = {}
    for j, w in enumerate(ref):
        places.setdefault(w, []).append(j)
    for i, w in enumerate(words):
        for j in places.get(w, ()):
            if abs(i - j) > MAX_SHIFT_DISTANCE:
                continue
            for k in range(1, MAX_SHIFT_SIZE + 1):
                if i + k > len(words) or j + k > len(ref) or words[i + k - 1] != ref[j + k - 1]:
                    break
                if not any(wrong[i : i + k]) or not any(missed[j : j + k]) or i <= at[j] < i + k:
                    continue
                for to in {at[j + t] + 1 if j + t >= 0 else 0 for t in range(-1, k)}:
                    if to < i or to > i + k:
                        yield i, k, to


def ter_counts(pred: str, refs: list[str]) -> list[float]:
    """Fewest edits over the references, shifts included (greedy: the best shift first), and mean reference length."""
    words = pred.lower().split()
    best, lengths = None, []
    for text in refs:
        ref, hyp, shifts = text.lower().split(), words, 0
        bits = _positions(ref)
        lengths.append(len(ref))
        now = _Alignment(hyp, ref, bits)
        while now.cost:
            # a shift must save more than itself; k words moved change the distance by at most 2 k
            least, found = now.cost - 1, None
            for i, k, to in _shifts(hyp, ref, *now.errors()):
                if now.cost - 2 * k < least and (cost := now.moved(i, k, to)) < least:
                    least, found = cost, (i, k, to)
            if found is None:
                break
            i, k, to = found
            rest, cut = hyp[:i] + hyp[i + k :], to if to < i else to - k
            hyp, shifts = rest[:cut] + hyp[i : i + k] + rest[cut:], shifts + 1
            now = _Alignment(hyp, ref, bits)
        best = now.cost + shifts if best is None else min(best, now.cost + shifts)
    return [float(best), sum(lengths) / len(lengths)]


def _udf(columns: list[str], fn):
    @F.pandas_udf(", ".join(f"{c} double" for c in columns))
    def run(pred: pd.Series, refs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fn(p or "", list(r)) for p, r in zip(pred, refs)], columns=columns)

    return run


_KINDS = {
    "bleu": (BLEU_COLUMNS, bleu_counts),
    "chrf": (CHRF_COLUMNS, chrf_counts),
    "ter": (TER_COLUMNS, ter_counts),
}


STAT_COLUMNS = {k: v[0] for k, v in _KINDS.items()}


def with_pair_stats(df: DataFrame, metric: str, pred: str = "prediction", refs: str = "references") -> DataFrame:
    columns, fn = _KINDS[metric]
    out = df.withColumn("_pair", _udf(columns, fn)(F.col(pred), F.col(refs)))
    return out.select(*[c for c in df.columns if c not in columns], *[F.col(f"_pair.{c}") for c in columns])


def bleu_from_sums() -> Column:
    """Zero matches of order n count as 1/2, 1/4, ... (exponential smoothing)."""
    logs, zeros = [], F.lit(0)
    for n in range(1, BLEU_ORDER + 1):
        m, t = F.col(f"match{n}"), F.col(f"total{n}")
        zeros = zeros + F.when((m == 0) & (t > 0), 1).otherwise(0)
        smooth = F.when(m > 0, m).otherwise(F.pow(F.lit(0.5), zeros))
        logs.append(F.log(F.try_divide(smooth, t)))
    brevity = F.when(
        F.col("pred_len") < F.col("ref_len"), F.exp(1 - F.try_divide(F.col("ref_len"), F.col("pred_len")))
    ).otherwise(1.0)
    score = 100 * brevity * F.exp((logs[0] + logs[1] + logs[2] + logs[3]) / BLEU_ORDER)
    return F.when((F.col("match1") > 0) & (F.col("total4") > 0), score).otherwise(0.0)


def chrf_from_sums() -> Column:
    p = r = k = F.lit(0.0)
    for n in range(1, CHRF_ORDER + 1):
        h, g, m = F.col(f"hyp{n}"), F.col(f"ref{n}"), F.col(f"match{n}")
        both = (h > 0) & (g > 0)
        p = p + F.when(both, F.try_divide(m, h)).otherwise(0.0)
        r = r + F.when(both, F.try_divide(m, g)).otherwise(0.0)
        k = k + F.when(both, 1.0).otherwise(0.0)
    b2 = CHRF_BETA**2
    p, r = F.try_divide(p, k), F.try_divide(r, k)
    return F.coalesce(100 * F.try_divide((1 + b2) * p * r, b2 * p + r), F.lit(0.0))


def ter_from_sums() -> Column:
    none = F.when(F.col("edits") > 0, 100.0).otherwise(0.0)
    return F.coalesce(100 * F.try_divide(F.col("edits"), F.col("ref_len")), none)


def corpus_metric(df: DataFrame, keys: list[str], metric: str, pred: str = "prediction", refs: str = "references") -> DataFrame:
    columns, _ = _KINDS[metric]
    sums = with_pair_stats(df, metric, pred, refs).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns])
    return sums.select(*keys, from_sums(metric).alias(metric))


def from_sums(metric: str) -> Column:
    return {"bleu": bleu_from_sums, "chrf": chrf_from_sums, "ter": ter_from_sums}[metric]()
