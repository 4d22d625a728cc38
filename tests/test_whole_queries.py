"""The queries over all rows and whole texts, which have no SQL, against brute force."""

import re

import numpy as np
import pytest

from tallyframe.functions import parsing
from tallyframe.plans import QUERIES, fixtures

FOLDER = "/root/testdata/sf0.001"
TAGS = [("<think>", "</think>"), ("<r>", "</r>")]


def flat(pattern):
    """The pattern without Java's flag for Unicode classes, which Python's patterns have anyway."""
    return re.compile(re.sub(r"^\(\?(\w*)U\)", lambda m: f"(?{m[1]})" if m[1] else "", pattern))


def plain(text):
    return re.sub(parsing.ANSI, "", text).replace(parsing.COMBINING_LINE, "")


def letter(text, n):
    up = plain(text).upper().strip()
    for head, tail in (parsing.LETTER_PHRASE, parsing.LETTER_LEADING, parsing.LETTER_BULLET):
        m = flat(head + chr(64 + n) + tail).search(up)
        if m and 0 <= ord(m[1]) - 65 < n:
            return ord(m[1]) - 65
    return -1


def relation(text):
    text = " ".join(text.lower().split())
    return parsing.RELATION_SYNONYMS.get(text, text).strip(" .,:;!?()[]{}\"'`*_")


def cleaned(text):
    text = flat(parsing.REASONING_TAIL).sub("", plain(text).strip()).strip()
    stated = flat(parsing.FINAL_LETTER).findall(text)[-1:] or flat(parsing.FINAL_TEXT).findall(text)[-1:]
    rest = stated[0].strip() if stated else flat(parsing.ECHO).sub("", text).strip()
    return re.match(parsing.FIRST_LINE, rest)[0].strip()


def choice(text, options):
    norm, options = relation(cleaned(text)), [relation(o) for o in options]
    inside = lambda part, whole: part != "" and re.search(rf"\b{re.escape(part)}\b", whole) is not None
    said = flat(parsing.YES_NO).search(norm)
    tests = [lambda o: o == norm, lambda o: said is not None and o == said[1].lower(), lambda o: inside(o, norm), lambda o: inside(norm, o)]
    return next((i for t in tests for i, o in enumerate(options) if t(o)), -1)


def distance(a, b):
    x, y = (np.array([ord(c) for c in s], np.int64) for s in (a, b))
    at = np.arange(len(y) + 1)
    row = at
    for i, c in enumerate(x):
        best = np.concatenate([[i + 1], np.minimum(row[1:] + 1, row[:-1] + (y != c))])
        row = np.minimum.accumulate(best - at) + at
    return int(row[-1])


def anls(text, refs, threshold):
    norm = lambda s: " ".join(s.lower().split())
    longest = [max(len(r.upper()), len(text.upper())) for r in refs]
    s = 1 - min(distance(norm(r), norm(text)) / n if n else 0.0 for r, n in zip(refs, longest, strict=True))
    return 0.0 if s < threshold else s


def rows(spark, name):
    return QUERIES[name](spark, FOLDER).collect()


def test_replies(spark):
    replies = {r.doc_id: r for r in fixtures.replies(spark, FOLDER).collect()}
    letters, choices = rows(spark, "letter_index"), rows(spark, "choice_text_index")
    assert len(letters) == len(choices) == len(replies)
    assert [(r.doc_id, r.idx4, r.idx2) for r in letters] == [(r.doc_id, letter(replies[r.doc_id].prediction, 4), letter(replies[r.doc_id].prediction, 2)) for r in letters]
    assert [(r.doc_id, r.idx) for r in choices] == [(r.doc_id, choice(replies[r.doc_id].prediction, replies[r.doc_id].choices)) for r in choices]


def test_strip_reasoning(spark):
    turns = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()}
    got = rows(spark, "strip_reasoning")
    assert len(got) == len(turns)
    for r in got:
        s, role = turns[r.conv_id, r.turn].text, turns[r.conv_id, r.turn].role
        want = [f"<think>a\nb</think> {s}", f"{s}</think>x</think>\n{role}", f"{role}<r>{s}</r><think></think>{s}", f"<think>{role} "][r.turn % 4]
        for start, end in TAGS:
            want = re.sub(f"(?s){start}.*?{end}", "", want)
            want = want if start in want else want.rsplit(end, 1)[-1]
        assert r.response == want.strip()


def test_text_metrics(spark):
    pairs = {(r.conv_id, r.turn): r for r in fixtures.turn_pairs(spark, FOLDER).collect()}
    got = rows(spark, "anls")
    assert len(got) == len(pairs)
    for r in got:
        p = pairs[r.conv_id, r.turn]
        assert r.anls == pytest.approx(anls(p.prediction, p.references, 0.25), abs=1e-6)
    got = rows(spark, "score_generation")
    assert len(got) == len(pairs)
    for r in got:
        p, k = pairs[r.conv_id, r.turn], r.turn % 3
        said, targets = p.prediction.strip(), [[p.prediction], [p.reference, p.prediction], ["1", "2"]][k]
        assert (r.exact_match, r.anls) == (float(said in targets), pytest.approx(anls(said, targets, 0.95)))


def test_merge_shards(spark):
    best = {}
    for r in fixtures.stored(spark, FOLDER).collect():
        rank = (r.shard > 0, r.shard, r.created_at, r.response)
        best[r.cache_key] = min(best.get(r.cache_key, rank), rank)
    got = rows(spark, "merge_shards")
    assert sorted((r.cache_key, r.created_at, r.response) for r in got) == sorted((k, v[2], v[3]) for k, v in best.items())
