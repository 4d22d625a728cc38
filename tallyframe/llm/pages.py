"""The main text of web pages, by paths that the pages of a host agree on.

Every page scores its containers: squared recall times precision of the plain text (text outside of links and of parts that tags or
class names mark as boilerplate, long blocks above short ones) that a container holds, with a preference for `article` and `main`. It votes for the path of
its best one: tags and classes from the body down, with numbers in class names generalised. Spark counts the votes per host.
A host's winning paths are those with at least `SHARE` of its pages, most votes first. Pages are then read again: all
containers on the first winning path that a page has are its main text; a page without one, with hardly any of its text
there, or without a host goes by its own best container.

The main text is cut into blocks where block elements begin and end. Left out are menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and comments, by tag, role or class and id words, unless such a part holds the page's `main`
or `h1`. Character references are decoded, runs of white space (line breaks too) are one space, blocks are joined by one
line feed; nothing else is dropped.

Markup need not be well formed: end tags may lack, p, li, cells and the like end where the next one begins, stray end tags
are ignored, and comments, scripts and tags that never end run to the end of the page. Time and memory follow the page.

Votes are added up before they are shuffled, so a host with a third of all pages is no hot task. Winning paths are sent to
all tasks if they are below `BROADCAST` bytes, and else joined with salted hosts.

Defined results: null and empty pages, and pages without text, have an empty text; a null or odd URL has no host; repeated
rows stay and vote each; ties of votes go to the higher total score, then to the path that sorts first; an empty table gives
no rows; other columns stay as they are, `text` and `path` are replaced.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, named, stored

SHARE = 0.1
BROADCAST = 16 << 20
SALTS = 32
#: Blocks of this many characters and more count in full, shorter ones in proportion: labels and bylines say little.
FULL = 80
#: A page whose winning container has less than this share of the plain text in its own best one goes by the latter.
AT_LEAST = 0.25

TOKEN = re.compile(
    r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _set(text: str) -> frozenset[str]:
    return frozenset(text.split())


#: Fixed values of HTML: elements without content, with raw text, of running text, and those that end a paragraph.
VOID = _set("area base br col embed frame hr img input link meta param source track wbr")
RAW = _set("script style title textarea iframe noembed noframes xmp")
INLINE = _set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr"
)
ENDS_P = _set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt"
)
P_SCOPE = _set("table td th caption button object template")
HEAD = _set("base link meta title style script noscript template")
#: Elements that the next one of their kind ends, and what they cannot end across.
SIBLINGS = {
    **dict.fromkeys(["li"], (_set("li"), _set("ul ol menu"))),
    **dict.fromkeys(["dd", "dt"], (_set("dd dt"), _set("dl"))),
    **dict.fromkeys(["td", "th"], (_set("td th"), _set("tr table"))),
    **dict.fromkeys(["tr"], (_set("tr"), _set("table tbody thead tfoot"))),
    **dict.fromkeys(["tbody", "thead", "tfoot"], (_set("tbody thead tfoot caption"), _set("table"))),
    **dict.fromkeys(["option", "optgroup"], (_set("option"), _set("select"))),
}
#: Parts that are never main text: by tag, by role, by words in class and id.
OUT_TAGS = _set("head nav header footer aside form button select datalist noscript object svg canvas audio video template dialog menu map math applet")
OUT_ROLES = _set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar")
OUT_WORDS = _set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar aside footer header masthead comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets pagination pager toolbar skip form search"
)
#: Words that turn the others around: a page "with sidebar" is none.
NOT_OUT = _set("with has no without")
HEADINGS = _set("h1 h2 h3 h4 h5 h6")
NO_CONTAINER = HEADINGS | _set("p li dd dt pre blockquote ul ol dl tr tbody thead tfoot caption figcaption summary hr")


class Page:
    """Elements in page order, as parallel lists, and the pieces of text with their element and block."""

    def __init__(self, source: str):
        self.parent, self.tag, self.step, self.end = [-1], ["body"], [""], [0]
        self.soft, self.out = [False], [False]
        self.texts: list[tuple[int, int, str]] = []
        self._read(source)
        self._weigh()

    def _read(self, source: str) -> None:
        stack, open_tags, block, at = [0], Counter(), 0, 0

        def pop() -> str:
            n = stack.pop()
            self.end[n] = len(self.tag)
            open_tags[self.tag[n]] -= 1
            return self.tag[n]

        def end_nearest(tags, stops) -> None:
            """Ends the innermost open element of some tags unless a stop is in between."""
            if not any(open_tags[t] > 0 for t in tags):
                return
            for n in range(len(stack) - 1, 0, -1):
                t = self.tag[stack[n]]
                if t in tags:
                    while len(stack) > n:
                        pop()
                    return
                if t in stops:
                    return

        size = len(source)
        while at < size:
            found = TOKEN.search(source, at)
            until = found.start() if found else size
            if until > at:
                piece = source[at:until]
                if open_tags["head"] > 0 and not piece.isspace():
                    end_nearest({"head"}, ())
                self.texts.append((stack[-1], block, references.unescape(piece) if "&" in piece else piece))
            if not found:
                break
            at = found.end()
            tag = (found[2] or "").lower()
            if not tag or tag in ("html", "body"):
                if tag == "body":
                    end_nearest({"head"}, ())
                continue
            if found[1]:
                if tag not in INLINE:
                    block += 1
                if tag == "br":
                    self.texts.append((stack[-1], block, " "))
                elif open_tags[tag] > 0:
                    n = len(stack) - 1
                    while self.tag[stack[n]] != tag:
                        if tag in INLINE and self.tag[stack[n]] not in INLINE:
                            n = -1  # a stray end tag of running text does not end a block
                            break
                        n -= 1
                    while n > 0 and len(stack) > n:
                        pop()
                continue
            if open_tags["head"] > 0 and tag not in HEAD:
                end_nearest({"head"}, ())
            if tag in RAW:
                close = re.compile("</" + re.escape(tag) + r"(?=[\s/>]|\Z)", re.I).search(source, at)
                at = close.start() if close else size
                if close:  # its end tag goes too
                    shut = source.find(">", close.end())
                    at = shut + 1 if shut >= 0 else size
                continue
            if tag not in INLINE:
                block += 1
            if tag in SIBLINGS:
                end_nearest(*SIBLINGS[tag])
            if tag in ENDS_P:
                end_nearest({"p"}, P_SCOPE)
            if tag in HEADINGS and self.tag[stack[-1]] in HEADINGS:
                pop()
            if tag == "br":
                self.texts.append((stack[-1], block, " "))
            if tag in VOID:
                continue
            self._open(tag, found[3], stack[-1])
            if not found[3].endswith("/") or tag in ENDS_P or tag in INLINE:
                stack.append(len(self.tag) - 1)
                open_tags[tag] += 1
        while stack:
            self.end[stack.pop()] = len(self.tag)

    def _open(self, tag: str, raw: str, parent: int) -> None:
        soft, out, classes = False, tag in OUT_TAGS, ""
        if raw.strip(" /\t\n\r\f"):
            found = {}
            for name, value in ATTRIBUTE.findall(raw):
                found.setdefault(name.lower(), value[1:-1] if value[:1] in "\"'" and len(value) > 1 else value)
            names = found.get("class", "")
            classes = "".join("." + c for c in sorted(set(re.sub(r"\d+", "0", references.unescape(names).lower()).split())))
            words = [{w.lower() for w in WORDS.findall(part)} for part in f"{names} {found.get('id', '')}".split()]
            soft = any(w & OUT_WORDS and not w & NOT_OUT for w in words) or found.get("role", "").lower() in OUT_ROLES
            style = re.sub(r"\s", "", found.get("style", "").lower())
            out |= "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style
        self.parent.append(parent)
        self.tag.append(tag)
        self.step.append(tag + classes)
        self.end.append(len(self.tag))
        self.soft.append(soft)
        self.out.append(out)

    def _weigh(self) -> None:
        """Which elements are left out, and how much text and plain text every element holds."""
        n = len(self.tag)
        holds_main = [t in ("main", "h1") for t in self.tag]
        for i in range(n - 1, 0, -1):
            holds_main[self.parent[i]] |= holds_main[i]
        in_link = [False] * n
        for i in range(1, n):
            p = self.parent[i]
            self.out[i] = self.out[p] or self.out[i] or (self.soft[i] and not holds_main[i])
            in_link[i] = in_link[p] or self.tag[i] == "a"
        self.all, self.plain = [0] * n, [0] * n  # plain text in units of 1 / FULL
        sizes = [len(text.strip()) for _, _, text in self.texts]
        of_block: Counter[int] = Counter()
        for (i, block, _), size in zip(self.texts, sizes, strict=True):
            if not (self.out[i] or in_link[i]):
                of_block[block] += size
        for (i, block, _), size in zip(self.texts, sizes, strict=True):
            self.all[i] += size
            if not (self.out[i] or in_link[i]):
                self.plain[i] += size * min(FULL, of_block[block])
        for i in range(n - 1, 0, -1):
            self.all[self.parent[i]] += self.all[i]
            self.plain[self.parent[i]] += self.plain[i]

    def best(self) -> tuple[int, float]:
        """The container with the highest score; of equal ones the innermost, then the first."""
        top, score, total = 0, 0.0, self.plain[0]
        for i, plain in enumerate(self.plain):
            if not plain or self.out[i] or self.tag[i] in NO_CONTAINER or self.tag[i] in INLINE:
                continue
            s = (plain / total) ** 2 * (plain / self.all[i] / FULL) * (1.1 if self.tag[i] in ("article", "main") else 1.0)
            if s > score or (s == score and self.parent[i] == top):
                top, score = i, s
        return top, score

    def path(self, i: int) -> str:
        steps = []
        while i > 0:
            steps.append(self.step[i])
            i = self.parent[i]
        return ">".join(reversed(steps))

    def on_path(self, path: str) -> list[int]:
        """The elements on a path, in page order; none of them holds another."""
        steps = path.split(">") if path else []
        if not steps:
            return [0]
        depth, hits = [0] + [-1] * (len(self.tag) - 1), []
        for i in range(1, len(self.tag)):
            d = depth[self.parent[i]]
            if 0 <= d < len(steps) and not self.out[i] and self.step[i] == steps[d]:
                depth[i] = d + 1
                if d + 1 == len(steps):
                    hits.append(i)
        return hits

    def text(self, containers: list[int]) -> str:
        inside = [False] * len(self.tag)
        for c in containers:
            inside[c : self.end[c]] = [True] * (self.end[c] - c)
        blocks, last, parts = [], None, []
        for i, block, text in self.texts:
            if inside[i] and not self.out[i]:
                if block != last and parts:
                    blocks.append("".join(parts))
                    parts = []
                last = block
                parts.append(text)
        blocks.append("".join(parts))
        return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)

    def main_text(self, paths: list[str]) -> tuple[str, str]:
        """The main text and the path it was found at."""
        own, _ = self.best()
        for path in paths:
            hits = self.on_path(path)
            if hits:
                if sum(self.plain[i] for i in hits) >= AT_LEAST * self.plain[own]:
                    return self.text(hits), path
                break
        return self.text([own]), self.path(own)


def host_of(url: Column) -> Column:
    """The host of a URL in small letters, without user and port; null if there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:@\s]+)", 1)
    return F.when(host != "", host)


def votes(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(host, path, votes, score): how many pages of a host have their best container at a path, and their scores together."""

    def run(batches):
        for batch in batches:
            paths, scores = [], []
            for source in batch.column("html"):
                page = Page(source.as_py() or "")
                top, score = page.best()
                paths.append(page.path(top) if score else None)
                scores.append(round(score * 1_000_000))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string()), pa.array(scores, pa.int64())], names=["a", "b", "c"])

    rows = pages.select(host_of(named(url)).alias("host"), named(html).alias("html")).where("host IS NOT NULL")
    voted = mapped(rows, run, [("host", "string"), ("path", "string"), ("score", "bigint")])
    return voted.where("path IS NOT NULL").groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))


def winning_paths(counted: DataFrame, share: float = SHARE) -> DataFrame:
    """(host, paths): the paths of at least a share of a host's voting pages, most votes first."""
    total = counted.groupBy("host").agg(F.sum("votes").alias("total"))
    good = counted.join(total, "host").where(F.col("votes") >= share * F.col("total"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), (-F.col("score")).alias("s"), "path")))
    return good.groupBy("host").agg(listed.alias("l")).select("host", F.col("l.path").alias("paths"))


def _with_paths(pages: DataFrame, winners: DataFrame) -> DataFrame:
    """Adds a host's winning paths to its pages, without a hot host in one task."""
    size = winners.agg(F.sum(F.length("_host") + F.aggregate("_paths", F.lit(0), lambda a, p: a + F.length(p) + 16))).first()[0] or 0
    if size <= BROADCAST:
        return pages.join(F.broadcast(winners), "_host", "left") if size else pages.withColumn("_paths", F.array().cast("array<string>"))
    salted = winners.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("_salt", F.pmod(F.xxhash64("_html"), F.lit(SALTS)).cast("int")).join(salted, ["_host", "_salt"], "left").drop("_salt")


def main_text(pages: DataFrame, html: str = "html", url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """Adds `text`, the main text, and `path`, where it was found. keep: the columns to carry along, all by default."""
    kept = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "path")]
    winners = stored(winning_paths(votes(pages, html, url)), "paths").select(F.col("host").alias("_host"), F.col("paths").alias("_paths"))
    source = pages.select(
        *[named(c).alias(f"k{i}") for i, c in enumerate(kept)], named(html).alias("_html"), host_of(named(url)).alias("_host")
    )
    work = _with_paths(source, winners).select(*[f"k{i}" for i in range(len(kept))], "_html", "_paths")
    types = [source.schema[f"k{i}"].dataType for i in range(len(kept))]

    def run(batches):
        for batch in batches:
            texts, paths = [], []
            for source, wins in zip(batch.column("_html"), batch.column("_paths"), strict=True):
                text, path = Page(source.as_py() or "").main_text(wins.as_py() or [])
                texts.append(text)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string()), pa.array(paths, pa.string())], names=[str(i) for i in range(len(kept) + 2)])

    return mapped(work, run, [*zip(kept, types, strict=True), ("text", "string"), ("path", "string")])
