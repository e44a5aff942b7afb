"""Main text of web pages by the maximum-scoring run of tokens.

A page is a sequence of tags and words. Words score from -2 to 1, by the weights of what
encloses them: names of elements, and whole words and parts of their classes and ids. Tags score
negative, by how much more often they occur outside articles. The weights are learned from
labelled pages by logistic regression, from prior weights for common names, so that pages of
other makes work as well. One linear scan finds the contiguous run with the largest sum;
the words in it that score above 0 are given back block by block.

Evidence is weighed, no name alone empties a page: where marked articles hold little of
the page they are teasers, and what stands beside them is not held outside; a compound name with a word of the subject
(share-price) speaks against nothing in a marked article; what <html> and <body> are called counts
for nothing, and classes and ids of elements that hold most of the page's words outside links speak
against them the less the more they hold. A part that is left out costs the run no more than PART, and nothing inside a
marked article, so that an interruption does not cut off the rest.

Labelled pages are those that mark their article themselves: text inside is content, text outside is not,
and parts of an article that prior weights call none of it are not learned from.
Each is learned twice, as it is and with its marks hidden.

Edge cases: null and empty html, and pages without a positive word, give "". Broken
markup (unclosed tags, stray "<", a cut-off end) is read as far as it makes sense.
Nesting and attributes may be of any length. Pages are read whole. Repeated rows give the same text each; columns other than id,
url and html are not read, and a clashing name is no matter. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._common import drop, stage, unit_hash

TRAIN_PAGES = 1500
PART = 8.0
FULL = 0.25
MIN_PAGES, MOST_NAMES = 5, 4000  # a name is learned if that many pages have it; the most frequent names are
MOST = 3.0  # of what speaks for an element, so that one sure sign against it decides

# Names of HTML, and words that page makers use for parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object textarea title head select canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html"}
MARKS = frozenset({"article", "main"})
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 a abbr b blockquote br cite code dd dt em font i img li mark pre q s small span strong sub sup td th tr u".split())
OUTSIDE_TAGS = "nav aside footer form button dialog menu label header".split()
OUTSIDE = "ad ads advert adverts advertisement advertising aside banner banners breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination pager popup promo promoted recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar tags widget alert".split()
INSIDE = "article main content post entry story text body".split()
# words that with others name a part of a page and nothing else, as in share-buttons or ad-slot-3
FRAME = frozenset("area bar block blocks box button buttons col column container cta entry form icon icons inner item items js link links list module outer panel post posts row section site slot story unit wrap wrapper".split())
STORY = frozenset("article post entry story".split())
NEGATORS = frozenset("no not has have with without is are hide hidden show toggle after before".split())

_PART_WORDS = FRAME | set(OUTSIDE) | set(INSIDE)
_OF_STORY = {c + w for c in ".~?" for w in STORY}
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_END = re.compile(r"""(?>[^>"'=]+|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+>""")
_ATTR = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


def tokenize(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, tag) and ("close", name, "") in page order; raw elements are left out whole."""
    at, n = 0, len(page)
    low = page.lower()
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _NAME.match(page, lt)
        if not m:
            yield "text", "<", ""
            at = lt + 1
            continue
        end = _END.match(page, m.end())
        gt = end.end() - 1 if end else -1
        if gt < 0:
            return  # a tag that the end of the page cuts off
        name, at = m[1].lower(), gt + 1
        if page[lt + 1] == "/":
            yield "close", name, ""
        elif name in RAW and page[gt - 1] != "/":
            if name == "head":
                # the head ends with its end tag, or where the body begins
                ends = [e for e in (low.find("</head", at), low.find("<body", at)) if e >= 0]
                at = min(ends, default=at)
            else:
                end = low.find("</" + name, at)
                at = n if end < 0 else end
        else:
            yield "open", name, page[lt:gt]


def surroundings(name: str, tag: str) -> frozenset[str]:
    """Names by which an element is known: <its own, .words of its class, id and role, and parts of compound words.

    A part is ~named where all parts of the word are names of page parts (share-buttons), ?named where one may be of the
    subject (share-price). The header of a post is not that of the page.
    """
    out = {"<" + name}
    if "=" in tag and name not in TEXT and name not in ("html", "body"):
        for m in _ATTR.finditer(tag):
            for word in (m[2] or m[3] or m[4] or "").split():
                parts = [x.lower() for x in _PARTS.split(word) if x]
                out.add("." + word.lower())
                if len(parts) > 1 and parts[0] not in NEGATORS:
                    known = all(x in _PART_WORDS or x.isdigit() for x in parts)
                    own = STORY & set(parts)
                    out.update(("~" if known else "?") + x for x in parts if not (own and x == "header"))
    return frozenset(out)


class Page:
    """Tokens of a page, and its elements, each behind the one around it.

    tokens: (kind, text or name, number of the element around). Of an element: `above`, the number of the one around;
    `own`, its names; `mark`, the innermost marked article (<article> or <main>) at or around it, or -1; `words` in it that are in no link.

    faith: how far the marks say where the article is, 0 to 1. Teasers are often marked as articles too; where the largest
    marked element holds less than FULL of what may be the page's text, an eighth say, its marks prove nothing, and below that they are signs of teasers.
    """

    def __init__(self, page: str):
        self.tokens: list[tuple[str, str, int]] = []
        self.above, self.own, self.mark, self.words = [-1], [frozenset()], [-1], [0]
        story = [False]  # is it in an element that is called a story?
        stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]  # name, number, places of the nearest block and the nearest list or item
        places: dict[str, list[int]] = {}  # of the open elements of each name

        def cut(k: int) -> None:
            for e in stack[k:]:
                places[e[0]].pop()
            del stack[k:]

        for kind, what, tag in tokenize(page):
            if kind == "text":
                if what:
                    self.tokens.append(("text", what, stack[-1][1]))
                    if not places.get("a"):
                        self.words[stack[-1][1]] += len(what.split())
                continue
            if kind == "open":
                if what in CLOSES_P and stack[k := stack[-1][2]][0] == "p":
                    cut(k)
                if what == "li" and stack[k := stack[-1][3]][0] == "li":
                    cut(k)
                if what not in VOID:
                    _, up, block, item = stack[-1]
                    own, number, at = surroundings(what, tag), len(self.above), len(stack)
                    if what == "header" and (self.mark[up] >= 0 or story[up]):
                        own = own - {"<header"}  # of an article, not of the page
                    story.append(story[up] or not own.isdisjoint(_OF_STORY))
                    self.above.append(up)
                    self.own.append(own)
                    self.mark.append(number if what in MARKS else self.mark[up])
                    self.words.append(0)
                    places.setdefault(what, []).append(at)
                    stack.append((what, number, at if what in BLOCK else block, at if what in ("li", "ul", "ol", "menu") else item))
            elif places.get(what):
                cut(places[what][-1])
            self.tokens.append((kind, what, stack[-1][1]))
        left_out, beside = [False], self.words[0]
        for i in range(1, len(self.above)):
            left_out.append(left_out[self.above[i]] or excluded(self.own[i]))
            if self.mark[i] < 0 and not left_out[i]:
                beside += self.words[i]
        for i in range(len(self.above) - 1, 0, -1):
            self.words[self.above[i]] += self.words[i]
        most = max((self.words[i] for i in range(1, len(self.above)) if self.mark[i] == i and self.mark[self.above[i]] < 0), default=0)
        self.faith = min(1.0, most / (FULL * (most + beside))) if most else 1.0
        self.marked = any(self.mark[e] >= 0 and k == "text" and t.strip() for k, t, e in self.tokens)

    def names(self, hidden: bool = False) -> list[frozenset[str]]:
        """Names around the content of each element; with marks hidden, of pages that mark nothing."""
        out: list[frozenset[str]] = []
        outside = frozenset({"!outside"}) if self.marked and not hidden else frozenset()
        for number, (up, own, mark) in enumerate(zip(self.above, self.own, self.mark, strict=True)):
            if hidden:
                own = frozenset("<div" if x[1:] in MARKS else x for x in own if x[0] != "." or x[1:] not in MARKS)
            around = out[up] if number else outside
            if number == mark:
                around = around - outside
            out.append(around if own <= around else around | own)
        return out


def excluded(names) -> bool:
    """Do prior weights alone call it no content?"""
    return any(PRIOR.get(x, 0.0) <= -3 and x[0] != "?" for x in names)


PRIOR = {"<" + t: -6.0 for t in OUTSIDE_TAGS} | {"." + w: -6.0 for w in OUTSIDE} | {"~" + w: -3.0 for w in OUTSIDE} | {"?" + w: -3.0 for w in OUTSIDE} | {"." + w: 1.0 for w in INSIDE}
PRIOR |= {"<article": 3.0, "<main": 3.0, "!outside": -6.0, "<p": 1.0, "<a": -1.0, "<li": -0.5, "<ul": -0.5, "<h1": 0.5, "<h2": 0.5, "<h3": 0.5, "<blockquote": 0.5, "<pre": 0.5}


class Weights:
    """Weights of names around a word, and costs of tags."""

    def __init__(self, around: dict[str, float] | None = None, tags: dict[str, float] | None = None, bias: float = 0.25):
        self.around, self.tags, self.bias = dict(PRIOR) | (around or {}), tags or {}, bias

    def cost(self, tag: str) -> float:
        return self.tags.get(tag, 0.5 if tag in ("a", "li", "ul", "button", "input", "option") else 0.1)

    @classmethod
    def fit(cls, seen: dict[tuple[tuple[str, ...], int], int], tags: dict[tuple[str, int], int], rounds: int = 400, strength: float = 2e-4) -> Weights:
        """Logistic regression on (names, is it content?) -> words, drawn towards the prior weights; costs from (tag, inside?) -> times."""
        if not seen:
            return cls()
        names = sorted({x for k, _ in seen for x in k})
        at = {x: i for i, x in enumerate(names)}
        rows = list(seen)
        # the names of each row one after another, the bias last: as many numbers as there are names in sets, not sets times names
        flat = np.array([j for k, _ in rows for j in (*(at[x] for x in k), len(names))], np.int64)
        size = np.array([len(k) + 1 for k, _ in rows], np.int64)
        first = np.cumsum(size) - size
        back = lambda r: np.bincount(flat, np.repeat(r, size), len(names) + 1)
        y, n = np.array([c for _, c in rows], float), np.array([seen[r] for r in rows], float)
        n = n / n.sum()
        prior = np.array([PRIOR.get(x, 0.0) for x in names] + [0.25])
        w = prior.copy()
        rate = 1 / (0.25 * back(n * size) + strength)  # no weight's step exceeds its curvature, so every round goes down
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.add.reduceat(w[flat], first)))
            w -= rate * (back(n * (p - y)) + strength * (w - prior))
        ratio = {t: (tags.get((t, 0), 0) + 1) / (tags.get((t, 1), 0) + 1) for t, _ in tags}
        return cls(dict(zip(names, w[:-1].tolist(), strict=True)), {t: min(1.0, max(0.05, 0.25 + 0.25 * math.log(r))) for t, r in ratio.items()}, float(w[-1]))

    def scores(self, page: Page) -> list[float]:
        """Score of a word in each element."""
        total = max(page.words[0], 1)
        out, sums, around = [], [], page.names()
        for number, (up, own, mark) in enumerate(zip(page.above, page.own, page.mark, strict=True)):
            before = around[up] if number else frozenset()
            plus, minus = sums[up] if number else (max(self.bias, 0.0), min(self.bias, 0.0))
            trusted = mark >= 0 and page.faith >= 0.5
            for x in own - before:
                w = self.around.get(x, 0.0)
                if trusted and w < 0 and x[0] == "?":
                    continue  # inside a marked article a word that may be of the subject is no evidence
                if w > 0:
                    plus += w
                else:
                    minus += w * (1.0 if x[0] == "<" else min(1.0, 2 - 2 * page.words[number] / total))
            sums.append((plus, minus))
            doubt = 0.0
            if page.marked:
                doubt = self.around["!outside"] * max(0.0, 2 * page.faith - 1 if "!outside" in around[number] else 1 - 2 * page.faith)
            out.append(max(-2.0, min(1.0, min(plus, MOST) + minus + doubt)))
        return out


def statistics(page: str, seen: Counter, tags: Counter, known: frozenset[str] | None = None) -> None:
    """Count a labelled page, by the names in `known` if given; pages without a marked article, or marked in teasers only, are not labelled."""
    p = Page(page)
    if not p.marked or p.faith < 1:
        return
    for hidden in (False, True):
        around = p.names(hidden)
        memo: dict[int, tuple] = {}
        for kind, what, e in p.tokens:
            inside = int(p.mark[e] >= 0)
            if kind == "text" and (n := len(what.split())):
                if e not in memo:
                    memo[e] = tuple(sorted(around[e] if known is None else around[e] & known))
                if not (inside and excluded(around[e])):
                    seen[memo[e], inside] += n
            elif kind == "open" and not hidden:
                tags[what, inside] += 1


def extract(page: str | None, weights: Weights) -> str:
    """The text of the best contiguous region."""
    if not page:
        return ""
    p = Page(page)
    score = weights.scores(p)
    # the outermost element that is left out, for each element in one
    part: list[int] = []
    for e, s in enumerate(score):
        up = part[p.above[e]] if e else -1
        part.append((up if up >= 0 else e) if s <= 0 else -1)
    best, best_at, total, start, spent = 0.0, (0, 0), 0.0, 0, Counter()
    for i, (kind, what, e) in enumerate(p.tokens):
        if kind == "text":
            s = score[e] * len(what.split())
            if s < 0:
                s = 0.0 if p.mark[e] >= 0 else max(s, spent[part[e]] - PART)
                spent[part[e]] -= s
        else:
            # a tag of a marked article costs nothing, or a row of them would cut off what follows; nor does one of a part that is left out
            s = -weights.cost(what) if kind == "open" and p.mark[e] < 0 and part[e] < 0 else 0.0
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, best_at = total, (start, i + 1)
    blocks, line = [], []

    def close():
        text = _SPACE.sub(" ", "".join(line)).strip()
        if text:
            blocks.append(text)
        line.clear()

    for kind, what, e in p.tokens[best_at[0] : best_at[1]]:
        if kind == "text":
            if score[e] > 0:
                line.append(html.unescape(what))
        elif what in BLOCK:
            close()
        elif what in ("br", "td", "th", "img"):
            line.append(" ")
    close()
    return "\n\n".join(blocks)


def _statistics_fn(known: frozenset[str]):
    def run(it):
        for batch in it:
            seen, tags = Counter(), Counter()
            for page in batch.column(0).to_pylist():
                statistics(page, seen, tags, known)
            rows = [("\n".join(k), c, n) for (k, c), n in seen.items()] + [("\t" + t, c, n) for (t, c), n in tags.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64()))], ["names", "inside", "n"])

    return run


def _names_fn(it):
    """The names on each page, once a page."""
    for batch in it:
        pages = (Page(p) for p in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([x for p in pages if p.marked for x in frozenset().union(*p.own)], pa.string())], ["name"])


def train(pages: DataFrame, id_col="page_id", html_col="html", limit: int = TRAIN_PAGES) -> Weights:
    """Learn from about `limit` labelled pages drawn by id.

    Names that fewer than MIN_PAGES of them have, or a twentieth of fewer than 100 (ids of single elements, hashed classes) are not told apart, and of the
    others the MOST_NAMES on most pages count, besides those with prior weights; only counts by sets of these reach the driver.
    """
    labelled = pages.where(F.col(html_col).rlike(r"(?i)<(article|main)[\s>]") & F.col(id_col).isNotNull())
    n = labelled.count()
    sample = stage(labelled.where(unit_hash(F.col(id_col)) < F.lit(1.15 * limit / max(n, 1))).select(html_col))
    times = sample.mapInArrow(_names_fn, "name string").groupBy("name").count().where(F.col("count") >= min(MIN_PAGES, max(1, n // 20)))
    top = times.orderBy(F.desc("count"), "name").limit(MOST_NAMES).collect()
    known = frozenset(PRIOR) | {r["name"] for r in top}
    got: pd.DataFrame = sample.mapInArrow(_statistics_fn(known), "names string, inside int, n long").groupBy("names", "inside").agg(F.sum("n").alias("n")).toPandas()
    drop(sample)
    seen, tags = {}, {}
    for names, inside, count in sorted(zip(got["names"], got["inside"], got["n"], strict=True)):
        if names.startswith("\t"):
            tags[names[1:], inside] = count
        else:
            seen[tuple(x for x in names.split("\n") if x), inside] = count
    return Weights.fit(seen, tags)


def extract_pages(pages: DataFrame, weights: Weights, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """id, url, text and n_chars of every page."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(it):
        for batch in it:
            text = [extract(p, weights) for p in batch.column(2).to_pylist()]
            cols = [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "url", "text", "n_chars"])

    out = pages.select(id_col, url_col, html_col).mapInArrow(run, f"id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
    return out.toDF(id_col, url_col, "text", "n_chars")


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract_pages(pages, train(pages))
