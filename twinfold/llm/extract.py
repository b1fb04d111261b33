"""Main text of web pages as a maximum-scoring run of tokens.

A page becomes a sequence of words and tags. Words score positive, tags negative; a word
also scores for each element that holds it, by the element's name and by the words of its
class, id and role, and for being part of a link or of a short bare line. An element
whose tokens add up to less than the price of a cut is worth leaving out: it becomes one
token that costs that price. One linear scan over what is left finds the contiguous run of
highest total score, which is widened to whole blocks and read out. The scan also looks
inside each element before it is cut, so the best run of any level wins.

All weights come from labelled pages (``labelled_pages``: pages of many layouts made
here, with each piece marked as article or not) by a structured perceptron: where the
best run differs from the labelled one, weights move by the difference of their
feature counts. Elements are only ever left out for their score: a class name decides
nothing by itself, and an element that holds most words of a page has weights of its own.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: The rest of a tag: values in quotes may hold anything, a bare "<" ends the attempt, so broken markup stays linear.
_REST = r"(?:[^>=<]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|textarea|svg|math|object|select|xmp|noframes)(?=[\s/>])" + _REST + r">.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][^\s/><]*+)(?P<attrs>" + _REST + r")>"
    r"|<[!?/][^>]*+>"
    r"|(?P<text>[^<]++|<)",
    re.IGNORECASE | re.DOTALL,
)
ATTR = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)

# Element names of HTML by their use.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose class names speak of the whole page.
WHOLE = frozenset("html body".split())
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

Weights = dict[str, float]
START: Weights = {"word": 1.0, "link": -1.5, "block_tag": -0.3, "inline_tag": -0.1, "link_tag": -0.2, "cut": -1.0}
#: What keeps its sign in training: words gain, tags and cuts cost.
RANGE = {"word": (0.5, 2.0), "block_tag": (-2.0, -0.05), "inline_tag": (-1.0, -0.01), "link_tag": (-1.0, -0.05), "cut": (-3.0, -0.3)}
SHORT = 12


def marks(tag: str, attrs: str) -> list[str]:
    """What is known of an element: its name, and the words of its class, id and role names; of a name of several words the first and the last."""
    out = [f"<{tag}>"]
    if not attrs or tag in WHOLE:
        return out
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE)):
            out.append("hidden")
        elif name in ("class", "id", "role"):
            for word in value.split():
                pieces = [x.lower() for x in PIECE.findall(word)]
                if pieces:
                    out.append(pieces[-1])
                    if len(pieces) > 1:
                        out.append(f"{pieces[0]}-")
    return list(dict.fromkeys(out))


class Element:
    __slots__ = ("above", "known", "most", "tag", "words")

    def __init__(self, tag: str, above: int, known: list[str]):
        self.tag, self.above, self.known, self.words, self.most = tag, above, known, 0, False

    def names(self) -> list[str]:
        """The features that each word inside has by this element."""
        return [self.known[0], *(f"most {k}" for k in self.known[1:])] if self.most else self.known


class Page:
    """Tokens of a page in order, each with the element that holds it, and its elements.

    kind: 0 words, 1 the tag that opens an element, 2 the tag that closes it, 3 any other tag.
    """

    def __init__(self, source: str):
        self.kind: list[int] = []
        self.n: list[int] = []
        self.text: list[str] = []
        self.at: list[int] = []
        self.own: list[int] = []  # of words: the element around them; of tags: their element
        self.extra: list[tuple[str, ...]] = []
        self.elements = [Element("", -1, [])]
        stack = [0]
        names: list[str] = []
        opened: Counter[str] = Counter()
        for m in TOKEN.finditer(source):
            text, tag = m["text"], m["tag"]
            if text is not None:
                text = html.unescape(text)
                n = len(text.split())
                extra = ("link",) if opened["a"] else ()
                if n and n < SHORT and names and not any(t in HEADINGS for t in names[-2:]) and names[-1] not in ("p", "li", "blockquote", "pre", "td", "th", "dd", "dt", "figcaption"):
                    extra += ("short",)
                if "©" in text:
                    extra += ("©",)
                self._add(0, n, text, m.start(), stack[-1], extra)
                self.elements[stack[-1]].words += n
            elif tag is not None:
                tag = tag.lower()
                if m["close"]:
                    if opened[tag]:
                        while self._close(stack, names, opened, m.start()) != tag:
                            pass
                    continue
                drop = CLOSES.get(tag, frozenset(["p"]) if tag in BLOCK and tag != "br" else frozenset())
                while names and names[-1] in drop:
                    self._close(stack, names, opened, m.start())
                if tag in VOID:
                    self.elements.append(Element(tag, stack[-1], []))
                    self._add(3, 0, "", m.start(), len(self.elements) - 1, ())
                    continue
                self.elements.append(Element(tag, stack[-1], marks(tag, m["attrs"])))
                stack.append(len(self.elements) - 1)
                names.append(tag)
                opened[tag] += 1
                self._add(1, 0, "", m.start(), stack[-1], ())
        while names:
            self._close(stack, names, opened, len(source))
        whole = self.elements[0].words
        for e in self.elements:
            e.most = 2 * e.words > whole

    def _add(self, kind: int, n: int, text: str, at: int, own: int, extra: tuple[str, ...]) -> None:
        self.kind.append(kind)
        self.n.append(n)
        self.text.append(text)
        self.at.append(at)
        self.own.append(own)
        self.extra.append(extra)

    def _close(self, stack: list[int], names: list[str], opened: Counter[str], at: int) -> str:
        tag = names.pop()
        opened[tag] -= 1
        e = stack.pop()
        self.elements[stack[-1]].words += self.elements[e].words
        self._add(2, 0, "", at, e, ())
        return tag

    def breaks(self, i: int) -> bool:
        """Whether a token is a tag that parts blocks."""
        return self.kind[i] > 0 and self.elements[self.own[i]].tag in BLOCK

    def tag_feature(self, i: int) -> str:
        tag = self.elements[self.own[i]].tag
        return "block_tag" if tag in BLOCK else "link_tag" if tag == "a" else "inline_tag"

    def scores(self, weights: Weights) -> list[float]:
        """The score of each token."""
        inside = [0.0] * len(self.elements)
        for k, e in enumerate(self.elements):
            if k:
                inside[k] = inside[e.above] + sum(weights.get(f, 0.0) for f in e.names())
        word = weights["word"]
        return [
            n * (word + inside[own] + sum(weights.get(f, 0.0) for f in extra)) if not kind else weights[self.tag_feature(i)]
            for i, (kind, n, own, extra) in enumerate(zip(self.kind, self.n, self.own, self.extra, strict=True))
        ]

    def cut(self, scores: list[float], price: float, wanted: Callable[[int, float], bool], found: Callable[[list[int], list[float]], None] | None = None) -> tuple[list[int], list[float]]:
        """What is left, and its scores, when the elements that are not wanted, by number and score, are cut out; entry ~k is the cut of element k.

        Each part is passed to found before it is cut.
        """
        left: list[int] = []
        value: list[float] = []
        open_: list[tuple[int, float]] = []  # where an element's part begins, and the score of what came before it in the element around it
        total = 0.0
        for i, kind in enumerate(self.kind):
            if kind == 1:
                open_.append((len(left), total))
                total = 0.0
            left.append(i)
            value.append(scores[i])
            total += scores[i]
            if kind == 2:
                at, before = open_.pop()
                e = self.own[i]
                if self.elements[e].words and not wanted(e, total):
                    if found:
                        found(left[at:], value[at:])
                    del left[at:], value[at:]
                    left.append(~e)
                    value.append(price)
                    total = price
                total += before
        return left, value

    def best(self, weights: Weights, more: list[float] | None = None) -> list[int]:
        """The entries of the best run, widened to whole blocks; none if no run scores more than 0. more is added to the tokens' scores."""
        price, top = weights["cut"], (0.0, [])
        scores = self.scores(weights)
        if more:
            scores = [a + b for a, b in zip(scores, more, strict=True)]

        def look(left: list[int], value: list[float]) -> None:
            nonlocal top
            score, a, b = best_run(value)
            if score > top[0]:
                top = (score, self.widen(left, a, b))

        def wanted(e: int, total: float) -> bool:
            element = self.elements[e]
            return total >= price or (element.tag not in BLOCK and sum(weights.get(f, 0.0) for f in element.names()) >= weights.get("<" + element.tag + ">", 0.0))

        look(*self.cut(scores, price, wanted, look))
        return top[1]

    def widen(self, left: list[int], a: int, b: int) -> list[int]:
        """The entries a to b and the rest of the blocks that they begin and end in."""
        parts = lambda i: i < 0 or self.breaks(i)
        while a > 0 and not parts(left[a]) and not parts(left[a - 1]):
            a -= 1
        while b < len(left) and not parts(left[b - 1]) and not parts(left[b]):
            b += 1
        return left[a:b]

    def read(self, run: list[int]) -> str:
        """Text of a run: white space in blocks collapsed, blocks joined by a space."""
        out: list[str] = []
        for i in run:
            if i >= 0 and not self.kind[i]:
                out.append(self.text[i])
            elif i < 0 or self.breaks(i):
                out.append(" ")
        return " ".join("".join(out).split())

    def counts(self, run: list[int]) -> Counter[str]:
        """How often each feature occurs in a run."""
        out: Counter[str] = Counter()
        for i in run:
            if i < 0:
                out["cut"] += 1
            elif self.kind[i]:
                out[self.tag_feature(i)] += 1
            elif self.n[i]:
                out["word"] += self.n[i]
                for f in self.extra[i]:
                    out[f] += self.n[i]
                e = self.own[i]
                while e > 0:
                    for f in self.elements[e].names():
                        out[f] += self.n[i]
                    e = self.elements[e].above
        return out

    def labelled(self, article: Callable[[int], bool]) -> list[int]:
        """The run of a page whose words are known to belong to its article or not."""
        some = [0] * len(self.elements)
        ours = [not k and n > 0 and article(at) for k, n, at in zip(self.kind, self.n, self.at, strict=True)]
        for i, mine in enumerate(ours):
            e = self.own[i]
            while mine and e > 0 and not some[e]:
                some[e] = 1
                e = self.elements[e].above
        left, _ = self.cut([0.0] * len(self.kind), 0.0, lambda e, _: bool(some[e]))
        inside = [k for k, i in enumerate(left) if i >= 0 and ours[i]]
        return self.widen(left, inside[0], inside[-1] + 1) if inside else []


def best_run(value: list[float]) -> tuple[float, int, int]:
    """Score, start and end of the run of highest sum; the earliest and then the shortest of equal ones; (0, 0, 0) if none is positive."""
    best, total, start = (0.0, 0, 0), 0.0, 0
    for i, x in enumerate(value):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best[0]:
            best = (total, start, i + 1)
    return best


# What authors of pages call parts that are no article, parts of names beside these words, and names of what holds an article.
BOILERPLATE = """ad ads adbox advert adverts advertisement adsense banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent
copyright disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager
pagination popup promo promoted promotion related recommended respond replies reviews sharing share sidebar signup skip social sponsor sponsored
subscribe subscription teaser toolbar topbar widget widgets contentinfo complementary search alert header""".split()
AROUND = "box area wrapper container list bar block section inner left right top bottom links item items panel form thread text holder unit slot".split()
BEFORE = "site page main global left right top bottom my the cookie post article primary secondary".split()
CONTENT = "content article post entry story main body text page wrapper container layout prose hentry single".split()
HARMLESS = ["has-{}", "no-{}", "with-{}", "without-{}", "{}-free", "{}-less", "hide-{}", "{}-science", "{}-policy", "{}-history", "{}-results", "{}-studies", "{}-industry", "{}-law", "layout-{}", "is-{}"]


class _Maker:
    """Pages of varied layouts, in pieces that are article or not."""

    def __init__(self, seed: int):
        self.rnd = random.Random(seed)
        self.vocabulary = ["".join(self.rnd.choice("aeioulnrstdmk") for _ in range(self.rnd.randrange(2, 9))) for _ in range(400)]

    def say(self, a: int, b: int) -> str:
        return " ".join(self.rnd.choice(self.vocabulary) for _ in range(self.rnd.randrange(a, b)))

    def link(self, a: int = 1, b: int = 4) -> str:
        return f'<a href="/{self.rnd.choice(self.vocabulary)}">{self.say(a, b)}</a>'

    def links(self) -> str:
        n = self.rnd.randrange(2, 12)
        kind = self.rnd.randrange(3)
        if kind == 0:
            return "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(n)) + "</ul>"
        return " | ".join(self.link() for _ in range(n)) if kind == 1 else "".join(f"<div>{self.link()}</div>" for _ in range(n))

    def prose(self, a: int = 3, b: int = 60) -> str:
        return "".join(f"<p>{self.say(a, b)}</p>" for _ in range(self.rnd.randrange(1, 4))) if self.rnd.random() < 0.6 else self.say(a, b)

    def name(self, word: str) -> str:
        """A class name that means what the word says."""
        joint = self.rnd.choice("-_")
        form = self.rnd.randrange(4)
        return word if form < 2 else f"{word}{joint}{self.rnd.choice(AROUND)}" if form == 2 else f"{self.rnd.choice(BEFORE)}{joint}{word}"

    def aside(self) -> str:
        """A part that is no article."""
        rnd = self.rnd
        kind = rnd.randrange(10)
        inner = rnd.choice([self.links, self.prose, lambda: f"<h3>{self.say(1, 4)}</h3>{self.links()}", lambda: f"<h3>{self.say(1, 4)}</h3>{self.prose()}"])
        if kind < 2:
            tag = rnd.choice(["nav", "footer", "aside", "header", "menu", "dialog"])
            return f"<{tag}>{inner()}</{tag}>"
        if kind == 2:
            return f'<form action="/s"><label>{self.say(1, 4)}</label><input name="q"><p>{self.say(1, 20)}</p><button>{self.say(1, 3)}</button></form>'
        if kind == 3:
            hide = rnd.choice(["hidden", 'style="display:none"', 'aria-hidden="true"'])
            return f"<div {hide}>{inner()}</div>"
        if kind == 4:
            return self.talk()
        if kind == 5:
            return f"<div>{self.links()}</div>"
        word = self.name(rnd.choice(BOILERPLATE))
        attr = rnd.choice(["class", "class", "id", "role"])
        more = f" {rnd.choice(self.vocabulary)}" if attr == "class" and rnd.random() < 0.3 else ""
        tag = rnd.choice(["div", "div", "section", "aside", "ul", "span"])
        return f'<{tag} {attr}="{word}{more}">{inner() if tag != "ul" else "".join(f"<li>{self.say(1, 12)}</li>" for _ in range(3))}</{tag}>'

    def talk(self) -> str:
        """Reader comments, at times longer than the article."""
        rnd = self.rnd
        one = rnd.choice(["<div><b>{}</b><p>{}</p></div>", "<article><h4>{}</h4><p>{}</p></article>", '<li class="comment"><cite>{}</cite><p>{}</p></li>', '<div class="comment-body"><p>{}</p><p>{}</p></div>'])
        many = "".join(one.format(self.say(1, 3), self.say(3, 60)) for _ in range(rnd.choice([1, 3, 6, 15])))
        return f'<section {rnd.choice(["class", "id"])}="{rnd.choice(["comments", "comment-list", "comments-area", "replies", "respond", "disqus_thread", "commentlist", "reviews"])}"><h3>{self.say(1, 3)}</h3>{many}</section>'

    def article(self) -> Iterator[tuple[str, bool]]:
        rnd = self.rnd
        if rnd.random() < 0.8:
            title = f"<h1>{self.say(2, 9)}</h1>"
            yield (f"<header>{title}<p>{self.say(2, 6)}</p></header>", False) if rnd.random() < 0.2 else (title, True)
        for _ in range(rnd.choice([1, 1, 2, 4, 9])):
            p = self.say(1, 90) if rnd.random() < 0.8 else self.say(1, 6)
            if rnd.random() < 0.3:
                p = f"{self.link()} {p} <b>{self.say(1, 3)}</b> {self.link(2, 9)}, {self.say(2, 9)}"
            form = rnd.random()
            if form < 0.7:
                yield f"<p>{p}</p>", True
            elif form < 0.95:
                yield rnd.choice([f"<blockquote><p>{p}</p></blockquote>", f"<ul><li>{p}</li><li>{self.say(1, 20)}</li></ul>", f"<h2>{self.say(1, 6)}</h2><p>{p}</p>", f"<table><tr><td>{self.say(1, 4)}</td><td>{p}</td></tr></table>", f"<pre>{p}</pre>", f"<figure><img src=x><figcaption>{self.say(2, 12)}</figcaption></figure>", f"<div><p>{p}</p></div>"]), True
            else:
                yield f"<div>{self.say(14, 80)}</div>", True
            if rnd.random() < 0.15:
                yield self.aside(), False

    def page(self) -> list[tuple[str, bool]]:
        rnd = self.rnd
        out = [(f"<!DOCTYPE html><html><head><title>{self.say(2, 20)}</title><script>var a='<p>';</script></head><body{rnd.choice(['', ' class=\"home has-sidebar\"'])}>", False)]
        deep = rnd.choice([0, 1, 1, 2, 3])
        for _ in range(rnd.randrange(0, 3)):
            out.append((self.aside(), False))
        ends = []
        for k in range(deep):
            tag = rnd.choice(["div", "div", "section", "main", "article"])
            kinds = ["", f' class="{rnd.choice(CONTENT)}"', f' id="{rnd.choice(CONTENT)}-{rnd.choice(AROUND)}"', f' class="{rnd.choice(CONTENT)} {rnd.choice(HARMLESS).format(rnd.choice(BOILERPLATE))}"', f' class="{rnd.choice(HARMLESS).format(rnd.choice(BOILERPLATE))}"']
            out.append((f"<{tag}{rnd.choice(kinds)}>", False))
            ends.append(f"</{tag}>")
            if k < deep - 1 and rnd.random() < 0.3:
                out.append((self.aside(), False))
        if rnd.random() < 0.1:  # columns made by a table
            out.append((f"<table><tr><td>{self.links()}</td><td>", False))
            ends.append("</td></tr></table>")
        out += list(self.article())
        while ends:
            out.append((ends.pop(), False))
            if rnd.random() < 0.4:
                out.append((self.aside(), False))
        if rnd.random() < 0.5:
            out.append((self.talk(), False))
        for _ in range(rnd.randrange(0, 2)):
            out.append((self.aside(), False))
        mark = rnd.choice(["", "©"])
        out.append((rnd.choice([f"<footer>{mark} {self.say(3, 20)} {self.link()}</footer>", f'<div class="footer">{self.link()} {self.link()}</div>', f"<div>{mark or '©'} {self.say(1, 9)}</div>", ""]) + "</body></html>", False))
        return out


def labelled_pages(n: int = 2000, seed: int = 11) -> list[list[tuple[str, bool]]]:
    """Pages of varied layouts in pieces: (html, whether it belongs to the article)."""
    maker = _Maker(seed)
    return [maker.page() for _ in range(n)]


def label(pieces: list[tuple[str, bool]]) -> tuple[Page, list[int]]:
    """A labelled page and the run that its labels stand for."""
    ends, mine, at = [], [], 0
    for part, ours in pieces:
        at += len(part)
        ends.append(at)
        mine.append(ours)
    page = Page("".join(p for p, _ in pieces))
    return page, page.labelled(lambda x: mine[bisect_right(ends, x)] if x < at else False)


@cache
def learned_weights(rounds: int = 14, rate: float = 0.15, margin: float = 0.3) -> Weights:
    """Averaged structured perceptron on the labelled pages. Some weights keep their signs; a word must be told from the other kind by the margin."""
    data = []
    for page, run in map(label, labelled_pages()):
        ours = {i for i in run if i >= 0}
        data.append((page, run, page.counts(run), [margin * n * (-1 if i in ours else 1) for i, n in enumerate(page.n)]))
    w, total, steps = dict(START), Counter(), 0
    wrong = [True] * len(data)
    for k in range(rounds):
        for i, (page, run, gold, more) in enumerate(data):
            if k % 3 and not wrong[i]:
                continue  # pages that were right are looked at again every third round
            got = page.best(w, more)
            wrong[i] = got != run
            if wrong[i]:
                mine = page.counts(got)
                move = {f: gold[f] - mine[f] for f in gold.keys() | mine.keys()}
                size = max(1, max(abs(x) for x in move.values()))
                for f, x in move.items():
                    lo, hi = RANGE.get(f, (-3.0, 3.0))
                    w[f] = min(hi, max(lo, w.get(f, 0.0) + rate * x / size))
            if k >= rounds // 2:
                steps += 1
                for f, x in w.items():
                    total[f] += x
    return {f: x / steps for f, x in total.items()}


def main_text(source: str | None, weights: Weights | None = None) -> str:
    """Main text of one page; empty for null, empty or text-free pages."""
    if not source:
        return ""
    page = Page(source)
    return page.read(page.best(weights or learned_weights()))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: (id, url, text, n_chars); n_chars counts code points.

    A narrow map: no shuffle, one page at a time, linear in its length. Null and empty
    pages give an empty text; repeated rows and null ids or urls are kept; other
    columns are ignored. An empty table gives an empty result.
    """
    prepare(pages.sparkSession)
    weights = learned_weights()
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([main_text(x.as_py(), weights) for x in b.column("html")], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("url"), text], names=["key", "url", "text"])

    rows = pages.select(F.col(id_col).alias("key"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    got = rows.mapInArrow(run, f"key {kind}, url string, text string")
    return got.select(F.col("key").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
