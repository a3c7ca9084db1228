"""Main text of web pages by equivalence-class template deduction.

Pages of a host share a template.  Each page is read as a stream of tokens: a tag with the
path of containers that leads to it, and a run of words between two tags with the path it
stands at.  A token's occurrence vector says how often each page of the host holds it.
Tokens with equal vectors form an equivalence class; vectors are compared by the sum over
pages of a 64-bit hash of (page, count), so pages that come more than once count as often
as they come.  The sum is kept in two halves that cannot overflow.  So classes come from one
aggregation with partial sums and no host's pages ever meet in one task.

Classes that occur on at least ``support`` of the host's pages are valid.  Their tags are ordered by
where they first stand and nested by the containers around them: a class lies in the slot of
the nearest tag of another class that encloses it, and tokens of one class under different
tags are roles of their own.  What stands in a tag and is no template itself fills its slot.
The template decides for the whole host:

* runs of words in the class of the page's root, that is on every page equally often, are
  template; containers that hold no other words are boilerplate unless they lie in the main
  slot (for hosts with ``least_pages`` different pages or more, as on fewer all text is constant);
* containers whose text is mostly links are menus;
* the main slot is found from the root inwards: into the nested tag that holds ``MAIN_SHARE`` of the
  varying plain text, as long as it occurs once a page (a class that repeats, such as the
  items of a list, fills the slot it lies in), then outwards again while the container around
  it holds only varying text besides, or is an article or main element.

Nothing in the main slot is dropped as template, whatever repeats there.  Slots that vary like
the article does (adverts, comments, notices) cannot be told by vectors; for those alone the
names decide: a class or id all of whose parts are listed and at least one of which marks
boilerplate.  Pages are read again with their host's template.

Defined results: null html counts as empty and has no text; pages without a host use a
template of their own; a page that lacks its template's main slot gives the text of its article or main
element, or else of its body outside boilerplate; a tag that is never closed is markup to the page's end; once
quotes in a tag do not pair up, tags of that page end at the next ``>``; containers more than ``DEPTH``
levels deep count for the one at that depth; repeated rows each get their own result; an empty table gives an empty table; pages are read whole, however long.
Only ``page_id``, ``url`` and ``html`` are read, so other columns may have any name.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthline.llm.common import Scratch, stored

# HTML element names by their role, and names that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "xmp")
CONTAINERS = frozenset("html head body nav header footer aside main article section div form ul ol table tr td th dl figure details dialog menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
SKIP_TAGS = frozenset("head nav footer aside form script style noscript template iframe svg button select option textarea input dialog menu title object embed canvas audio video".split())
SKIP_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside cookie cookies consent gdpr notice notices alert popup modal overlay "
    "ad ads advert adverts advertisement advertising adbox adsbox sponsor sponsored promo promotion banner newsletter subscribe subscription signup login "
    "share sharing social related recommended pagination pager comment comments commentlist respond replies disqus toolbar widget skip copyright".split()
)
# Parts that may stand beside such a word in a name without changing what it says.
NEUTRAL_NAMES = frozenset("site page main top bottom left right box list wrap wrapper container block section area post posts bar link links form inner outer item items unit slot text global content body primary secondary floating fixed sticky mobile desktop button buttons icon icons group row col field header head foot title label message msg".split())
OUTSIDE_NAMES = frozenset("header masthead topbar".split())
MAIN_TAGS = frozenset(("article", "main"))
MAIN_SHARE, NAMED_SHARE, LINK_SHARE = 0.6, 0.3, 0.6
#: Levels of containers that are told apart.
DEPTH = 64

_LETTER = re.compile(r"/?[A-Za-z]")
_PLAIN = re.compile(r"[^>\"']*")
_ATTR = re.compile(r"""([A-Za-z][\w:-]*)\s*(?:=\s*(?:"([^"]*)(?:"|$)|'([^']*)(?:'|$)|([^\s"'>]+)))?""")
_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_WORDS = re.compile(r"[a-z0-9]+")


def _attributes(tag: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(tag, _NAME.match(tag).end())}


class _Scanner:
    """Finds where markup ends; every character is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.quoted = page, True

    def _to(self, text: str, at: int) -> int:
        found = self.page.find(text, at)
        return len(self.page) if found < 0 else found + len(text)

    def end(self, at: int) -> int | None:
        """The place behind the markup that begins at a ``<``; None where it is text."""
        page = self.page
        if page.startswith("<!--", at):
            return self._to("-->", at + 4)
        if page.startswith("<![CDATA[", at):
            return self._to("]]>", at + 9)
        if page.startswith(("<!", "<?"), at):
            return self._to(">", at)
        if not _LETTER.match(page, at + 1):
            return None
        now = at + 1
        while self.quoted:
            now = _PLAIN.match(page, now).end()
            if now < len(page) and page[now] == ">":
                return now + 1
            close = page.find(page[now], now + 1) if now < len(page) else -1
            # Quotes that do not pair up are not trusted on the rest of the page.
            self.quoted = close >= 0
            now = close + 1
        return self._to(">", at)


def events(page: str):
    """``("open", name, attributes)``, ``("close", name, None)`` and ``("text", text, None)`` of a page."""
    at, n, scanner, text = 0, len(page), _Scanner(page), 0
    while at < n:
        start = page.find("<", at)
        stop = None if start < 0 else scanner.end(start)
        if start < 0:
            break
        if stop is None:
            at = start + 1
            continue
        if start > text:
            yield "text", page[text:start], None
        tag, at, text = page[start:stop], stop, stop
        named = _NAME.match(tag)
        if not named or not tag.endswith(">"):
            continue
        name = named[1].lower()
        if tag[1] == "/":
            yield "close", name, None
            continue
        yield "open", name, _attributes(tag)
        if name in RAW and not tag.endswith("/>"):
            end = re.compile(f"</{name}\\s*>", re.I).search(page, at)
            yield "close", name, None
            at = text = end.end() if end else n
    if text < n:
        yield "text", page[text:], None


def _mark(name: str, attributes: dict[str, str]) -> str:
    """A container's step in a path: its tag and the words of its class or id."""
    named = "" if name in MAIN_TAGS or name in ("html", "body", "head") else attributes.get("class") or attributes.get("id") or ""
    return name + ("." + ".".join(_WORDS.findall(named.lower())) if named else "")


def _says(name: str, marks: frozenset) -> bool:
    """Whether one of a class attribute's names says boilerplate: one of its parts does and no part says anything else."""
    for one in name.lower().split():
        parts = _WORDS.findall(one)
        if any(p in marks for p in parts) and all(p in marks or p in NEUTRAL_NAMES or p.isdigit() for p in parts):
            return True
    return False


def _boiler(name: str, attributes: dict[str, str], inside: bool) -> bool:
    if name in SKIP_TAGS or (name == "header" and not inside):
        return True
    if name in ("html", "body") or name in MAIN_TAGS:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", ""):
        return True
    if attributes.get("role") in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"):
        return True
    names = (attributes.get("class", ""), attributes.get("id", ""))
    return any(_says(n, SKIP_NAMES) for n in names) or (not inside and any(_says(n, OUTSIDE_NAMES) for n in names))


class _Walk:
    """The open containers while a page is read; a close tag ends what is open inside its element."""

    def __init__(self):
        #: Name, path, whether it is skipped, whether it lies in an article or the main slot, whether in the main slot.
        self.stack: list[tuple[str, str, bool, bool, bool]] = [("", "", False, False, False)]
        self.opened: dict[str, int] = defaultdict(int)

    @property
    def top(self):
        return self.stack[-1]

    def open(self, name: str, attributes: dict[str, str], skips=frozenset(), main=None) -> str:
        _, path, skip, inside, slot = self.top
        here = f"{path}/{_mark(name, attributes)}" if len(self.stack) <= DEPTH else path
        if name in CONTAINERS or name in SKIP_TAGS and name not in VOID:
            slot = slot or here == main
            inside = inside or slot or name in MAIN_TAGS
            self.stack.append((name, here, skip or _boiler(name, attributes, inside) or (here in skips and not inside), inside, slot))
            self.opened[name] += 1
        return here

    def close(self, name: str) -> None:
        while self.opened[name]:
            last = self.stack.pop()[0]
            self.opened[last] -= 1
            if last == name:
                return


def run_token(path: str, run: str) -> int | None:
    """The token of a run of words at a path; None where there is no word."""
    words = run.split()
    return int.from_bytes(blake2b(f"{path}\0{' '.join(words)}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) if words else None


def page_tokens(page: str) -> tuple[dict[str, list[int]], dict[tuple[str, int], list[int]], dict[str, list[int]]]:
    """Of one page: by tag token its count and first place, by path and run its count and plain characters, and by container its plain and linked characters and whether it is named boilerplate."""
    walk, tags, runs, held, links = _Walk(), {}, {}, {}, 0
    for at, (kind, name, attributes) in enumerate(events(page)):
        if kind == "text":
            _, path, skip, *_ = walk.top
            token = run_token(path, name)
            if token is not None:
                run = runs.setdefault((path, token), [0, 0])
                run[0] += 1
                run[1] += 0 if links else len(name)
                held.setdefault(path, [0, 0, int(skip)])[1 if links else 0] += len(name)
        elif kind == "open":
            tags.setdefault(walk.open(name, attributes), [0, at])[0] += 1
            _, path, skip, *_ = walk.top
            held.setdefault(path, [0, 0, int(skip)])
            links += name == "a"
        else:
            walk.close(name)
            links -= name == "a" and links > 0
    return tags, runs, held


@dataclass
class Tag:
    """A valid tag token of a host: its path, occurrence vector, and what its pages hold in it."""

    path: str
    vector: tuple[int, int]
    pages: int
    count: int
    place: float
    plain: int = 0
    linked: int = 0
    constant: int = 0
    boiler: bool = False

    @property
    def tag(self) -> str:
        return self.path.rsplit("/", 1)[-1].split(".")[0]


class Template:
    """The nested equivalence classes of a host.

    ``around`` gives the nearest valid tag that encloses each one, ``role`` the class it belongs to there: the outermost
    tag, in order of place, of those with its vector that hang together.
    """

    def __init__(self, tags: list[Tag]):
        self.tags = {t.path: t for t in sorted(tags, key=lambda t: (t.place, t.path.count("/"), t.path))}
        self.around: dict[str, str | None] = {}
        for path in self.tags:
            up = path
            while up:
                up = up.rpartition("/")[0]
                if up in self.tags:
                    break
            self.around[path] = up or None
        self.role: dict[str, str] = {}
        first: dict[tuple, str] = {}
        for path in sorted(self.tags, key=lambda p: p.count("/")):
            t, up = self.tags[path], self.around[path]
            if up is not None and self.tags[up].vector == t.vector:
                self.role[path] = self.role[up]
            else:
                self.role[path] = first.setdefault((t.vector, up), path)

    def classes(self) -> dict[str, tuple[str | None, list[str]]]:
        """By role: the tag whose slot the class lies in, and its tags in order of place."""
        out: dict[str, tuple[str | None, list[str]]] = {}
        for path in self.tags:
            out.setdefault(self.role[path], (self.around[self.role[path]], []))[1].append(path)
        return out

    def within(self, weight) -> dict[str, int]:
        """``weight`` of every tag with all that it encloses."""
        out = {p: weight(t) for p, t in self.tags.items()}
        for path in sorted(self.tags, key=lambda p: -p.count("/")):
            up = self.around[path]
            if up is not None:
                out[up] += out[path]
        return out

    def menus(self) -> list[str]:
        return [p for p, t in self.tags.items() if t.linked and t.linked >= LINK_SHARE * (t.linked + t.plain) and t.tag not in MAIN_TAGS]

    def main_slot(self) -> str | None:
        """The path of the tag whose slot holds the article."""
        closed = set(self.menus())
        open_ = lambda t: not t.boiler and t.path not in closed
        varying = self.within(lambda t: t.plain - t.constant if open_(t) else 0)
        constant = self.within(lambda t: t.constant if open_(t) else 0)
        total = max((varying[p] for p in varying if self.around[p] is None), default=0)
        if total <= 0:
            varying, constant = self.within(lambda t: t.plain if open_(t) else 0), dict.fromkeys(self.tags, 0)
            total = max((varying[p] for p in varying if self.around[p] is None), default=0)
        inner: dict[str | None, list[str]] = defaultdict(list)
        for path, up in self.around.items():
            inner[up].append(path)
        at, best = None, None
        while total > 0:
            best = max((p for p in inner[at] if self.tags[p].tag in CONTAINERS), key=lambda p: (varying[p], p), default=None)
            if best is None or varying[best] < MAIN_SHARE * total or self.tags[best].count > self.tags[best].pages:
                break
            at = best
        outer = lambda p: p is None or self.tags[p].tag in ("html", "body")
        if outer(at):
            named = [p for p, t in self.tags.items() if t.tag in MAIN_TAGS and total > 0 and varying[p] >= NAMED_SHARE * total]
            return min(named, key=lambda p: (p.count("/"), -varying[p], p), default=None)
        around = at
        while not outer(around):
            up = self.around[around]
            if self.tags[around].tag in MAIN_TAGS or (around != at and constant[around] == constant[at] and varying[around] > varying[at]):
                at = around
            around = up
        return at

    def boilerplate(self) -> list[str]:
        """Containers whose words are all template."""
        plain, constant = self.within(lambda t: t.plain + t.linked), self.within(lambda t: t.constant)
        return [p for p, t in self.tags.items() if t.tag in CONTAINERS and 0 < plain[p] == constant[p]]


def extract(page: str, main: str | None, skips=frozenset()) -> str:
    """The text of a page's main slot; without one, of its article or main element, or else of its body outside boilerplate."""
    walk, parts = _Walk(), ([], [], [])
    slot = article = False
    for kind, name, attributes in events(page):
        if kind == "text":
            _, _, skip, inside, within = walk.top
            if not skip:
                parts[0 if within else 1 if inside else 2].append(name)
            continue
        if kind == "open":
            walk.open(name, attributes, skips, main)
            _, _, skip, inside, within = walk.top
            slot, article = slot or (within and not skip), article or (inside and not skip)
        else:
            walk.close(name)
        if name not in INLINE:
            for part in parts:
                part.append(" ")
    return " ".join(html.unescape("".join(parts[0 if slot else 1 if article else 2])).split())


def host_of(url: str | None) -> str:
    m = re.match(r"(?s).*?://([^/?#]*)", url or "")
    return m[1].lower() if m else ""


def _pages(pages: DataFrame) -> DataFrame:
    url = pages["url"].cast("string")
    host = F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    own = F.concat(F.lit("page "), F.coalesce(pages["page_id"].cast("string"), F.lit("")))
    return pages.select("page_id", url.alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"), F.when(F.coalesce(host, F.lit("")) == "", own).otherwise(host).alias("host"))


_COUNTED = "host string, path string, run long, low long, high long, pages long, count long, place long, plain long, linked long, boiler boolean"


def _count(batches):
    """Partial sums by host and token: a tag's path, a run's path and hash, or the digest of a page (path ``=``)."""
    sums: dict[tuple[str, str, int | None], list[int]] = {}

    def rows():
        host, path, run = zip(*sums)
        low, high, pages, count, place, plain, linked, boiler = zip(*sums.values())
        # Hashes fill 64 bits, so a column that also holds nulls must not pass through floats.
        return pd.DataFrame({"host": host, "path": path, "run": pd.array(run, "Int64"), "low": low, "high": high, "pages": pages, "count": count, "place": place, "plain": plain, "linked": linked, "boiler": [b > 0 for b in boiler]})

    for batch in batches:
        for host, page in zip(batch["host"], batch["html"]):
            tags, runs, held = page_tokens(page)
            own = int.from_bytes(blake2b(page.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            marks = {n: scramble(own ^ scramble(n)) for n in {1, *(n for n, _ in tags.values()), *(n for n, _ in runs.values())}}
            found = [("", None, 1, 0, 0), ("=", own - (1 << 63), 1, 0, 0), *((p, None, n, at, 0) for p, (n, at) in tags.items()), *((p, r, n, 0, plain) for (p, r), (n, plain) in runs.items())]
            for path, run, n, place, plain in found:
                s = sums.setdefault((host, path, run), [0] * 8)
                for i, x in enumerate((marks[n] & 0xFFFFFFFF, marks[n] >> 32, 1, n, place, plain)):
                    s[i] += x
            for path, (plain, linked, boiler) in held.items():
                s = sums.setdefault((host, path, None), [0] * 8)
                s[5] += plain
                s[6] += linked
                s[7] += boiler
        if len(sums) > 50_000:
            yield rows()
            sums.clear()
    if sums:
        yield rows()


def deduce_templates(pages: DataFrame, support: float = 0.5, least_pages: int = 5) -> DataFrame:
    """``host, main, skips``: a row per host with its main slot, and its menus and containers of template text.

    What a host's row lists occurs on at least ``support`` of its pages, so its length is
    bounded by that of a page, whatever the number of pages.
    """
    counted = pages.select("host", "html").mapInPandas(_count, _COUNTED)
    sums = [F.sum(c).alias(c) for c in ("low", "high", "pages", "count", "place", "plain", "linked")]
    tokens = counted.groupBy("host", "path", "run").agg(*sums, F.max("boiler").alias("boiler"))
    # Runs that stand on one page alone are template only where that is all the host has.
    tokens = stored(tokens.where(F.col("run").isNull() | (F.col("path") == "=") | (F.col("pages") > 1)), "page-tokens")
    root = tokens.where("path = '' AND run IS NULL").select("host", F.col("low").alias("l0"), F.col("high").alias("h0"), F.col("pages").alias("all"))
    different = tokens.where("path = '='").groupBy("host").agg(F.count(F.lit(1)).alias("different"))
    on_all = (F.col("low") == F.col("l0")) & (F.col("high") == F.col("h0"))
    fixed = tokens.where("run IS NOT NULL AND path <> '='").join(root, "host").where(on_all).groupBy("host", "path").agg(F.sum("plain").alias("constant"))
    fixed = fixed.join(different, "host").where(F.col("different") >= max(least_pages, 2)).select("host", "path", "constant")
    valid = tokens.where("run IS NULL AND path <> ''").join(root, "host").where(F.col("pages") >= F.col("all") * support)
    valid = valid.join(fixed, ["host", "path"], "left")
    columns = ("path", "low", "high", "pages", "count", "place", "plain", "linked", "constant", "boiler")
    lists = valid.groupBy("host").agg(F.collect_list(F.struct(*columns)).alias("held"))

    def choose(batches):
        for batch in batches:
            made = [Template([Tag(c["path"], (c["low"], c["high"]), c["pages"], c["count"], c["place"] / max(c["pages"], 1), c["plain"], c["linked"], c["constant"] or 0, c["boiler"]) for c in held]) for held in batch["held"]]
            yield pd.DataFrame({"host": batch["host"], "main": [t.main_slot() for t in made], "skips": [sorted({*t.menus(), *t.boilerplate()}) for t in made]})

    return lists.mapInPandas(choose, "host string, main string, skips array<string>")


def scramble(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 31)


def main_texts(pages: DataFrame, support: float = 0.5) -> DataFrame:
    """Per page ``page_id, url, text, n_chars``.

    Pages meet their host's template in a join that Spark broadcasts while the templates are
    few, and deals by host beyond that, hot hosts being split as skewed partitions.
    """
    rows = _pages(pages)
    with Scratch(pages.sparkSession) as scratch:
        templates = scratch.result(deduce_templates(rows, support), "templates")
    joined = rows.join(templates, "host", "left").select("page_id", "url", "html", "main", "skips")
    some = lambda v: frozenset(() if v is None else v)

    def run(batches):
        for batch in batches:
            texts = [extract(h, m, some(s)) for h, m, s in zip(batch["html"], batch["main"], batch["skips"])]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return joined.mapInPandas(run, "page_id long, url string, text string, n_chars long")
