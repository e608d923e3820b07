"""HTML main text by nearest-URL page differencing and structure.

A page is cut into text lines, one per block.  Pages are ordered by host and URL path, and each is aligned with its nearest
neighbour by longest common subsequence of the lines outside articles (`article`, `main`, role=main): shared lines
are template text and are deleted, and so are lines in menus, headers, footers, side columns, notices, adverts, forms or
reader comments, whether shared or not.  Lines inside an article are never deleted for being shared: two pages may carry
the same article.  A page with an article that has no neighbour to be compared with is its article alone.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

# Elements whose content is no text of the page.  RAW ones run to the end of the page if they are not closed, the others are
# then passed over; REPLACED ones part words.
RAW = frozenset("script style textarea title iframe noscript".split())
SKIPPED = RAW | frozenset("template svg object select button canvas audio video".split())
REPLACED = frozenset("iframe object canvas audio video".split())
END_TAG = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE) for name in SKIPPED}
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
TAG_PART = re.compile(r""">|=\s*["']""")  # the end of a tag, or the beginning of a quoted value
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot"
    " th thead tr ul caption".split()
)
HELD = BLOCK - {"p", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "option"}  # elements kept on the stack
DROPPED = frozenset("nav footer aside dialog head menu".split())
GROUPED = frozenset("form fieldset".split())  # dropped, but for one around the article
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar aside cookie cookies consent"
    " gdpr notice notices comment comments disqus respond newsletter subscribe signup social share sharing menu navbar nav navigation"
    " breadcrumb breadcrumbs related recommended footer popup modal overlay widget login search contentinfo complementary".split()
)
# With one of these a compound name says something about the page, and does not name a part of it (no-sidebar, comments-open).
ABOUT = frozenset(
    "no not non has have with without is hide hides hidden off on open opened close closed enabled disabled allowed result results count layout".split()
)
WHOLE = frozenset("html body article main".split())  # never dropped for a word
_SPACE = re.compile(r"\s+")


def _words(attributes: str) -> tuple[set[str], bool, bool]:
    """The words that name what an element is, whether it has role=main, and whether it is marked as an article's body."""
    words: set[str] = set()
    main = body = False
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        value, kind = (m[2] or m[3] or m[4] or "").lower(), m[1].lower()
        for token in value.split():
            parts = set(re.split(r"[^a-z]+", token)) - {""}
            if not parts & ABOUT:
                words |= parts
        main |= kind == "role" and value.strip() == "main"
        body |= "articlebody" in value
    return words, main, body


def _zone(name: str, attributes: str, in_main: bool) -> str:
    """'drop', 'soft' (dropped unless it holds the article), 'main' or ''."""
    words, main, body = _words(attributes)
    if name in DROPPED:
        return "drop"
    if name in WHOLE or main:
        return "main" if name in ("article", "main") or main else ""
    if name in GROUPED or words & DROPPED_WORDS or (not in_main and (name == "header" or words & {"header", "masthead"})):
        return "soft"
    return "main" if body else ""


class _Scanner:
    """The tags of a page.  Every search either consumes what it passes or tells that no further one is needed, so that the time
    grows with the page only, however broken it is."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.quotes = {q: page.rfind(q) for q in "\"'"}
        self.loose = False  # tags end at the next >, quoted or not: set by a tag that would run to the end of the page
        self.unclosed: set[str] = set()

    def tag_end(self, at: int) -> int:
        """Position of the > that ends the tag whose attributes begin at `at`; there is a > behind `at`.  Quotes count after an
        equals sign only, and only where they are closed."""
        pos = at
        while not self.loose and (m := TAG_PART.search(self.page, pos)):
            if m[0] == ">":
                return m.start()
            quote = m[0][-1]
            pos = self.page.find(quote, m.end()) + 1 if m.end() <= self.quotes[quote] else m.end()
        self.loose = True
        return self.page.find(">", at)

    def skipped_to(self, name: str, at: int) -> int:
        """Where the content of a skipped element ends."""
        if name in self.unclosed:
            return at
        m = END_TAG[name].search(self.page, at)
        if m is None:
            self.unclosed.add(name)
        return m.end() if m else len(self.page) if name in RAW else at

    def __iter__(self) -> Iterator[tuple[str | None, bool, str]]:
        """(None, False, text), or (tag name, whether it is an end tag, attributes)."""
        page, at = self.page, 0
        while at < len(page):
            lt = page.find("<", at)
            if lt != at:
                yield None, False, page[at:] if lt < 0 else page[at:lt]
                if lt < 0:
                    return
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 2)
                at = len(page) if end < 0 else end + 3
                continue
            close = page.startswith("/", lt + 1)
            m = NAME.match(page, lt + 1 + close) if lt < self.last else None
            if m:
                end = self.tag_end(m.end())
                name, attributes, at = m[0].lower(), page[m.end() : end], end + 1
                if name in SKIPPED and not close:
                    if name in REPLACED:
                        yield None, False, " "
                    if not (name == "svg" and attributes.endswith("/")):
                        at = self.skipped_to(name, at)
                else:
                    yield name, close, attributes
            elif lt < self.last and page[lt + 1] in "/!?":
                at = page.find(">", lt) + 1
            else:
                yield None, False, "<"
                at = lt + 1


def page_lines(page: str) -> list[tuple[str, str]]:
    """(line, zone) in page order; zone is 'main', 'drop' or ''.

    Lines below a dropped element are dropped.  A word or a form does not drop what holds the article: where all articles lie below
    dropped elements, the first that only words and forms drop is the page's article, and what it lies in is not dropped.
    """
    out: list[tuple[str, int]] = []
    elements: list[tuple[int, str]] = [(0, "")]  # of each block element: the one it lies in, and its own zone
    stack: list[tuple[str, int]] = []
    names: Counter[str] = Counter()  # open elements by name, and by zone
    zones: Counter[str] = Counter()
    parts: list[str] = []
    at = 0

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((text, at))
            parts.clear()

    def pop() -> str:
        name, own = stack.pop()
        names[name] -= 1
        zones[elements[own][1]] -= 1
        return name

    for name, close, rest in _Scanner(page):
        if name is None:
            parts.append(rest)
            continue
        if name not in BLOCK:
            if name in ("br", "img", "input"):
                parts.append(" ")
            continue
        flush()
        if name not in HELD:
            continue
        if close:
            while names[name] and pop() != name:
                pass
        else:
            if name in ("li", "td", "th", "tr", "dt", "dd") and stack and stack[-1][0] == name:
                pop()  # end tags that may be left out
            own = _zone(name, rest, zones["main"] > 0)
            elements.append((stack[-1][1] if stack else 0, own))
            stack.append((name, len(elements) - 1))
            names[name] += 1
            zones[own] += 1
        at = stack[-1][1] if stack else 0
    flush()
    found = _resolved(elements, set())
    if "main" not in found:
        found = _resolved(elements, _around_article(elements))
    return [(text, found[k]) for text, k in out]


def _resolved(elements: list[tuple[int, str]], kept: set[int]) -> list[str]:
    """The zone of each element; those of `kept` don't drop."""
    found = [""]
    for k, (parent, own) in enumerate(elements[1:], 1):
        above = found[parent]
        own = "" if k in kept else own
        found.append("drop" if above == "drop" or own in ("drop", "soft") else "main" if above == "main" or own == "main" else "")
    return found


def _around_article(elements: list[tuple[int, str]]) -> set[int]:
    """The elements around the first article that lies in no element dropped for its name; empty if there is none."""
    hard = [False]
    for parent, own in elements[1:]:
        hard.append(hard[parent] or own == "drop")
    k = next((k for k, (_, own) in enumerate(elements) if own == "main" and not hard[k]), 0)
    around = set()
    while k:
        k = elements[k][0]
        around.add(k)
    return around


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in a of a longest common subsequence with b.

    A common beginning, then a common end, then lines without a counterpart are set aside.  The rest is aligned row by row in
    whole bit vectors (Crochemore and others): bit j of a row is 0 where the length grows from j to j + 1 lines of b.  The way
    back takes equal lines, else leaves out the line of b where that costs nothing, else the line of a.  Every
    square-rootth row is kept and the rows between are made again, so memory stays small.
    """
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    found = {*range(first), *range(len(a) - last, len(a))}
    both = set(a[first : len(a) - last]) & set(b[first : len(b) - last])
    x = [k for k in range(first, len(a) - last) if a[k] in both]
    y = [line for line in b[first : len(b) - last] if line in both]
    where: dict[str, list[int]] = {}
    for j, line in enumerate(y):
        where.setdefault(line, []).append(j)
    masks = {}
    for line, at in where.items():
        bits = bytearray(len(y) // 8 + 1)
        for j in at:
            bits[j // 8] |= 1 << (j % 8)
        masks[line] = int.from_bytes(bits, "little")
    full = (1 << len(y)) - 1

    def after(row: int, k: int) -> int:
        hit = row & masks[a[k]]
        return ((row + hit) | (row - hit)) & full

    step = math.isqrt(len(x)) + 1
    kept, row = [full], full
    for i, k in enumerate(x, 1):
        row = after(row, k)
        if i % step == 0:
            kept.append(row)
    i, j, rows, begin = len(x), len(y), [], -1
    while i and j:
        if (i - 1) // step != begin:
            begin = (i - 1) // step
            rows = [kept[begin]]
            for k in x[begin * step : i]:
                rows.append(after(rows[-1], k))
        if a[x[i - 1]] == y[j - 1]:
            i, j = i - 1, j - 1
            found.add(x[i])
        elif rows[i - begin * step] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
    return found


def _place(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit((url or "").strip())
        return (parts.hostname or "").lower(), parts.path or "/"
    except ValueError:
        return "", url or ""


def _distance(a: str, b: str) -> tuple[int, int]:
    """How far two paths are apart: path steps not shared, then characters not shared."""
    x, y = a.split("/"), b.split("/")
    same = 0
    while same < min(len(x), len(y)) and x[same] == y[same]:
        same += 1
    return len(x) + len(y) - 2 * same, abs(len(a) - len(b))


Key = tuple[str, str, bool, int, bool, str, str]


def _key(host: str, path: str, page_id: str | None, url: str | None, tie: str) -> Key:
    """The order of pages, nulls first, as Spark sorts them."""
    return host, path, page_id is not None, int(page_id or 0), url is not None, url or "", tie


class Ends:
    """Of pages added in any order: the first and the first one with other lines than it, the last and the last one with other lines."""

    def __init__(self) -> None:
        self.first: list[tuple] = []
        self.last: list[tuple] = []

    def add(self, page: tuple) -> None:
        """page: key, digest of its lines, and what is kept of it."""
        self.first = self._two([page, *self.first], min, False)
        self.last = self._two([page, *self.last], max, True)

    @staticmethod
    def _two(pages: list[tuple], pick, down: bool) -> list[tuple]:
        best = [pick((x for x in pages if x[1] == d), key=lambda x: x[0]) for d in {x[1] for x in pages}]
        return sorted(best, key=lambda x: x[0], reverse=down)[:2]


def _borders(ends: dict[tuple[str, int], Ends]) -> list[tuple[int, object]]:
    """(part, what is kept of a page): the pages a part needs of the parts before and after it, host by host."""
    out = []
    hosts: dict[str, list[int]] = {}
    for host, part in sorted(ends):
        hosts.setdefault(host, []).append(part)
    for host, parts in hosts.items():
        for order, side in ((parts, "last"), (parts[::-1], "first")):
            near: list[tuple] = []  # the nearest page passed, and the nearest with other lines than it
            for part in order:
                out += [(part, page[2]) for page in near]
                for page in reversed(getattr(ends[host, part], side)):
                    near = [page, *[x for x in near if x[1] != page[1]]][:2]
    return out


def _bounds(source: DataFrame, n: int) -> list[Key]:
    """At most n - 1 keys that cut the pages into parts of about one size: quantiles of about 64 n sampled ones."""
    rows = source.count() if n > 1 else 0
    if not rows:
        return []
    sample = source.select("page_id", "url", "tie").sample(min(1.0, 64 * n / rows), seed=1).collect()
    keys = sorted(_key(*_place(r["url"]), r["page_id"], r["url"], r["tie"]) for r in sample)
    return sorted({keys[k * len(keys) // n] for k in range(1, n)}) if keys else []


PAGE = "part int, host string, path string, page_id string, url string, tie string"


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_outside, n_shared, n_differenced: one row per input row; of the lines outside articles, those
    shared with the page it was compared with, and those that only this deleted (structure would have kept them).

    Null html counts as empty and gives an empty text; repeated rows and null ids are kept.  Pages without a host form one group.  Within a host pages are in
    the order of (path, page_id, url, hash of the html), and each is compared with the nearer of its neighbours in it.
    Pages without a line outside the article are stepped over.  A page with an article takes the next pages as they
    are; a page without takes the next ones whose lines differ from its own, however many equal pages lie between, and
    passes over one that still shares every line: it tells nothing.  Repeated rows are kept; extra columns are ignored.

    Pages are dealt to parts by sampled bounds in that very order, so a host with very many pages is spread over tasks.
    A part is given the pages it needs of the parts around it: the nearest and the nearest that differs from that one,
    so results do not depend on the bounds.  To find these, pages of hosts that a bound cuts are parsed twice.
    """
    spark = pages.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.xxhash64("html").cast("string").alias("tie"))
    bounds = _bounds(source, n)
    cut_hosts = {b[0] for b in bounds}

    @F.pandas_udf("int")
    def part_of(page_id: pd.Series, url: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(bounds, _key(*_place(u), p, u, t)) for p, u, t in zip(page_id, url, tie, strict=True)], dtype="int32")

    def find_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends: dict[tuple[str, int], Ends] = {}
        for pdf in batches:
            for page_id, url, page, tie in zip(*(pdf[c] for c in ("page_id", "url", "html", "tie")), strict=True):
                host, path = _place(url)
                rest = [t for t, z in page_lines(page or "") if z != "main"] if host in cut_hosts else []
                if rest:
                    key = _key(host, path, page_id, url, tie)
                    at = bisect.bisect_right(bounds, key)
                    ends.setdefault((host, at), Ends()).add((key, _digest(rest), (at, host, path, page_id, url, tie, rest)))
        yield _ends_table(ends)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        ends = Ends()
        for r in pdf.itertuples():
            ends.add((_key(r.host, r.path, r.page_id, r.url, r.tie), r.digest, (r.part, r.host, r.path, r.page_id, r.url, r.tie, list(r.rest))))
        return _ends_table({(pdf["host"].iloc[0], pdf["part"].iloc[0]): ends})

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                rows = []
                for part, page_id, url, page, tie, given in zip(*(pdf[c][at : at + 256] for c in ("part", "page_id", "url", "html", "tie", "rest")), strict=True):
                    lines = page_lines(page or "") if given is None else [(t, "") for t in given]
                    main = [t for t, z in lines if z == "main"]
                    rest = [(t, z == "drop", k) for k, (t, z) in enumerate(lines) if z != "main"]
                    before = [k - j for j, (_, _, k) in enumerate(rest)]
                    rows.append((part, *_place(url), page_id, url, tie, given is None, main or None, [r[0] for r in rest], [r[1] for r in rest], before))
                yield pd.DataFrame(rows, columns=["part", "host", "path", "page_id", "url", "tie", "own", "main", "rest", "dropped", "before"])

    dealt = source.select(part_of("page_id", "url", "tie").alias("part"), "page_id", "url", "html", "tie", F.lit(None).cast("array<string>").alias("rest"))
    if bounds:
        schema = f"{PAGE}, digest string, rest array<string>, name string"
        border = checkpointed(source.mapInPandas(find_ends, schema).groupBy("host", "part").applyInPandas(merge, schema))  # at most 4 rows for each end of a part
        ends: dict[tuple[str, int], Ends] = {}
        for r in border.drop("rest").collect():
            ends.setdefault((r["host"], r["part"]), Ends()).add((_key(r["host"], r["path"], r["page_id"], r["url"], r["tie"]), r["digest"], r["name"]))
        targets = F.broadcast(spark.createDataFrame(_borders(ends), "part int, name string"))
        given = border.drop("part").join(targets, "name")
        dealt = dealt.unionByName(given.select("part", "page_id", "url", F.lit(None).cast("string").alias("html"), "tie", "rest"))
    lines = dealt.repartitionById(n, F.col("part")).mapInPandas(parse, f"{PAGE}, own boolean, main array<string>, rest array<string>, dropped array<boolean>, before array<int>")
    lines = lines.sortWithinPartitions("part", "host", "path", F.col("page_id").cast("decimal(38,0)"), "url", "tie")
    out = lines.mapInPandas(_difference, "page_id string, url string, text string, n_chars long, n_outside long, n_shared long, n_differenced long")
    return out.withColumn("page_id", F.col("page_id").cast("long"))


def _digest(rest: list[str]) -> str:
    return hashlib.blake2b("\n".join(rest).encode(), digest_size=16).hexdigest()  # lines hold no line ends


def _ends_table(ends: dict[tuple[str, int], Ends]) -> pd.DataFrame:
    rows = [(*kept[:6], digest, kept[6], uuid.uuid4().hex) for e in ends.values() for _, digest, kept in {x[0]: x for x in (*e.first, *e.last)}.values()]
    return pd.DataFrame(rows, columns=["part", "host", "path", "page_id", "url", "tie", "digest", "rest", "name"])


def _difference(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order.  A run is a stretch of pages with equal lines; its pages without article wait for the run's end."""
    last = left = before = None  # the last page with lines; the page to its left; the last page of the run before
    run: list[tuple] = []
    out: list[tuple] = []

    def step(row: tuple | None) -> None:
        nonlocal last, left, before, run
        same = last is not None and row is not None and last[:2] == row[:2]
        after = row if same else None
        if last is not None and last[6] and last[7] is not None:
            out.append(_finish(last, [left, after]))
        if not same or row[8] != last[8]:
            known: dict[int, set[int]] = {}
            out.extend(_finish(waiting, [before, after], known) for waiting in run)
            run, before = [], last if same else None
        left, last = last if same else None, row
        if row is not None and row[6] and row[7] is None:
            run.append(row)

    for pdf in batches:
        for row in zip(*(pdf[c] for c in ("part", "host", "path", "page_id", "url", "tie", "own", "main", "rest", "dropped", "before")), strict=True):
            row = (*row[:8], list(row[8]), *row[9:])
            if row[8]:
                if last is not None and row[8] == last[8]:
                    row = (*row[:8], last[8], *row[9:])  # one list a run
                step(row)
            elif row[6]:
                out.append(_finish(row, []))
        yield _table(out)
        out.clear()
    step(None)
    yield _table(out)


def _table(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["page_id", "url", "text", "n_chars", "n_outside", "n_shared", "n_differenced"])


def _finish(row: tuple, near: list[tuple | None], known: dict[int, set[int]] | None = None) -> tuple:
    """`known` keeps the positions shared with each of `near` for pages of equal lines."""
    path, page_id, url, main, rest, dropped, before = row[2], row[3], row[4], row[7], row[8], row[9], row[10]
    known = {} if known is None else known
    shared: set[int] = set()
    for k in sorted((k for k, x in enumerate(near) if x is not None), key=lambda k: _distance(path, near[k][2])):
        if k not in known:
            known[k] = shared_lines(rest, near[k][8])
        if main is not None or len(known[k]) < len(rest):
            shared = known[k]
            break
    lines, at = [], 0
    main = [] if main is None else list(main)
    if not main or any(x is not None for x in near):
        for k in range(len(rest)):
            if not dropped[k] and k not in shared:
                lines += [*main[at : before[k]], rest[k]]
                at = max(at, int(before[k]))
    text = "\n".join(lines + main[at:])
    return page_id, url, text, len(text), len(rest), len(shared), sum(not dropped[k] for k in shared)
