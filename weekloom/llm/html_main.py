"""Main text of pages by templates deduced from equivalence classes of tokens.

A token is an element in its place (the path of elements above it, with class and id) or a
run of words between two elements, in its place. Its occurrence vector over the pages of a
host says how often each page has it. Tokens with equal vectors form an equivalence class.
The class of the page itself (once in every page) is the host's template, nested by path;
the other large and frequent classes are its optional and repeated parts, nested in it.
Runs of words in a class are the template's own text, whatever their elements are called;
what the template leaves open are its slots, and the innermost slot that still holds nearly
all varying text is the article. Names of elements and classes decide only what the
template can't, and never drop all that a page has. Vectors are compared as sums of page
hashes, which add up in partial aggregation, so a host with a third of all pages is no
single group.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import table, written
from weekloom.llm.url_filter import host_and_path

# Names that say what an element is, in HTML and in common class names: fixed values.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "title")
SILENT = (*RAW, "head", "select", "button")
STRONG = ("nav", "header", "footer", "aside", "dialog", "menu")
ASIDE_WORDS = re.compile(
    r"(?:^|[-_\s])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo|banner|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|"
    r"header|masthead|cookies?|consent|notice|newsletter|subscribe|popup|modal|share|social|related|recommended|comments?|respond|widget)(?:$|[-_\s])"
)
BLOCKS = frozenset(
    "address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = ("article", "main", "section", "div", "td", "body")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# An open element of the key ends where one of these begins.
ENDED_BY = {
    "p": frozenset("address article aside blockquote dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split()),
    "head": BLOCKS,
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr",)),
    "td": frozenset(("td", "th", "tr")),
    "th": frozenset(("td", "th", "tr")),
    "option": frozenset(("option",)),
}
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
ATTRIBUTES = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SHARE = 0.9
MIN_PAGES = 5
# An optional or repeated part has so many tokens at least, and so large a share of the host's pages.
MIN_TOKENS, MIN_SHARE = 3, 0.05


def pieces(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, tag, whether it closes, attributes) for each tag, in one pass.

    The last piece has an empty tag. Comments, and elements whose content is no markup, are
    left out; what is unclosed ends with the page.
    """
    at, held, quoted = 0, [], True
    while (begin := page.find("<", at)) >= 0:
        held.append(page[at:begin])
        if page.startswith("<!--", begin):
            at = page.find("-->", begin + 4) + 3
            if at == 2:
                break
        elif page[begin + 1 : begin + 2] in ("!", "?"):
            at = page.find(">", begin) + 1
            if not at:
                break
        elif not (m := TAG.match(page, begin)):
            held.append("<")
            at = begin + 1
        else:
            tag, rest = m.group(2).lower(), ATTRIBUTES.match(page, m.end()) if quoted else None
            end = rest.end() if rest else page.find(">", m.end()) + 1
            if not end:
                break
            quoted = quoted and rest is not None  # a quote that never ends: none counts from here on
            at = end
            if tag in RAW_END:
                if not m.group(1):
                    close = RAW_END[tag].search(page, end)
                    if not close:
                        break
                    at = close.end()
                continue
            yield "".join(held), tag, bool(m.group(1)), page[m.end() : end - 1]
            held = []
    else:
        held.append(page[at:])
    yield "".join(held), "", False, ""


@dataclass
class Page:
    """Elements and runs of words of a page, in order. Element 0 is the page itself.

    ``ids`` are hashes of an element's path. ``strong`` and ``named`` tell whether an element
    or one above it is no part of an article by its tag or by its name, ``article`` whether
    one is an article or main element, and ``inner`` whether something inside that one is aside.
    """

    parents: list[int] = field(default_factory=lambda: [0])
    ids: list[int] = field(default_factory=lambda: [0])
    tags: list[str] = field(default_factory=lambda: [""])
    strong: list[bool] = field(default_factory=lambda: [False])
    named: list[bool] = field(default_factory=lambda: [False])
    article: list[bool] = field(default_factory=lambda: [False])
    inner: list[bool] = field(default_factory=lambda: [False])
    runs: list[tuple[int, int, str]] = field(default_factory=list)  # (element, id, text)

    def open(self, up: int, tag: str, names: str) -> int:
        strong = tag in STRONG
        named = tag == "form" or (tag not in ("html", "body", "main") and bool(ASIDE_WORDS.search(names.lower())))
        self.parents.append(up)
        self.ids.append(xxhash.xxh64_intdigest(f"{tag} {names}", self.ids[up]))
        self.tags.append(tag)
        self.strong.append(self.strong[up] or strong)
        self.named.append(self.named[up] or named)
        self.inner.append(self.inner[up] or (self.article[up] and (strong or named)))
        self.article.append(self.article[up] or tag in ("article", "main"))
        return len(self.ids) - 1

    def kept(self, template: frozenset[int] = frozenset()) -> list[tuple[int, int, str]]:
        """Runs that are not aside and not among the ``template`` runs.

        Names do not count where they would leave nothing, or less than an article or main
        element that only lies in something so named.
        """
        own = [r for r in self.runs if r[1] not in template and not self.strong[r[0]]]
        plain = [r for r in own if not self.named[r[0]]]
        article = [r for r in own if self.article[r[0]] and not self.inner[r[0]]]
        size = lambda runs: sum(len(r[2]) for r in runs)
        if not any(self.article[r[0]] for r in plain) and size(article) > size(plain):
            return article
        return plain or own

    def inside(self, flags: list[bool]) -> list[bool]:
        """Whether an element or one above it is flagged."""
        out = list(flags)
        for i in range(1, len(out)):
            out[i] = out[i] or out[self.parents[i]]
        return out


def read_page(html: str) -> Page:
    """Elements and runs of ``html``, in time linear in its length."""
    page, held = Page(), []
    stack: list[tuple[str, int, bool]] = [("", 0, False)]
    opened: Counter[str] = Counter()

    def flush() -> None:
        text = " ".join(html_lib.unescape("".join(held)).split())
        held.clear()
        _, element, silent = stack[-1]
        if text and not silent:
            page.runs.append((element, xxhash.xxh64_intdigest(f"\x00{text}", page.ids[element]), text))

    for before, tag, closes, attributes in pieces(html):
        held.append(before)
        if tag == "br":
            held.append(" ")
        if tag not in BLOCKS and tag not in SILENT and tag not in STRONG:
            continue  # inline or unknown: no part of the structure
        flush()
        if closes:
            while opened[tag]:
                last = stack.pop()[0]
                opened[last] -= 1
                if last == tag:
                    break
            continue
        while tag in ENDED_BY.get(stack[-1][0], ()):
            opened[stack.pop()[0]] -= 1
        if tag not in VOID:
            names = " ".join(" ".join(filter(None, g)) for g in NAMES.findall(attributes))
            _, up, silent = stack[-1]
            stack.append((tag, page.open(up, tag, " ".join(names.split())), silent or tag in SILENT))
            opened[tag] += 1
    flush()
    return page


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


TOKENS = "host string, token long, parent long, run boolean, tag string, depth int, hi long, lo long, pages long, chars long, around long"


def page_tokens(pages: DataFrame) -> DataFrame:
    """The occurrence vector of each token of each host, for ``pages(host, html, mark)``.

    host, token and parent (hashes of paths), run (words, not an element), tag, depth, hi and
    lo (sums of the halves of ``mark`` over pages, times the token's count there), pages, and
    chars: article text at or below the token, and around: that of the pages that hold it, once
    for each. Runs on fewer than ``MIN_PAGES`` pages are
    left out, after they are counted.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            sums: dict[tuple, list[int]] = {}
            for host, html, mark in df.itertuples(index=False):
                page = read_page(html or "")
                size, depth = [0] * len(page.ids), [0] * len(page.ids)
                counts: Counter[tuple] = Counter()
                chars: Counter[tuple] = Counter()
                kept = page.kept()
                for element, _, text in kept:
                    size[element] += len(text)
                for i in range(len(page.ids) - 1, 0, -1):
                    size[page.parents[i]] += size[i]
                for i, name in enumerate(page.ids):
                    depth[i] = depth[page.parents[i]] + 1 if i else 0
                    if not page.strong[i]:
                        token = (host, name, page.ids[page.parents[i]], False, page.tags[i], depth[i])
                        counts[token] += 1
                        chars[token] += size[i]
                for element, name, text in page.runs:
                    if not page.strong[element]:
                        counts[host, name, page.ids[element], True, "", depth[element]] += 1
                for element, name, text in kept:
                    chars[host, name, page.ids[element], True, "", depth[element]] += len(text)
                high, low = (mark >> 32) & 0xFFFFFFFF, mark & 0xFFFFFFFF
                for token, n in counts.items():
                    s = sums.setdefault(token, [0, 0, 0, 0, 0])
                    s[0], s[1], s[2], s[3], s[4] = s[0] + high * n, s[1] + low * n, s[2] + 1, s[3] + chars[token], s[4] + size[0]
            rows = [(t[0], _signed(t[1]), _signed(t[2]), *t[3:], *s) for t, s in sums.items()]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TOKENS.split(", ")])

    parts = pages.select("host", "html", "mark").mapInPandas(run, TOKENS)
    added = [F.sum(c).alias(c) for c in ("hi", "lo", "pages", "chars", "around")]
    summed = parts.groupBy("host", "token", "parent", "run", "tag", "depth").agg(*added)
    return summed.filter(~F.col("run") | (F.col("pages") >= MIN_PAGES))


def parts(tokens: pd.DataFrame) -> list[int]:
    """The own runs of a host's optional and repeated parts, out of its frequent tokens.

    A part is a class other than the page's, of ``MIN_TOKENS`` or more, nested by path: a run
    belongs to it if an element of the class lies above it, so the words come with each
    such element and never without it; words that recur in one of many elements alike are
    no template. A class around which little text varies stands for copies of an article, not
    for a part, and is left alone: all runs of its vector must be a small share of the article
    text of its pages.
    """
    above = {r.token: r.parent for r in tokens.itertuples() if not r.run}
    found = []
    for _, part in tokens[~tokens["page"]].groupby(["hi", "lo"]):
        elements = set(part["token"][~part["run"]])
        runs = part[part["run"]]
        if len(part) < MIN_TOKENS or not elements or runs["chars"].sum() > (1 - SHARE) * part["around"].max():
            continue
        for r in runs.itertuples():
            at = r.parent
            while at and at in above and at not in elements:
                at = above[at]
            if at in elements:
                found.append(r.token)
    return found


def templates(tokens: DataFrame) -> DataFrame:
    """host, slot and runs: the slot that is the article, and the template's own runs.

    The slot comes from the class of the page: tokens that are once in every page, so no more
    than the shortest page of the host has. The slot must hold nearly all varying text and be
    a container; an article or main element comes first, among equals the innermost. Runs
    of that class count as template only on hosts of ``MIN_PAGES`` pages or more whose pages
    differ; those of optional and repeated ``parts`` come on top. Other classes are of
    frequent tokens (on ``MIN_PAGES``, and ``MIN_SHARE`` of the host's pages), of which a host has
    no more than some twenty of its pages have.
    """
    whole = tokens.filter("depth = 0 and not run").select(
        "host", F.col("hi").alias("all_hi"), F.col("lo").alias("all_lo"), F.col("pages").alias("all_pages")
    )
    frequent = (F.col("pages") >= MIN_PAGES) & (F.col("pages") >= MIN_SHARE * F.col("all_pages"))
    classed = tokens.join(whole, "host").withColumn("page", F.expr("hi = all_hi and lo = all_lo")).filter(F.col("page") | frequent)
    classed = classed.select("host", "token", "parent", "run", "tag", "depth", "hi", "lo", "pages", "chars", "around", "page")

    def choose(tokens: pd.DataFrame) -> pd.DataFrame:
        df = tokens[tokens["page"]]
        size = {r.token: r.chars for r in df.itertuples() if not r.run}
        above = {r.token: r.parent for r in df.itertuples() if not r.run}
        runs = [r for r in df.itertuples() if r.run and r.pages >= MIN_PAGES]
        if sum(r.chars for r in runs) >= size[0]:
            runs = []  # nothing varies
        for r in runs:
            at = r.parent
            while at in size:
                size[at] -= r.chars
                if not at:
                    break
                at = above[at]
        rank = [
            (r.tag in ("article", "main"), r.depth, r.token)
            for r in df.itertuples()
            if not r.run and r.tag in CONTAINERS and size[r.token] >= SHARE * size[0]
        ]
        slot = max(rank)[2] if rank else None
        own = sorted([r.token for r in runs] + parts(tokens))
        return pd.DataFrame({"host": df["host"].iloc[:1], "slot": pd.array([slot], "Int64"), "runs": [own]})

    return classed.groupBy("host").applyInPandas(choose, "host string, slot long, runs array<long>")


def article(html: str | None, slot: int | None = None, runs: frozenset[int] = frozenset()) -> str:
    """The blocks of ``html`` in ``slot`` without template ``runs``, joined by blank lines.

    A page without the slot falls back on its own article or main element, then on all that
    is not aside.
    """
    page = read_page(html or "")
    kept = page.kept(runs)
    for inside in (page.inside([i > 0 and x == slot for i, x in enumerate(page.ids)]), page.article):
        if texts := [text for element, _, text in kept if inside[element]]:
            return "\n\n".join(texts)
    return "\n\n".join(text for _, _, text in kept)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages(page_id, url, html)``.

    Pages without a host (null URL, or one without ``://``) share the empty host. Null html
    is empty and has an empty text. Repeated rows stay rows and count as pages; other columns
    are ignored; an empty table gives no rows. Unclosed tags, comments and quotes end with the
    page. The template is deduced from all pages of the host.
    """
    rows = host_and_path(pages.select("page_id", "url", F.col("html").cast("string").alias("html"))).drop("path")
    # 30 bits a half: the sums of two thousand million pages fit.
    mark = F.xxhash64("page_id", "html").bitwiseAND(0x3FFFFFFF3FFFFFFF)
    tokens = written(page_tokens(rows.select("host", "html", mark.alias("mark"))), "page-tokens")
    chosen = written(templates(tokens), "page-templates")

    def extract(columns: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for html, slot, runs in columns:
            told = ((h, None if pd.isna(s) else int(s) % (1 << 64), frozenset(int(x) % (1 << 64) for x in (() if r is None else r))) for h, s, r in zip(html, slot, runs))
            yield pd.Series([article(*t) for t in told], dtype=object)

    # Slots as text: a column of long with nulls would pass through doubles.
    text = F.pandas_udf(extract, "string")("html", F.col("slot").cast("string"), "runs")
    return rows.join(chosen, "host", "left").select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op6_main_text(spark, sf_dir: str) -> DataFrame:
    """All pages."""
    return main_text(table(spark, sf_dir, "pages"))
