"""Main text of web pages: a suffix array over each host's token streams, with page structure as a prior.

Structure tells which text of a page can be main text at all, and whether it stands in an
explicit article. The token streams of a host's pages are concatenated and sorted into a
suffix array; neighbours with a long common prefix are one substring, and those that stand
on many distinct pages are boilerplate of the host. Covered stretches are cut, inside an
article only where a large share of the host's pages has them; unique runs stay. Large hosts
are dealt to parts of bounded size. What stands on a share of a host's pages does so in one of
its parts, so the parts name candidates, all count them, and the sums decide for the whole host.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sizes import BROADCAST_ROWS, small
from strandloom.functions.storage import materialise

#: Characters of HTML that a group holds about; tokens of a long substring, block ends counted.
GROUP_CHARS, RUN = 4_000_000, 8
#: Tasks that groups are dealt to at least; above it, a task for eight groups.
TASKS = 32
#: Distinct pages that a substring must stand on, and share of the host's pages, for one outside and one inside an
#: article; covered share of an article beyond which the page is a copy of others and stays whole.
MIN_PAGES, PAGE_SHARE, ARTICLE_SHARE, COPY = 3, 0.05, 0.5, 0.5

# Elements of HTML, and names that sites give to what isn't main text, alone or with a part of PLACES.
SILENT = {"head", "script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "audio", "video", "map", "title"}
ASIDE = {"nav", "footer", "aside", "form", "button", "select", "option", "textarea", "input", "dialog", "menu", "label", "fieldset"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
PLACES = {"area", "bar", "block", "body", "bottom", "box", "container", "content", "group", "inner", "item", "items", "left", "list", "main", "outer", "page", "panel", "right", "section", "site", "top", "wrap", "wrapper"}
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "newsletter",
    "subscribe", "subscription", "signup", "popup", "modal", "overlay", "sidebar", "aside", "rail", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "masthead", "topbar",
    "toolbar", "share", "sharing", "social", "related", "recommended", "recommendations", "comment", "comments", "respond", "replies", "disqus", "widget", "login", "search", "skip", "copyright", "disclaimer",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
_SECTION = re.compile(r"<!\[(?:cdata|temp|ignore|include|rcdata)(?![-_.a-z0-9])\s*\[", re.IGNORECASE)


_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def set_aside(names: str) -> bool:
    """Whether one of the names is made of NAMES and PLACES alone: "ad" and "cookie-notice" are, "related-work" isn't."""
    for name in names.lower().split():
        parts = re.split("[-_]+", name.strip("-_"))
        if any(x in NAMES for x in parts) and all(x in NAMES or x in PLACES for x in parts):
            return True
    return False


class _Blocks(HTMLParser):
    """Text blocks of a page that structure doesn't set aside, with whether each stands in an article."""

    CDATA_CONTENT_ELEMENTS = ("script", "style", "textarea")  # what they hold is no markup

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = []  # element; set aside: 0 not, 1 as a form, 2 otherwise; article
        self.blocks: list[tuple[str, bool]] = []
        self.parts: list[str] = []

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.blocks.append((text, bool(self.stack) and self.stack[-1][2]))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._flush()
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag == "p" and any(x[0] == "p" for x in self.stack):  # a paragraph ends where the next begins
            self._close("p")
        aside, article = self.stack[-1][1:] if self.stack else (0, False)
        own = {k: v or "" for k, v in attrs}
        if tag in ("article", "main"):
            aside, article = aside if aside == 2 else 0, True  # some sites wrap the whole page in a form
        elif tag not in ("html", "body"):
            names = "" if tag in _HEADINGS else own.get("class", "") if article else f"{own.get('class', '')} {own.get('id', '')}"  # ids in an article are targets of links
            if tag in SILENT or tag in ASIDE and tag != "form" or tag == "header" and not article or set_aside(names):
                aside = 2
            elif tag == "form":
                aside = max(aside, 1)
        if own.get("role", "").lower() in ROLES or "hidden" in own or own.get("aria-hidden") == "true":
            aside = 2
        self.stack.append((tag, aside, article))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        """An element that ends where it begins holds no text."""
        if tag in BLOCKS:
            self._flush()
        elif tag == "br":
            self.parts.append(" ")

    def _close(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return
            if tag not in BLOCKS and self.stack[i][0] in BLOCKS or tag == "p" and self.stack[i][0] in BLOCKS:
                return  # an inline element or a paragraph doesn't end across a block

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        self._close(tag)

    def parse_html_declaration(self, i: int) -> int:
        """As the library's, but marked sections other than those that end in ']]>' are comments up to the next '>'."""
        if self.rawdata.startswith("<![", i) and not _SECTION.match(self.rawdata, i):
            return self.rawdata.find(">", i) + 1 or -1
        return super().parse_html_declaration(i)

    def handle_data(self, data: str) -> None:
        if not (self.stack and self.stack[-1][1]):
            self.parts.append(data)


def page_blocks(html: str | None) -> tuple[bool, list[str]]:
    """Whether the page has an explicit article with text, and its text blocks in page order: the article's if it has.

    White space is one space; what structure sets aside is left out.
    """
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser._flush()
    told = any(article for _, article in parser.blocks)
    return told, [text for text, article in parser.blocks if article or not told]


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the suffixes in sorted order, and the tokens that each has in common with the one before it.

    Prefix doubling: the suffixes that are still alike by their first h tokens are sorted by the rank of what follows
    these. The ranks of all rounds then give the common prefixes of neighbours by halving.
    """
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(tokens, kind="stable")

    def starts(*keys: np.ndarray) -> np.ndarray:
        """Where a group of equal neighbours begins."""
        fresh = np.ones(len(keys[0]), bool)
        fresh[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        return fresh

    fresh = starts(tokens[order])
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1  # behind the last token
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels, step = [rank.copy()], 1
    left = np.flatnonzero(~fresh | ~np.append(fresh[1:], True))  # places in the order that are shared
    while len(left):
        at = order[left]
        own, behind = rank[at], rank[np.minimum(at + step, n)]
        turn = np.lexsort((behind, own))
        at, own, behind = at[turn], own[turn], behind[turn]
        order[left] = at
        fresh = starts(own, behind)
        rank[at] = np.maximum.accumulate(np.where(fresh, left, 0))
        levels.append(rank.copy())
        step *= 2
        left = left[~fresh | ~np.append(fresh[1:], True)]
    a, b = order[:-1], order[1:]
    common = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = np.minimum(a + common, n), np.minimum(b + common, n)
        common += np.where((levels[k][x] == levels[k][y]) & (x < n) & (y < n), 1 << k, 0)
    return order, np.append(0, common)


class Host:
    """The token streams of some rows of a host, one behind the other, with block ends and page ends between them."""

    def __init__(self, rows: pa.ListArray, pages: list, run: int = RUN):
        self.rows, self.run = rows, run
        self.joined = rows.flatten()
        self.row = np.repeat(np.arange(len(rows)), pc.list_value_length(rows).to_numpy()).astype(np.int64)  # of each block
        split = pc.split_pattern(self.joined, " ")
        self.size = size = pc.list_value_length(split).to_numpy().astype(np.int64)
        words = split.flatten().dictionary_encode()
        n_words = len(words.dictionary)
        last = np.append(self.row[1:] != self.row[:-1], True) if len(self.row) else np.zeros(0, bool)
        ends = np.cumsum(size + 1) - 1  # a block end behind each block, in a row's last block an end of its own
        self.begin = ends - size
        self.tokens = np.zeros(int(size.sum()) + len(size), np.int64)
        self.block = np.repeat(np.arange(len(size)), size + 1)
        self.inside = np.ones(len(self.tokens), bool)
        self.inside[ends] = False
        self.tokens[self.inside] = words.indices.to_numpy().astype(np.int64) + 1
        self.tokens[ends[last]] = n_words + 1 + np.arange(last.sum())
        page = pd.factorize(np.array(pages, object), use_na_sentinel=False)[0].astype(np.int64) if len(pages) else np.zeros(0, np.int64)
        self.n_pages = len(np.unique(page))
        self.page = page[self.row]
        self.word_hash = np.append(np.uint64(0x9E3779B97F4A7C15), pd.util.hash_array(np.array(words.dictionary.to_pylist(), object))) if n_words else np.ones(1, np.uint64)
        # places of substrings of ``run`` tokens: all in one row, and none reaches its end
        begins = np.ones(len(self.tokens), bool)
        for k in range(run):  # a row that is shorter marks places of the row before that are marked anyway
            begins[np.maximum(ends[last] - k, 0)] = False
        self.at = np.flatnonzero(begins)

    def substring_classes(self) -> np.ndarray:
        """For each place the number of its class of equal substrings: neighbours in the suffix array with that much in common."""
        order, common = suffix_array(self.tokens)
        klass = np.empty(len(order), np.int64)
        klass[order] = np.cumsum(common < self.run)
        return np.unique(klass[self.at], return_inverse=True)[1]

    def distinct_pages(self, klass: np.ndarray, page: np.ndarray) -> np.ndarray:
        """The distinct pages of each class."""
        pairs = np.unique(klass * (self.n_pages + 1) + page)
        return np.bincount(pairs // (self.n_pages + 1)) if len(pairs) else np.zeros(0, np.int64)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pages that have the substring at each place, and each block."""
        runs, blocks = self.substring_classes(), np.unique(self.block_digests(), return_inverse=True)[1]
        return self.distinct_pages(runs, self.page[self.block[self.at]])[runs], self.distinct_pages(blocks, self.page)[blocks]

    def run_digests(self) -> np.ndarray:
        """A hash of the substring at each place, the same in every part of a host; even."""
        hashes = self.word_hash[np.where(self.inside, self.tokens, 0)]
        with np.errstate(over="ignore"):
            value = np.zeros(len(self.at), np.uint64)
            for k in range(self.run):
                value = (value * np.uint64(0xBF58476D1CE4E5B9) + hashes[self.at + k]) ^ (value >> np.uint64(31))
        return value & np.uint64(2**64 - 2)

    def block_digests(self) -> np.ndarray:
        """A hash of each block's text; odd."""
        return pd.util.hash_array(np.array(self.joined.to_pylist(), object)) | np.uint64(1) if len(self.joined) else np.zeros(0, np.uint64)

    def candidates(self) -> np.ndarray:
        """Digests of what stands on PAGE_SHARE of these pages."""
        runs, blocks = self.counts()
        least = PAGE_SHARE * self.n_pages
        return np.unique(np.concatenate([self.run_digests()[runs >= least], self.block_digests()[blocks >= least]]))

    def count_candidates(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the digests that stand here, and their distinct pages."""
        digest = np.concatenate([self.run_digests(), self.block_digests()])
        page = np.concatenate([self.page[self.block[self.at]], self.page])
        own = np.isin(digest, wanted)
        keys, klass = np.unique(digest[own], return_inverse=True)
        return keys, self.distinct_pages(klass, page[own])

    def texts(self, told: list[bool], n_pages: int, runs: np.ndarray, blocks: np.ndarray) -> pa.Array:
        """Text of each row, less what stands on too many of the host's pages by the counts for each place and block.

        A stretch of covered tokens is cut from a block if it is as long as a substring or the whole block; in rows
        without an article, repeated blocks of any length go, too. A row of which nothing, or of an article too
        little, would be left is a copy of other pages and stays as it is.
        """
        told_block = np.array(told, bool)[self.row] if len(self.row) else np.zeros(0, bool)
        share = np.where(told_block, ARTICLE_SHARE, PAGE_SHARE)
        needed = np.maximum(MIN_PAGES, np.ceil(share * n_pages))
        hits = self.at[runs >= needed[self.block[self.at]]] if len(self.at) else self.at
        edge = np.zeros(len(self.tokens) + 1, np.int64)
        np.add.at(edge, hits, 1)
        np.add.at(edge, hits + self.run, -1)
        covered = (np.cumsum(edge[:-1]) > 0) & self.inside
        covered |= (~told_block & (blocks >= needed))[self.block] & self.inside
        found = pc.binary_join(self.rows, "\n")
        if not covered.any():
            return found
        # stretches: neighbouring covered tokens of a block
        begins = covered & ~np.append(False, covered[:-1])
        stretch = np.cumsum(begins) - 1
        length = np.bincount(stretch[covered], minlength=1)
        cut = covered.copy()
        cut[covered] = (length[stretch[covered]] >= self.run) | (length[stretch[covered]] == self.size[self.block[covered]])
        rows = len(told)
        row_of = self.row[self.block]
        lost, all_of = np.bincount(row_of[cut], minlength=rows), np.bincount(row_of[self.inside], minlength=rows)
        copy = np.where(np.array(told, bool), lost > COPY * all_of, lost == all_of)
        cut &= ~copy[row_of]
        out: dict[int, list[str]] = {}
        touched = np.bincount(self.block[cut], minlength=len(self.row))
        changed = np.unique(self.row[touched > 0])
        first, behind = np.searchsorted(self.row, changed), np.searchsorted(self.row, changed, side="right")
        for row, i, j in zip(changed.tolist(), first.tolist(), behind.tolist(), strict=True):
            out[row] = []
            for k in range(i, j):
                if touched[k] < self.size[k]:
                    here, text = self.begin[k], self.joined[k].as_py()
                    out[row].append(" ".join(w for w, x in zip(text.split(" "), cut[here : here + self.size[k]], strict=True) if not x) if touched[k] else text)
        mask = np.zeros(rows, bool)
        mask[changed] = True
        return pc.replace_with_mask(found, pa.array(mask), pa.array(["\n".join(out[r]) for r in changed.tolist()], pa.string()))


def main_texts(pages: list[str | None], ids: list | None = None) -> list[str]:
    """Main text of each page of one host."""
    found = [page_blocks(x) for x in pages]
    host = Host(pa.array([blocks for _, blocks in found], _BLOCKS), list(range(len(pages))) if ids is None else ids)
    return host.texts([told for told, _ in found], host.n_pages, *host.counts()).to_pylist()


_BLOCKS = pa.list_(pa.string())
_ROW = "page_id long, url string, host string, part int, n_pages long, told boolean, blocks array<string>"
_OUT = "page_id long, url string, text string, n_chars long"
_PART = "host string, n_pages long, page_id array<long>, url array<string>, told array<boolean>, blocks array<array<string>>, wanted array<long>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "host", "part", "n_pages"]
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            told, blocks = zip(*[page_blocks(x.as_py()) for x in part["html"]], strict=True)
            yield pa.RecordBatch.from_arrays([*(part[x] for x in names), pa.array(told, pa.bool_()), pa.array(blocks, _BLOCKS)], names=[*names, "told", "blocks"])


def _alone(table: pa.Table) -> pa.Table:
    """The rows of a host that is one part."""
    host = Host(_flat(table["blocks"]), table["page_id"].to_pylist())
    texts = host.texts(table["told"].to_pylist(), host.n_pages, *host.counts())
    return pa.table({"page_id": table["page_id"], "url": table["url"], "text": texts, "n_chars": pc.utf8_length(texts).cast(pa.int64())})


def _pack(table: pa.Table) -> pa.Table:
    """A part of a host as one row, with the digests of what may be repeated over the host."""
    blocks = _flat(table["blocks"])
    wanted = Host(blocks, table["page_id"].to_pylist()).candidates().view(np.int64)
    own = {x: _flat(table[x]) for x in ("page_id", "url", "told")} | {"blocks": blocks, "wanted": pa.array(wanted)}
    lists = {x: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for x, v in own.items()}
    return pa.table({"host": table["host"][:1], "n_pages": table["n_pages"][:1]} | lists)


def _flat(column: pa.ChunkedArray) -> pa.Array:
    """A column as one array."""
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part: the pages that have each of the host's candidates."""
    for batch in batches:
        for i in range(batch.num_rows):
            host = Host(batch["blocks"][i].values, batch["page_id"][i].as_py())
            digest, pages = host.count_candidates(np.array(batch["digests"][i].as_py(), np.int64).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array([batch["host"][i].as_py()] * len(digest), pa.string()), pa.array(digest.view(np.int64)), pa.array(pages, pa.int64())], names=["host", "digest", "pages"])


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each part, by the sums over all parts of its host."""
    for batch in batches:
        for i in range(batch.num_rows):
            host = Host(batch["blocks"][i].values, batch["page_id"][i].as_py())
            sums = batch["sums"][i].as_py() or []
            keys, pages = np.array([x["digest"] for x in sums], np.int64).view(np.uint64), np.array([x["pages"] for x in sums], np.int64)
            turn = np.argsort(keys)
            keys, pages = np.append(keys[turn], np.uint64(2**64 - 1)), np.append(pages[turn], 0)

            def of(digest: np.ndarray, keys=keys, pages=pages) -> np.ndarray:
                at = np.searchsorted(keys, digest)
                return np.where(keys[at] == digest, pages[at], 0)

            texts = host.texts(batch["told"][i].as_py(), batch["n_pages"][i].as_py(), of(host.run_digests()), of(host.block_digests()))
            yield pa.RecordBatch.from_arrays([batch["page_id"][i].values, batch["url"][i].values, texts, pc.utf8_length(texts).cast(pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, group_chars: int = GROUP_CHARS) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page.

    A null html counts as empty and gives an empty text; pages without a host in their url share a host of their
    own; rows of one page_id are one page to the counts and give a row each, equal ones equal rows; other columns are
    ignored; an empty table gives an empty one. The text is the article's, or without an article or main element
    the page's, less what structure sets aside and what the host repeats. The result doesn't depend on
    ``group_chars``, but for collisions of 63-bit digests.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url"), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    sizes = rows.groupBy("host", "page_id").agg(F.sum(F.coalesce(F.length("html"), F.lit(0))).alias("chars"))
    sizes = materialise(sizes.groupBy("host").agg(F.greatest(F.lit(1), F.ceil(F.sum("chars") / group_chars)).cast("int").alias("parts"), F.count(F.lit(1)).alias("n_pages")), "hosts")
    dealt = rows.join(small(sizes), "host").withColumn("part", F.pmod(F.xxhash64(F.coalesce("page_id", F.lit(-1))), F.col("parts").cast("long")).cast("int"))
    own = ["page_id", "url", "host", "part", "n_pages", "html"]
    total = sizes.agg(F.coalesce(F.sum(F.col("parts").cast("long")), F.lit(0)).alias("parts")).first()["parts"]  # one number
    tasks = max(TASKS, total // 8)
    whole = dealt.filter("parts = 1").select(*own).mapInArrow(_parse, _ROW).repartition(tasks, "host").groupBy("host").applyInArrow(_alone, _OUT)
    if sizes.filter("parts > 1").isEmpty():
        return whole
    parts = materialise(dealt.filter("parts > 1").select(*own).mapInArrow(_parse, _ROW).repartition(tasks, "host", "part").groupBy("host", "part").applyInArrow(_pack, _PART), "parts")
    wanted = materialise(parts.select("host", F.explode("wanted").alias("digest")).distinct(), "candidates")
    grouped = wanted.groupBy("host").agg(F.collect_list("digest").alias("digests"))
    counted = parts.drop("wanted").join(_by_host(wanted, grouped), "host").mapInArrow(_count, "host string, digest long, pages long")
    sums = materialise(counted.groupBy("host", "digest").agg(F.sum("pages").alias("pages")).filter(F.col("pages") >= MIN_PAGES), "sums")
    grouped = sums.groupBy("host").agg(F.collect_list(F.struct("digest", "pages")).alias("sums"))
    return whole.union(parts.drop("wanted").join(_by_host(sums, grouped), "host", "left").mapInArrow(_together, _OUT))


def _by_host(rows: DataFrame, grouped: DataFrame) -> DataFrame:
    """``grouped``, a row for each host, broadcast if the rows that it holds are few enough."""
    return F.broadcast(grouped) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else grouped
