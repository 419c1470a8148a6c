"""Main text of web pages by a suffix array of each host's pages.

1. Every page is cut into blocks of text.  Scripts, styles and comments are dropped.  Blocks are
   ``main`` (in an article or main element), ``chrome`` (in menus, headers, footers, sidebars, forms, or outside
   the article in an element whose class, id or role names such a part, a notice, an advert or reader comments),
   ``open`` (anything else: outside the article, or in it under a name that only may mean chrome).
2. Main blocks stay and chrome goes: articles share lines, or are on several pages whole, so a repeat inside
   them is no evidence.  Open blocks are decided by repetition over the host's pages.
3. The token streams of pages, without main blocks, are concatenated.  A suffix array, sorted by prefix doubling up to
   the run length, brings equal runs of tokens together and counts the distinct pages of a host that have
   each.  Each task does this for its pages, and the counts of a run add up over tasks, as every distinct
   page of a host lies in one task: the result doesn't depend on how pages are dealt, and no host is gathered.
4. An open block goes if runs that occur on enough distinct pages cover it whole, and unique ones stay.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, cut, small_batches
from .words import U, WordHashes, mixed, runs

#: Fixed values of HTML: elements whose content is no text, elements that part blocks, elements without content.
RAW = frozenset("script style noscript template iframe canvas title textarea".split())
#: Elements whose content is no text of the page, but which can hold other elements.
HIDDEN = frozenset("head svg object select button".split())
CHROME = frozenset("nav footer aside form dialog menu".split())
PARTS = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in a class, id or role that mark what isn't the article, outside it; inside it they only make a block open.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|subscription|"
    r"sidebar|side|menu|nav|navbar|navigation|breadcrumb\w*|header|masthead|footer|comment|comments|commentlist|discussion|replies|disqus|share|sharing|social|related|recommended|pagination|pager|toolbar|contentinfo|complementary|search)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Whole names that mark chrome inside an article too.
STRICT = frozenset("ad ads advert advertisement sponsored promo newsletter subscribe cookie-notice cookie-banner comment comments discussion replies comment-list commentlist comments-area disqus_thread share share-buttons social-share sidebar breadcrumb breadcrumbs pagination pager complementary contentinfo navigation".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.DOTALL)
MARKED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
MAIN, OPEN, CHROME_BLOCK = 0, 1, 2


def blocks(page: str) -> list[tuple[int, str]]:
    """The page's blocks in order: kind and text, white space folded, none empty.

    A hidden element that is never closed ends where a part of the page begins (a paragraph, a heading and so on).
    """
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements that change the kind: name, kind before
    depth: dict[str, int] = {}  # of elements with such a name that opened inside
    kind, at, n = OPEN, 0, len(page)
    hidden = ""

    def close_block():
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((kind, text))

    while at < n:
        m = TAG.search(page, at)
        if not hidden:
            parts.append(page[at : m.start() if m else n])
        if m is None:
            break
        at = m.end()
        name = m[2] and m[2].lower()
        if not name:
            continue
        if hidden:
            if (m[1] and name == hidden) or name in PARTS:
                hidden = ""
            if m[1] and name not in PARTS:
                continue
        if m[1]:
            if name in PARTS:
                close_block()
            if any(x[0] == name for x in stack):
                if depth.get(name, 0) > 0 and stack[-1][0] == name:
                    depth[name] -= 1
                else:
                    while stack:
                        top, kind = stack.pop()
                        depth.pop(top, None)
                        if top == name:
                            break
            continue
        if name in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.IGNORECASE).search(page, at)
            if end is not None:
                at = end.end()
            elif name in ("script", "style"):
                at = n
            continue
        if hidden:
            continue
        if name in HIDDEN and not m[3].endswith("/"):
            hidden = name
            continue
        if name in PARTS:
            close_block()
        if name in VOID or m[3].endswith("/"):
            continue
        new = kind
        names = " ".join(a or b or c for a, b, c in MARKED.findall(m[3])) if "=" in m[3] else ""
        marked = bool(names) and name not in ("html", "body") and bool(MARKS.search(names))
        if name in ("article", "main"):
            if marked and name == "article" and not STRICT.isdisjoint(names.lower().split()):
                new = CHROME_BLOCK
            else:
                # an article ends a menu that was never closed
                new = MAIN if not (stack and stack[-1][0] in ("article", "main") and kind == CHROME_BLOCK) else kind
        elif name in CHROME or (name == "header" and kind != MAIN):
            new = CHROME_BLOCK
        elif marked and kind != CHROME_BLOCK:
            inside = any(x[0] in ("article", "main") for x in stack)
            new = OPEN if inside and STRICT.isdisjoint(names.lower().split()) else CHROME_BLOCK
        if new != kind or name in ("article", "main"):
            stack.append((name, kind))
            kind = new
        elif stack and stack[-1][0] == name:
            depth[name] = depth.get(name, 0) + 1
    close_block()
    return out


def suffix_ranks(streams: list[np.ndarray], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place of the concatenated streams: the rank of its suffix by ``run`` tokens, its stream, and whether a whole run starts there.

    Streams are joined with an end of their own each.  Ranks of suffixes by their first w tokens
    give those by 2w tokens, up to ``run``; suffixes of equal rank are neighbours in the suffix array.
    """
    lens = np.array([len(s) + 1 for s in streams], np.int64)
    total = int(lens.sum())
    owner = np.repeat(np.arange(len(streams)), lens)
    ends = np.cumsum(lens) - 1
    rank = np.zeros(total, np.int64)
    inside = np.ones(total, bool)
    inside[ends] = False
    flat = np.concatenate(streams) if streams else np.zeros(0, U)
    rank[inside] = np.unique(flat, return_inverse=True)[1] if len(flat) else 0
    rank[ends] = len(flat) + np.arange(len(streams))  # no end equals another, so no run crosses one
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < run:
        step = min(width, run - width)
        nxt = np.full(total, -1, np.int64)
        nxt[: max(0, total - step)] = rank[step:]
        rank = np.unique(rank * (total + 2) + nxt + 1, return_inverse=True)[1].astype(np.int64)
        width += step
    return rank, owner, np.arange(total) + run <= np.repeat(ends, lens)


def run_counts(streams: list[np.ndarray], hosts: list[str], run: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Each host's distinct runs in these streams: host, two hashes of the run, and how many streams have it."""
    none = np.zeros(0, np.int64)
    rank, owner, whole = suffix_ranks(streams, run)
    at = np.flatnonzero(whole)
    if not len(at):
        return [], none, none, none
    order = at[np.lexsort((owner[at], rank[at]))]  # the suffix array of whole runs; equal ones by stream
    names, host_of = np.unique(np.array(hosts, object).astype(str), return_inverse=True)
    r, o = rank[order], owner[order]
    first = np.ones(len(order), bool)
    first[1:] = (r[1:] != r[:-1]) | (o[1:] != o[:-1])
    order, r, h = order[first], r[first], host_of[o[first]]  # each stream once
    classes, where, n = np.unique(r * len(names) + h, return_index=True, return_counts=True)
    start = order[where]
    one, two = run_hashes(np.concatenate([np.append(s, U(0)) for s in streams]), run)
    return names[h[where]].tolist(), one[start].view(np.int64), two[start].view(np.int64), n


def run_hashes(tokens: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every run of tokens."""
    return runs(tokens, run), runs(mixed(tokens ^ U(0xA0761D6478BD642F)), run)


def decide(page: list[tuple[int, str]], counts: dict[tuple[int, int], int], run: int, hashes: WordHashes) -> str:
    """The text of a page whose host repeats runs as often as counts says.

    Open blocks go that repeated runs cover whole.  If that leaves nothing of a page without main blocks, it is a copy
    of others, whose own text is on fewer pages than the menus it stands among: its open blocks stay
    but for those that are on more than twice as many pages as the rarest.
    """
    side = [(kind, text, hashes([w.encode("utf-8", "surrogatepass") for w in text.split()])) for kind, text in page if kind != MAIN]
    stream = np.concatenate([h for _, _, h in side]) if side else np.zeros(0, U)
    one, two = run_hashes(stream, run)
    often = np.zeros(len(stream), np.int64)  # of the rarest repeated run over a token, 0 if none is
    for k, key in enumerate(zip(one.view(np.int64).tolist(), two.view(np.int64).tolist(), strict=True)):
        n = counts.get(key, 0)
        if n:
            part = often[k : k + run]
            part[:] = np.where(part == 0, n, np.minimum(part, n))
    open_blocks: list[tuple[str, int]] = []
    at = 0
    for kind, text, h in side:
        if kind == OPEN:
            open_blocks.append((text, int(often[at : at + len(h)].min())))
        at += len(h)
    keep = [n == 0 for _, n in open_blocks]
    if not any(keep) and not any(kind == MAIN for kind, _ in page) and open_blocks:
        least = min(n for _, n in open_blocks)
        keep = [n <= 2 * least for _, n in open_blocks]
    stays = iter(keep)
    return "\n".join(text for kind, text in page if kind == MAIN or (kind == OPEN and next(stays)))


def _packed(page: list[tuple[int, str]]) -> bytes:
    return zlib.compress("\n".join(f"{kind}{text}" for kind, text in page).encode("utf-8", "surrogatepass"), 1)


def _unpacked(z: bytes) -> list[tuple[int, str]]:
    return [(int(line[0]), line[1:]) for line in zlib.decompress(z).decode("utf-8", "surrogatepass").split("\n") if line]


def extract(pages: DataFrame, run: int = 8, least: int = 3, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) and n_open (blocks that repetition decided on) of every row.

    ``run`` tokens on ``least`` distinct pages of a host make a repeated run; whole copies of
    a page count as one.  Null html counts as empty, and pages without text give the empty text.  Null urls are one host.
    Repeated rows are pages each and get equal texts.  An empty table gives an empty result.
    """
    small_batches(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))

    def side(batches):
        """What a page holds outside main blocks; the whole page if repetition has to decide on some of it."""
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for page_id, url, name, x in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "host", "html")), strict=True):
                page = blocks(x or "")
                is_open = any(kind == OPEN for kind, _ in page)
                other = [p for p in page if p[0] != MAIN]
                stream = xxhash.xxh3_128_digest("\n".join([name, *(text for _, text in page)]).encode("utf-8", "surrogatepass"))
                for c, v in zip(cols, (page_id, url, name, stream, _packed(page if is_open else other) if other else None, is_open), strict=True):
                    c.append(v)
            yield batch_of(["page_id", "url", "host", "stream", "z", "is_open"], [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.bool_()], cols)

    sides = cut(rows.mapInArrow(side, "page_id long, url string, host string, stream binary, z binary, is_open boolean").where("z is not null"))

    def count(batches):
        hashes = WordHashes()
        for b in batches:
            streams = []
            for z in b.column("z").to_pylist():
                words = [w.encode("utf-8", "surrogatepass") for kind, text in _unpacked(z) if kind != MAIN for w in text.split()]
                streams.append(hashes(words))
            names, one, two, n = run_counts(streams, b.column("host").to_pylist(), run)
            yield batch_of(["host", "one", "two", "n"], [pa.string(), pa.int64(), pa.int64(), pa.int64()], [names, one, two, n])

    # Hosts with nothing to decide need no counts.
    undecided = sides.where("is_open")
    asked = undecided.select("host").distinct()
    streams = sides.select("host", "stream", "z").join(asked, "host", "left_semi").dropDuplicates(["host", "stream"]).select("host", "z")
    repeated = streams.mapInArrow(count, "host string, one long, two long, n long").groupBy("host", "one", "two").agg(F.sum("n").alias("n")).where(F.col("n") >= least)

    def page_runs(batches):
        hashes = WordHashes()
        for b in batches:
            out: list[list] = [[], [], [], []]
            for name, stream, z in zip(*(b.column(c).to_pylist() for c in ("host", "stream", "z")), strict=True):
                h = hashes([w.encode("utf-8", "surrogatepass") for kind, text in _unpacked(z) if kind != MAIN for w in text.split()])
                one, two = run_hashes(h, run)
                for x, y in set(zip(one.view(np.int64).tolist(), two.view(np.int64).tolist(), strict=True)):
                    for c, v in zip(out, (name, stream, x, y), strict=True):
                        c.append(v)
            yield batch_of(["host", "stream", "one", "two"], [pa.string(), pa.binary(), pa.int64(), pa.int64()], out)

    once = undecided.select("host", "stream", "z").dropDuplicates(["host", "stream"])
    met = once.mapInArrow(page_runs, "host string, stream binary, one long, two long").join(repeated, ["host", "one", "two"])
    # A stream's own repeated runs: no more than its tokens.
    known = met.groupBy("stream").agg(F.collect_list(F.struct("one", "two", "n")).alias("known"))

    def finish(batches):
        hashes = WordHashes()
        for b in batches:
            texts, opened = [], []
            for z, some in zip(b.column("z").to_pylist(), b.column("known").to_pylist(), strict=True):
                page = _unpacked(z)
                texts.append(decide(page, {(x["one"], x["two"]): x["n"] for x in some or ()}, run, hashes))
                opened.append(sum(kind == OPEN for kind, _ in page))
            yield batch_of(names, types, [b.column("page_id"), b.column("url"), texts, [len(t) for t in texts], opened])

    names, types = ["page_id", "url", "text", "n_chars", "n_open"], [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32()]
    schema = "page_id long, url string, text string, n_chars long, n_open int"

    def plain(batches):
        """Pages that have nothing to decide."""
        for b in batches:
            out: list[list] = [[], [], []]
            for page_id, url, x in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                page = blocks(x or "")
                if not any(kind == OPEN for kind, _ in page):
                    for c, v in zip(out, (page_id, url, "\n".join(text for kind, text in page if kind == MAIN)), strict=True):
                        c.append(v)
            yield batch_of(names, types, [*out, [len(t) for t in out[2]], [0] * len(out[0])])

    decided = rows.select("page_id", "url", "html").mapInArrow(plain, schema)
    return decided.unionByName(undecided.join(known, "stream", "left").mapInArrow(finish, schema))
