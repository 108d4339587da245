"""Operator 12: the article of a web page, found by what the pages of its host agree on.

1. Each page is read into its blocks of text and the containers around them.
   Blocks of menus, forms, adverts and the like are left out by tag, role and the
   words of class and id; a container's score is the unlinked text of the rest.
   The page votes for the deepest path of containers with most of its score.
   A path is generalised: tags and classes, numbers taken out.
2. Spark counts the votes of each host. A host's winners are the paths with one
   in a hundred of its votes at least, so no host has more than a hundred.
3. Each page is read again with the winners of its host: of those that it has,
   the one with most votes, or the winner inside it that isn't weak, is its
   article. A page that has none but the whole body goes by its own vote.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, tidy

#: Share of a page's score that the container it votes for holds.
MOST = 0.7
#: Share of a page's score that a winner needs to count as found on it.
FOUND = 0.01
#: Share of the votes of the winners found on a page that a path needs to be preferred to one around it.
WEAK = 0.1
#: A host's winners have one in so many of its votes.
WINNERS = 100
#: Parts that the pages of a host are dealt into when they meet their winners.
SALT = 8
#: Share of linked text, and links, from which a list is a menu.
MENU, MENU_LINKS = 0.8, 3

# Names of HTML elements and the words that pages call their parts by.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article center details div fieldset form header main section table td".split())
CLOSES_P = BLOCK - frozenset("body caption html legend optgroup option tbody td tfoot th thead tr".split())
NEVER = frozenset("aside audio button canvas datalist dialog embed footer input label map menu nav noscript object search select svg template video".split())
NO_ROLE = frozenset("alert alertdialog complementary contentinfo dialog menu menubar navigation search toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEADER_WORDS = frozenset("header masthead topbar banner".split())
COMMENT_WORDS = frozenset("comment comments commentlist commentarea comentarios commentaires discussion disqus kommentar kommentare replies reply respond responses".split())
PART_WORDS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising adslot anzeige aside breadcrumb breadcrumbs consent cookie cookies copyright crumbs disclaimer footer footnav gdpr login menu modal "
    "nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup promo promotion promoted publicidad recommended related share sharing sidebar signup "
    "skyscraper social sponsor sponsored sponsors subscribe subscription taboola tags toolbar werbung widget widgets".split()
)

#: What an element is to its text: nothing; never text of an article; a part by its name; a header; comments.
PLAIN, DEAD, PART, HEADER, COMMENTS = range(5)

_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S
)
_ATTR = re.compile(r"""([a-zA-Z_:@][^\s=/>"']*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.S)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@lru_cache(maxsize=1 << 14)
def _kind(tag: str, attrs: str) -> tuple[int, str]:
    """(what the element is to its text, its step of a path)."""
    have = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    classes = unescape(have.get("class", ""))
    step = ".".join([tag, *sorted({re.sub(r"\d+", "#", c.lower()) for c in classes.split()})]) if tag in CONTAINER else ""
    words = {w.lower() for w in _WORD.findall(f"{classes} {unescape(have.get('id', ''))}")}
    role = have.get("role", "").lower()
    if tag in NEVER or role in NO_ROLE or "hidden" in have or have.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(have.get("style", "")):
        return DEAD, step
    if tag in ("body", "html", "main"):
        return PLAIN, step
    if words & COMMENT_WORDS:
        return COMMENTS, step
    if tag == "header" or role == "banner" or words & HEADER_WORDS:
        return HEADER, step
    return (PART if tag == "form" or words & PART_WORDS else PLAIN), step


class Page:
    """Blocks of text of a page in their order, and the elements around them.

    ``parent``, ``tag``, ``kind`` and ``path`` are lists by element, 0 the body;
    ``blocks`` holds (element, text, characters of it that are links, links).
    """

    def __init__(self, html: str):
        self.parent, self.tag, self.kind, self.path = [-1], ["body"], [PLAIN], ["body"]
        self.blocks: list[tuple[int, str, int, int]] = []
        self._read(html)
        self._judge()

    def _read(self, html: str) -> None:
        parent, tags, kinds, paths, blocks = self.parent, self.tag, self.kind, self.path, self.blocks
        # of each open element: its number, and the places in the stack of the p, li, dt or dd, tr, td around it
        stack: list[tuple[int, int, int, int, int, int]] = [(0, 0, 0, 0, 0, 0)]
        count: dict[str, int] = defaultdict(int)
        text: list[str] = []
        linked = links = 0
        line = False
        at, end = 0, len(html)

        def flush() -> None:
            nonlocal linked, links, line
            if text:
                said = " ".join("".join(text).split())
                if said:
                    blocks.append((stack[-1][0], said, min(linked, len(said)), links))
                text.clear()
            linked = links = 0
            line = False

        def close(to: int) -> None:
            while len(stack) > to:
                count[tags[stack.pop()[0]]] -= 1

        while at < end:
            m = _TOKEN.search(html, at)
            run = html[at : m.start()] if m else html[at:]
            if run:
                if "&" in run:
                    run = unescape(run)
                text.append(run)
                if line and not run.isspace():
                    line = False
                if count["a"]:
                    linked += len(run.strip())
            if not m:
                break
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            tag = name.lower()
            if m[1] or m[4]:
                if tag == "br":
                    text.append(" ")
                elif tag == "p" and not stack[-1][1]:
                    flush()
                elif count[tag]:
                    to = len(stack) - 1
                    while tags[stack[to][0]] != tag:
                        to -= 1
                    if tag in BLOCK or any(tags[x[0]] in BLOCK for x in stack[to:]):
                        flush()
                    close(to)
                continue
            if tag == "br":
                if line:
                    flush()
                text.append("\n")
                line = True
                continue
            if tag in RAW:
                over = _RAW_END[tag].search(html, at)
                at = over.end() if over else end
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                continue
            if tag in ("html", "head", "body"):
                continue
            _, p, li, dd, tr, td = stack[-1]
            if tag in BLOCK:
                flush()
                to = len(stack)
                if p and tag in CLOSES_P:
                    to = min(to, p)
                if tag == "li" and li:
                    to = min(to, li)
                elif tag in ("dt", "dd") and dd:
                    to = min(to, dd)
                elif tag in ("td", "th") and td:
                    to = min(to, td)
                elif tag in ("tr", "tbody", "thead", "tfoot") and tr:
                    to = min(to, tr)
                close(to)
            elif tag == "a":
                links += 1
                if count["a"]:
                    to = len(stack) - 1
                    while tags[stack[to][0]] != "a" and tags[stack[to][0]] not in BLOCK:
                        to -= 1
                    if tags[stack[to][0]] == "a":
                        close(to)
            attrs = m[3] or m[6] or ""
            if tag == "svg" and attrs.endswith("/"):
                continue
            above, p, li, dd, tr, td = stack[-1]
            kind, step = _kind(tag, attrs) if tag in BLOCK or tag in NEVER or tag == "span" or "-" in tag else (PLAIN, "")
            place = len(stack)
            if tag == "p":
                p = place
            elif tag == "li":
                p, li = 0, place
            elif tag in ("ul", "ol", "menu", "dir"):
                p = li = 0
            elif tag in ("dt", "dd"):
                p, dd = 0, place
            elif tag == "dl":
                dd = 0
            elif tag == "table":
                p = li = dd = tr = td = 0
            elif tag == "tr":
                tr, td = place, 0
            elif tag in ("td", "th"):
                p, li, dd, td = 0, 0, 0, place
            number = len(parent)
            parent.append(above)
            tags.append(tag)
            kinds.append(kind)
            paths.append(f"{paths[above]}>{step}" if step else paths[above])
            stack.append((number, p, li, dd, tr, td))
            count[tag] += 1
        flush()

    def _judge(self) -> None:
        """Find out which blocks can be an article's, and the score of each path."""
        parent, tags, kinds = self.parent, self.tag, self.kind
        n = len(parent)
        gone = [False] * n
        for k in range(1, n):
            gone[k] = gone[parent[k]] or kinds[k] == DEAD
        worth, size, linked, links, main = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
        for k, said, own, many in self.blocks:
            if not gone[k]:
                worth[k] += max(0, len(said) - 2 * own)
                size[k] += len(said)
                linked[k] += own
                links[k] += many
        for k in range(n - 1, 0, -1):
            up = parent[k]
            for sums in (worth, size, linked, links):
                sums[up] += sums[k]
            if not gone[k] and (main[k] or tags[k] in ("h1", "article", "main") and kinds[k] == PLAIN):
                main[k] = True
                main[up] = True
        # what is called a part by its name is one on a page that marks its article, else unless it holds most of the page
        marked = any(not gone[k] and kinds[k] == PLAIN and tags[k] in ("article", "main") for k in range(n))
        inside = [False] * n
        state = [PLAIN] * n
        for k in range(1, n):
            up, kind = parent[k], kinds[k]
            inside[k] = inside[up] or tags[k] in ("article", "main")
            state[k] = state[up]
            if gone[k] or state[k] == DEAD or kind == COMMENTS and not main[k]:
                state[k] = DEAD
            elif kind == PART and not main[k] and (marked or 2 * worth[k] <= worth[0]) or tags[k] in ("ul", "ol") and links[k] >= MENU_LINKS and linked[k] >= MENU * size[k]:
                state[k] = DEAD
            elif kind == HEADER and not (tags[k] in CONTAINER and 2 * worth[k] > worth[0]):
                state[k] = HEADER if inside[k] or up and main[k] else DEAD
        self.live = [state[k] == PLAIN or state[k] == HEADER and tags[k] in HEADINGS for k in range(n)]
        own = [0] * n
        for k, said, linked_, _ in self.blocks:
            if self.live[k]:
                own[k] += max(0, len(said) - 2 * linked_)
        for k in range(n - 1, 0, -1):
            own[parent[k]] += own[k]
        # an element without a step has its parent's path: only the first element of a path counts
        self.tops = [k == 0 or self.path[k] != self.path[parent[k]] for k in range(n)]
        self.score: dict[str, int] = defaultdict(int)
        for k in range(n):
            if self.tops[k]:
                self.score[self.path[k]] += own[k]

    def vote(self) -> str | None:
        """The deepest path with most of the page's score; none without text."""
        total = self.score["body"]
        best = [p for p, s in self.score.items() if s >= MOST * total]
        return max(best, key=lambda p: (p.count(">"), self.score[p], p)) if total else None

    def article(self, votes: dict[str, int]) -> str:
        """Text of the containers that the host's votes point to."""
        total = self.score["body"]
        found = {p: v for p, v in votes.items() if p in self.score and self.score[p] >= FOUND * total}
        if found.keys() <= {"body"}:
            path = self.vote() or "body"
        else:
            least = WEAK * sum(found.values())
            path, inner = "", list(found)
            while inner:
                path = max(inner, key=lambda p: (found[p], p.count(">"), p))
                inner = [p for p, v in found.items() if p.startswith(f"{path}>") and v >= least]
        chosen = [False] * len(self.parent)
        for k in range(len(chosen)):
            chosen[k] = self.path[k] == path if self.tops[k] else False
            chosen[k] = chosen[k] or k > 0 and chosen[self.parent[k]]
        return "\n\n".join(said for k, said, _, _ in self.blocks if chosen[k] and self.live[k])


def host_of(url: str) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, votes): each host's winning paths. Pages without an absolute address vote together."""

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            voted = [Page(html or "").vote() for html in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(voted, pa.string())], names=["host", "path"])

    cast = pages.select(host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("html"))
    counts = cast.mapInArrow(tidy(votes), "host string, path string").where("path is not null").groupBy("host", "path").agg(F.count("*").alias("votes"))
    counts = stored(counts)
    totals = counts.groupBy("host").agg(F.sum("votes").alias("all"))
    return counts.join(totals, "host").where(f"votes * {WINNERS} >= all").select("host", "path", "votes")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): a row for each row of ``pages``, with the main text of its whole html.

    A null or empty html, or one without an article's text, gives an empty text;
    ids and addresses may be null or repeat and are handed on as they are; a page
    without an absolute address is judged with all others like it; repeated rows
    are rows each and vote each; html of any length is read whole, in time in
    proportion to it; of paths of equal votes the deepest, then the last in
    order is taken; an empty table gives no rows. Other columns play no part.
    """
    winners = host_paths(pages, url_col, html_col).groupBy("host").agg(F.collect_list("path").alias("paths"), F.collect_list("votes").alias("votes"))
    winners = stored(winners).withColumn("salt", F.explode(F.expr(f"sequence(0, {SALT - 1})")))
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for html, paths, votes in zip(*(b.column(x).to_pylist() for x in ("html", "paths", "votes")), strict=True):
                texts.append(Page(html or "").article(dict(zip(paths or [], votes or [], strict=True))))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    cast = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host_of(url_col).alias("host"))
    cast = cast.withColumn("salt", F.expr(f"cast(pmod(xxhash64(url, html), {SALT}) as int)"))
    joined = cast.join(winners, ["host", "salt"], "left").select("page_id", "url", "html", "paths", "votes")
    return joined.mapInArrow(tidy(run), f"page_id {id_type}, url string, text string, n_chars long")


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
