"""Main text of web pages by consensus of a host's pages.

Every page is scanned into containers with generalised tag-class paths (digits dropped; a path is known by a hash of all
its containers). A container's score is the length of the text in its blocks, without twice its link text, half passed on to
the container around it. The best container is widened to those around it while they hold more of the article (``_widened``).
Each page votes for the path of its widened best container; votes are summed by host and path in Spark, and every page is read
again, in page order, from all containers on its host's winning path, widened likewise (from its own best one if it has
none on that path).

Elements of OUTSIDE never belong to an article. Names decide nothing about the vote but a weight: forms, and elements
that a class, id or role names as a side matter (``_side_matter``), are regions whose text counts ``HINT`` for the score. Inside
the winning container a region goes if it holds less than MAIN of the text there; regions around the container don't matter.

Defined results: a null or empty page has the empty text; a null address counts as the host ''; repeated rows vote
each; broken markup is read on as browsers do (unclosed paragraphs end at the next block, unclosed elements at the end;
of an unclosed frame, object, drawing or formula only the tag goes; a quote that never ends is none; a tag that never
ends takes the rest of the page); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MAX_HOSTS = 50_000
#: Siblings of other paths widen a container if they hold this share of its text; so does loose text of the body.
BESIDE = 0.1
#: What the text of a region counts for the score, and the share of a container's text from which a region in it stays.
HINT, MAIN = 0.25, 0.9
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r">|=\s*([\"'])")
#: Elements whose content is skipped up to the closing tag; those of FOREIGN may be closed by their own tag or lack a closing one.
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template iframe object textarea select svg math".split()}
FOREIGN = frozenset("iframe object svg math".split())
_CLASS = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[A-Za-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements that may hold the article.
HOLDERS = frozenset("article main section div body td center".split())
#: Elements that never belong to it.
OUTSIDE = frozenset("head title nav header footer aside button menu dialog audio video canvas map".split())
#: Words of classes, ids and roles of side matter.
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar side aside "
    "comment comments respond disqus notice notices cookie cookies consent alert popup modal newsletter subscribe form search share sharing social related recommended widget widgets pagination pager toolbar".split()
)
#: Words that make a compound with one of OUTSIDE_WORDS (``site-header``), unlike others (``has-sidebar``, ``social-history``).
COMPOUND_WORDS = frozenset(
    "area bar block bottom box btn button buttons container content desktop fixed global group icon icons inline inner item items js left link links list local main mobile page "
    "post posts primary right row secondary section sections signup site slot sticky sub thread top unit wrap wrapper zone".split()
)
#: Elements that no class, id or role makes side matter.
KEPT = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
#: Elements that an opening tag ends, and those where the search stops.
_ENDS = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_FENCE = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "dt": {"dl"}, "dd": {"dl"}}


class Block(NamedTuple):
    holder: int  # number of the nearest container
    text: str
    linked: int  # characters in links
    region: int  # number of the innermost region


class Page(NamedTuple):
    paths: list[int]  # of each container
    tags: list[str]
    parents: list[int]
    inside: list[int]  # region of each container
    regions: list[int]  # the region around each
    blocks: list[Block]


def _side_matter(tag: str, attributes: str) -> bool:
    """Whether a whole class, id or role is one of OUTSIDE_WORDS or a compound of them and COMPOUND_WORDS."""
    if tag in KEPT:
        return False
    for _, a, b, c in _CLASS.findall(attributes):
        for token in (a or b or c).split():
            words = {w.lower() for w in _WORDS.findall(token)} - ({"form"} if tag == "form" else set())
            if words & OUTSIDE_WORDS and words <= OUTSIDE_WORDS | COMPOUND_WORDS:
                return True
    return False


def _label(tag: str, attributes: str) -> str:
    classes = next((a or b or c for k, a, b, c in _CLASS.findall(attributes) if k.lower() == "class"), "")
    return ".".join([tag, *sorted({"".join(_WORDS.findall(c)).lower() for c in classes.split()} - {""})])


def step(path: int, label: str) -> int:
    """Hash of a path with one more container."""
    raw = path.to_bytes(8, "little") + label.encode("utf-8", "replace")
    return zlib.crc32(raw) << 31 | zlib.crc32(raw, 0x9E3779B9) >> 1


def scan(source: str) -> Page:
    """Containers, regions and blocks, in one pass."""
    paths, tags, parents, inside, regions, blocks = [0], ["#"], [-1], [0], [-1], []
    open_tags: list[tuple[str, int, bool, bool, int]] = []  # tag, container, outside, in a link, region
    opened: Counter[str] = Counter()
    endless: set[str] = set()  # quotes and raw elements that have no end from here on
    raw: list[str] = []
    linked = 0
    at = 0

    def end_block() -> None:
        nonlocal linked
        if raw:
            text = " ".join("".join(raw).split())
            if text:
                _, holder, _, _, region = open_tags[-1] if open_tags else ("", 0, False, False, 0)
                blocks.append(Block(holder, text, linked, region))
            raw.clear()
        linked = 0

    def say(piece: str) -> None:
        nonlocal linked
        if piece and not (open_tags and open_tags[-1][2]):
            decoded = html.unescape(piece) if "&" in piece else piece
            raw.append(decoded)
            if open_tags and open_tags[-1][3]:
                linked += len(decoded)

    def close(i: int) -> None:
        if any(t not in INLINE for t, *_ in open_tags[i:]):
            end_block()
        opened.subtract(t for t, *_ in open_tags[i:])
        del open_tags[i:]

    def tag_end(i: int) -> int:
        """Where the tag ends whose name ends at ``i``; 0 if nowhere."""
        while m := _STOP.search(source, i):
            if not m[1]:
                return m.end()
            i = -1 if m[1] in endless else source.find(m[1], m.end())
            if i < 0:
                endless.add(m[1])
                return source.find(">", m.end()) + 1
            i += 1
        return 0

    while (begin := source.find("<", at)) >= 0:
        say(source[at:begin])
        m = _NAME.match(source, begin)
        if not m:
            if source.startswith("<!--", begin):
                end = source.find("-->", begin + 4) + 3
                at = end if end > 2 else len(source)
            elif source[begin + 1 : begin + 2] in ("!", "?", "/"):
                at = source.find(">", begin) + 1 or len(source)
            else:
                say("<")
                at = begin + 1
            continue
        at = tag_end(m.end()) or len(source)
        tag, attributes = m[2].lower(), source[m.end() : at]
        if not attributes.endswith(">"):
            break
        if m[1]:
            if opened[tag] > 0:
                for i in range(len(open_tags) - 1, -1, -1):
                    if open_tags[i][0] == tag:
                        close(i)
                        break
                    if tag in INLINE and open_tags[i][0] not in INLINE:
                        break
            continue
        if tag in _RAW_END:
            if tag in FOREIGN and attributes.endswith("/>"):
                continue
            if end := None if tag in endless else _RAW_END[tag].search(source, at):
                at = end.end()
            elif tag in FOREIGN:
                endless.add(tag)
            else:
                at = len(source)
            continue
        if tag in VOID:
            if tag == "hr":
                end_block()
            elif tag == "br":
                say(" ")
            continue
        if tag not in INLINE:
            ends, fence = _ENDS.get(tag, {"p"}), _FENCE.get(tag, HOLDERS)
            if any(opened[t] > 0 for t in ends):
                for i in range(len(open_tags) - 1, -1, -1):
                    if open_tags[i][0] in fence:
                        break
                    if open_tags[i][0] in ends:
                        close(i)
                        break
            end_block()
        _, holder, outside, link, region = open_tags[-1] if open_tags else ("", 0, False, False, 0)
        outside = outside or tag in OUTSIDE
        if not outside and (tag == "form" or _side_matter(tag, attributes)):
            regions.append(region)
            region = len(regions) - 1
        if tag in HOLDERS and not outside:
            paths.append(step(paths[holder], _label(tag, attributes)))
            tags.append(tag)
            parents.append(holder)
            inside.append(region)
            holder = len(paths) - 1
        open_tags.append((tag, holder, outside, link or tag == "a", region))
        opened[tag] += 1
    if at < len(source):
        say(source[at:])
    end_block()
    return Page(paths, tags, parents, inside, regions, blocks)


def _weight(b: Block) -> float:
    return (len(b.text) - 2 * b.linked) * (HINT if b.region else 1.0)


def scores(page: Page) -> list[float]:
    own = [0.0] * len(page.paths)
    for b in page.blocks:
        own[b.holder] += _weight(b)
    total = list(own)
    for i in range(len(own) - 1, 0, -1):  # children come after their parents
        total[page.parents[i]] += total[i] / 2
    return total


def _widened(page: Page, i: int) -> int:
    """The container that holds the article of which ``i`` is a part.

    That is the outermost article element around it, then the container around as long as that holds text itself,
    siblings on the same path, or siblings of other paths with a share of ``BESIDE``. The body counts only for loose text
    of that share: what stands beside the article there is mostly not part of it.
    """
    n = len(page.paths)
    own, whole = [0] * n, [0] * n
    for b in page.blocks:
        if b.region == page.inside[i]:  # a region beside the article widens nothing
            own[b.holder] += max(0, len(b.text) - 2 * b.linked)
            whole[b.holder] += len(b.text) - 2 * b.linked
    children: list[list[int]] = [[] for _ in range(n)]
    for k in range(n - 1, 0, -1):
        whole[page.parents[k]] += whole[k]
        children[page.parents[k]].append(k)
    k = i
    while k > 0:
        if page.tags[k] == "article":
            i = k
        k = page.parents[k]
    while (up := page.parents[i]) >= 0:
        share = BESIDE * max(whole[i], 1)
        if page.tags[up] in ("body", "#"):
            more = own[up] >= share
        else:
            others = [k for k in children[up] if k != i and whole[k] > 0]
            more = own[up] > 0 or any(page.paths[k] == page.paths[i] for k in others) or sum(whole[k] for k in others) >= share
        if not more:
            break
        i = up
    return i


def best(page: Page) -> int:
    total = scores(page)
    return _widened(page, max(range(len(total)), key=lambda i: (total[i], -i)))


def _without_regions(page: Page, blocks: list[tuple[int, Block]]) -> list[Block]:
    """The blocks, each with its outermost chosen container, without those of the container's regions that hold less than MAIN."""
    below, size, held = [], Counter(), Counter()
    known: dict[tuple[int, int], int] = {}  # by the container's region and a region in it: the outermost one between them
    for top, b in blocks:
        base, region, passed = page.inside[top], b.region, []
        while region != base and (base, region) not in known:
            passed.append(region)
            region = page.regions[region]
        last = known[base, region] if region != base else passed[-1] if passed else 0
        known.update(((base, r), last) for r in passed)
        below.append(last)
        size[top] += len(b.text)
        held[last] += len(b.text)
    return [b for (top, b), r in zip(blocks, below) if not r or held[r] >= MAIN * size[top]]


def text_of(page: Page, path: int | None) -> str:
    """Blocks inside the containers on the path that aren't mostly links; without one, inside the page's best container."""
    total = scores(page)
    on_path = [i for i, p in enumerate(page.paths) if p == path]
    top = max(on_path, key=lambda i: (total[i], -i)) if on_path else -1
    chosen = {i for i in on_path if total[i] > 0} | {_widened(page, top) if on_path else best(page)}
    under = [-1] * len(page.paths)  # the outermost chosen container around each
    for i in range(len(page.paths)):
        above = under[page.parents[i]] if i else -1
        under[i] = above if above >= 0 else i if i in chosen else -1
    return "\n\n".join(b.text for b in _without_regions(page, [(under[b.holder], b) for b in page.blocks if under[b.holder] >= 0]))


def host_of(url: str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def votes(pages: DataFrame) -> DataFrame:
    """``host, path, n, score``: pages of a host whose best container has the path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for host, source in zip(batch.column(0), batch.column(1)):
                page = scan(source.as_py() or "")
                if page.blocks:
                    i = best(page)
                    out.append({"host": host.as_py(), "path": page.paths[i], "score": scores(page)[i]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("host", pa.string()), ("path", pa.int64()), ("score", pa.float64())]))

    each = pages.select(host_of("url").alias("host"), F.col("html")).mapInArrow(run, "host string, path bigint, score double")
    return each.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))


def winners(pages: DataFrame) -> DataFrame:
    """``host, path`` with the most votes; ties go to the higher score, then to the larger hash."""
    return votes(pages).groupBy("host").agg(F.max_by("path", F.struct("n", F.round("score", 3).alias("score"), "path")).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row."""
    won = cut(winners(pages))
    known = won.withColumnRenamed("host", "_host")
    if won.count() <= MAX_HOSTS:  # a path and a host name each: a few MB
        known = F.broadcast(known)
    joined = pages.select("page_id", "url", "html").join(known, host_of("url") == F.col("_host"), "left").select("page_id", "url", "path", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(scan(source.as_py() or ""), path) for path, source in zip(batch.column(2).to_pylist(), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = dict(pages.dtypes)["page_id"]
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("bigint"))
