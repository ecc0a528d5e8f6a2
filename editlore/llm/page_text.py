"""Main text of web pages by differencing pages with near URLs.

A page becomes lines: the text of its blocks in order. Pages are sorted by host and URL path across the cluster, and each is paired with that
neighbour of the same host whose path shares the longer beginning (the one before, if both share as much). Pages with equal lines that follow one
another are copies: they are one run, its first page is paired with the nearest pages around the run, and all get its text. The longest common subsequence of both
pages' lines is what the site repeats, and is deleted. Markup bounds the method at both ends: lines in menus, headers, footers, sidebars, notices,
adverts, forms, comments and hidden elements go whether or not a neighbour repeats them, and lines of an element that is marked as the article
stay although a neighbour may carry the same passage. Differencing decides on all other lines, also on those beside a marked article.

Runs at the borders of sorted partitions are joined and get their neighbours from other partitions, so that results do not depend on the
partitioning. Null html is empty; a page without lines has an empty text. A null url has an empty host and path and is paired like others. Pages with the
same path and different lines are neighbours like others. A page whose host has nothing but its copies has no neighbour and keeps all unmarked lines.
Copies with other pages between them are different runs.
"""

from __future__ import annotations

import hashlib
import html as html_library
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from editlore.llm import common
from editlore.llm.link_trust import host_of, path_of

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"<]*+"|'[^'<]*+'|[^'"<>]++)*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby",
           "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
_NEVER = {"nav", "footer", "aside", "form", "button", "select", "option", "template", "svg", "canvas", "object", "head", "dialog", "menu", "script", "style", "fieldset", "label"}
_ARTICLE = {"article", "main"}
#: An open element of the first kind ends where one of the second begins.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_PART = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsbygoogle|sponsor(?:ed|s)?|promos?|promotions?|banners?|menu|nav|navbar|navigation|breadcrumbs?|sidebar|footer|header|masthead"
    r"|cookies?|notices?|consent|gdpr|newsletter|subscribe|subscription|comments?|commentlist|disqus|respond|repl(?:y|ies)|social|shar(?:e|ing)|related|recommend(?:ed|ations)?|widgets?"
    r"|popup|modal|overlay|login|signup|search|pagination|pager|toolbar|alerts?|disclaimer)(?:$|[\s_-])", re.I)
_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "status", "toolbar"}

DROP, KEEP, OPEN = 0, 1, 2


def _attributes(text: str) -> dict[str, str]:
    return {name.lower(): a or b or c or "" for name, a, b, c in _ATTRIBUTE.findall(text)}


def _excluded(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    if tag in _NEVER or tag == "header" and not in_article:
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    if attributes.get("role", "").lower() in _ROLE:
        return True
    if tag in ("body", "html", "main", "h1", "h2", "h3", "h4", "h5", "h6"):
        return False
    names = attributes.get("class", "") + " " + attributes.get("id", "")
    if tag == "article":
        return bool(re.search(r"(?:^|[\s_-])(?:comments?|repl(?:y|ies)|ads?|adverts?|related|promos?|sponsored)(?:$|[\s_-])", names, re.I))
    return bool(_PART.search(names))


def page_lines(page: str) -> list[tuple[str, int]]:
    """The page's lines, each with DROP (boilerplate by its markup), KEEP (in a marked article) or OPEN."""
    lines: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, bool]] = []  # element, excluded, in an article
    words: list[str] = []
    at = 0

    def flush() -> None:
        line = " ".join("".join(words).split())
        words.clear()
        if line:
            _, out, inside = stack[-1] if stack else ("", False, False)
            lines.append((line, DROP if out else KEEP if inside else OPEN))

    def close(k: int) -> None:
        flush()
        del stack[k:]

    while match := _TAG.search(page, at):
        if match.start() > at:
            words.append(html_library.unescape(page[at:match.start()]))
        at = match.end()
        tag = (match[2] or match[5] or "").lower()
        if not tag:
            continue
        if match[1] or match[4]:
            names = [name for name, _, _ in stack]
            if tag in names:
                k = len(names) - 1 - names[::-1].index(tag)
                if tag in _INLINE and stack[k][1] == (stack[k - 1][1] if k else False):
                    if k == len(stack) - 1:
                        del stack[k]
                    else:
                        stack[k] = ("", *stack[k][1:])
                else:
                    close(k)
            elif tag not in _INLINE:
                flush()
            continue
        if tag == "br":
            words.append(" ")
            continue
        if tag not in _INLINE:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                name = stack[k][0]
                if name == "p" or tag in _ENDS.get(name, ()):
                    del stack[k:]
                    break
                if name not in _INLINE and name:
                    break
        if tag in _VOID:
            continue
        _, out, inside = stack[-1] if stack else ("", False, False)
        text = match[3] if match[3] is not None else match[6] or ""
        if tag in _RAW:
            if not text.rstrip().endswith("/"):
                end = re.compile(f"</{tag}", re.I).search(page, at)
                at = end.start() if end else len(page)
                if end:
                    last = page.find(">", at)
                    at = last + 1 if last >= 0 else len(page)
            continue
        attributes = _attributes(text) if text.strip() else {}
        gone = out or _excluded(tag, attributes, inside)
        if gone and not out and tag in _INLINE:
            flush()
        begins = tag in _ARTICLE or attributes.get("role", "").lower() == "main" or attributes.get("itemprop", "") == "articleBody"
        stack.append((tag, gone, inside or begins and not gone))
    words.append(html_library.unescape(page[at:]))
    flush()
    return lines


def line_hashes(lines: list[tuple[str, int]]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(line.encode("utf-8", "replace"), digest_size=8).digest(), "little") for line, _ in lines], np.uint64)


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` with every beginning of ``b``."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return row


def common_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which items of ``a`` are in its longest common subsequence with ``b``; by halving, so that memory stays linear."""
    out = np.zeros(len(a), bool)
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out[:head] = True
    out[len(a) - tail:] = True
    rest = np.flatnonzero(np.isin(a[head:len(a) - tail], b[head:len(b) - tail])) + head
    b = b[head:len(b) - tail]
    b = b[np.isin(b, a[rest])]
    todo = [(rest, b)]
    while todo:
        rows, other = todo.pop()
        if not len(rows) or not len(other):
            continue
        if len(rows) == 1:
            out[rows] = a[rows[0]] in other
            continue
        half = len(rows) // 2
        left, right = _lengths(a[rows[:half]], other), _lengths(a[rows[half:]][::-1], other[::-1])[::-1]
        cut = int((left + right).argmax())
        todo += [(rows[:half], other[:cut]), (rows[half:], other[cut:])]
    return out


def _alike(a: str, b: str) -> int:
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def _text(lines: bytes, hashes: bytes, near: bytes | None) -> str:
    """A page's text, given the hashes of the page it is paired with."""
    found = _unpacked(lines)
    if near is None or not any(kind == OPEN for _, kind in found):
        return " ".join(line for line, kind in found if kind != DROP)
    shared = common_lines(np.frombuffer(hashes, np.uint64), np.frombuffer(near, np.uint64)).tolist()
    return " ".join(line for (line, kind), twice in zip(found, shared) if kind == KEEP or kind == OPEN and not twice)


def _nearer(path: str, before: str | None, after: str | None) -> bool:
    """Whether the page before is the nearer one, given the paths of both that are there."""
    return after is None or before is not None and _alike(before, path) >= _alike(after, path)


def _packed(lines: list[tuple[str, int]]) -> bytes:
    import zstandard

    # Lines that go in any case are only needed as hashes.
    return zstandard.ZstdCompressor(level=3).compress(json.dumps([["" if kind == DROP else line, kind] for line, kind in lines], ensure_ascii=False).encode("utf-8", "surrogatepass"))


def _unpacked(data: bytes) -> list[tuple[str, int]]:
    import zstandard

    return [(line, kind) for line, kind in json.loads(zstandard.ZstdDecompressor().decompress(data).decode("utf-8", "surrogatepass"))]


PARSED = "page_id long, url string, host string, path string, hashes binary, lines binary"
DECIDED = ("page_id long, url string, text string, part int, place int, host string, path string, last_path string, hashes binary, lines binary, near_path string, near_hashes binary, "
           "members array<struct<page_id:long,url:string>>")
FIRST, LAST, WHOLE = 0, 1, 2  # places of a run in its partition; a whole partition may be one run
MEMBERS = 500  # pages of a run in a row
TEXT_BYTES = 4_000_000  # of texts in a batch


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.slices(batch, 4):
            found = [page_lines(page) for page in part.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([line_hashes(x).tobytes() for x in found], pa.binary()), pa.array([_packed(x) for x in found], pa.binary())],
                                             names=["page_id", "url", "host", "path", "hashes", "lines"])


_MEMBER = pa.struct([("page_id", pa.int64()), ("url", pa.string())])
_KINDS = {"page_id": pa.int64(), "part": pa.int32(), "place": pa.int32(), "hashes": pa.binary(), "lines": pa.binary(), "near_hashes": pa.binary(), "members": pa.list_(_MEMBER)}
_NAMES = ["page_id", "url", "text", "part", "place", "host", "path", "last_path", "hashes", "lines", "near_path", "near_hashes", "members"]


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _KINDS.get(n, pa.string())) for n in _NAMES], names=_NAMES)


class _Run:
    """Pages with equal lines that follow one another on a host."""

    def __init__(self, row: dict):
        self.host, self.path, self.hashes, self.lines = row["host"], row["path"], row["hashes"], row["lines"]
        self.members: list[dict] = []
        self.add(row)

    def add(self, row: dict) -> None:
        self.last_path = row["path"]
        self.members.append({"page_id": row["page_id"], "url": row["url"]})

    def edge(self, part: int, place: int, near: tuple[str, bytes] | None) -> Iterator[dict]:
        """The rows of a run that waits for a neighbour in another partition and carries the one it has."""
        for k in range(0, len(self.members), MEMBERS):
            yield {"part": part, "place": place, "host": self.host, "path": self.path, "last_path": self.last_path, "hashes": self.hashes, "lines": self.lines,
                   "near_path": near and near[0], "near_hashes": near and near[1], "members": self.members[k:k + MEMBERS]}


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a sorted partition's pages; its first and last run wait for other partitions."""
    part = TaskContext.get().partitionId()
    before: tuple[str, str, bytes] | None = None  # host, last path and hashes of the run before
    run: _Run | None = None
    out: list[dict] = []
    size = 0

    def known(host: str, other: tuple[str, str, bytes]) -> tuple[str, bytes] | None:
        return other[1:] if other[0] == host else None

    def finished(after: _Run) -> Iterator[dict]:
        next_one = known(run.host, (after.host, after.path, after.hashes))
        if before is None:
            yield from run.edge(part, FIRST, next_one)
            return
        prior = known(run.host, before)
        pair = prior if _nearer(run.path, prior and prior[0], next_one and next_one[0]) else next_one
        text = _text(run.lines, run.hashes, pair and pair[1])
        for member in run.members:
            yield member | {"text": text}

    for batch in batches:
        for row in batch.to_pylist():
            if run is not None and (run.host, run.hashes) == (row["host"], row["hashes"]):
                run.add(row)
                continue
            after = _Run(row)
            if run is not None:
                for one in finished(after):
                    out.append(one)
                    size += len(one.get("text") or one.get("lines") or "")
                    if len(out) >= 500 or size > TEXT_BYTES:
                        yield _rows(out)
                        out, size = [], 0
                before = (run.host, run.last_path, run.hashes)
            run = after
    if run is not None:
        for one in run.edge(part, WHOLE if before is None else LAST, before and known(run.host, before)):
            out.append(one)
            if len(out) >= 500:
                yield _rows(out)
                out = []
    yield _rows(out)


def _paired(edges: list[Row]) -> list[tuple[int, int, int, int, bool]]:
    """The page with which each run at a border is paired: part and place of the run, part and place of an edge, and whether it is that edge's
    own page or the neighbour that it carries. ``edges`` are in order; runs without a neighbour are left out."""
    n = len(edges)
    sides: list[list[tuple[int, bool, str] | None]] = []
    paths = [e.path for e in edges]
    for step, inner in ((1, LAST), (-1, FIRST)):
        found: list[tuple[int, bool, str] | None] = [None] * n
        for k in range(n)[::step]:
            e, at = edges[k], k - step
            if e.place == inner:
                # The neighbour on this side lies in the run's own partition.
                found[k] = (k, False, e.near_path) if e.near_path is not None else None
            elif 0 <= at < n and edges[at].host == e.host:
                if edges[at].digest != e.digest:
                    found[k] = (at, True, edges[at].last_path if step == 1 else edges[at].path)
                else:
                    found[k] = found[at]
                    if step == 1:
                        paths[k] = paths[at]
        sides.append(found)
    out = []
    for k, (before, after) in enumerate(zip(*sides)):
        if pair := before if _nearer(paths[k], before and before[2], after and after[2]) else after:
            out.append((edges[k].part, edges[k].place, edges[pair[0]].part, edges[pair[0]].place, pair[1]))
    return out


def _mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            text = _text(row["lines"], row["hashes"], row["pair"])
            ids, urls = zip(*((m["page_id"], m["url"]) for m in row["members"]))
            most = max(1, TEXT_BYTES // max(1, len(text)))
            for k in range(0, len(ids), most):
                some = ids[k:k + most]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(urls[k:k + most], pa.string()), pa.array([text] * len(some), pa.string())], names=["page_id", "url", "text"])


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    parsed = rows.mapInArrow(_parse, PARSED)
    order = ["host", "path", "page_id", "hashes"]
    decided = common.stored(parsed.repartitionByRange(common.partitions(pages.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(_difference, DECIDED))
    edges = decided.filter("part is not null")  # two runs per partition
    ends = edges.select("part", "place", "host", "path", "last_path", F.md5("hashes").alias("digest"), "near_path").dropDuplicates(["part", "place"])
    pairs = pages.sparkSession.createDataFrame(_paired(sorted(ends.collect(), key=lambda e: (e.part, e.place))), "part int, place int, at_part int, at_place int, own boolean")
    carried = edges.select(F.col("part").alias("at_part"), F.col("place").alias("at_place"), F.col("hashes").alias("_own"), F.col("near_hashes").alias("_near")).dropDuplicates(["at_part", "at_place"])
    near = carried.join(F.broadcast(pairs), ["at_part", "at_place"]).select("part", "place", F.when(F.col("own"), F.col("_own")).otherwise(F.col("_near")).alias("pair"))
    mended = edges.join(near, ["part", "place"], "left").select("hashes", "lines", "members", "pair").mapInArrow(_mend, "page_id long, url string, text string")
    return decided.filter("part is null").select("page_id", "url", "text").unionByName(mended).withColumn("n_chars", F.char_length("text").cast("long"))


def op5_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
