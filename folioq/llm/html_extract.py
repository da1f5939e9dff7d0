"""Main text of web pages by nearest-URL page differencing.

A page is cut into lines (its blocks, white space as one space). Markup says much: scripts, styles, forms, menus, page
headers and footers, sidebars, adverts, notices and comments, by element, role or class name, are no lines at all, and
where a page marks its article, lines outside it aren't either. What markup leaves open, other pages tell: pages are
sorted by host and URL path, and each is aligned with the pages of its host whose paths are nearest (its mates: up to
MATES of different lines, looked for among LOOK runs of equal pages on either side) by the longest common subsequence of
their lines.

- On a page that marks no article, the lines shared with the nearest mate are deleted, unless that mate is a copy: it
  shares most of what isn't shared with several mates (which is the site's, not the page's). Then the next one is taken.
- In a marked article, a line is deleted if MATES pages that are no copies all have it: a notice within the article. As
  an article that several pages carry is still each one's article, none is if such lines are over a quarter of it.
- Where nothing would be left, nothing is deleted.

A host's pages never meet in one task: the sorted order is cut at keys from all pages, into parts that grow in number
with the pages, and the last and first few pages on either side of a cut are sent across it as well. Pages of one URL
follow their ids; a null URL counts as an empty one, a null page as an empty page, with empty text. Repeated rows are
pages of their own. An empty table gives no rows. The output has page_id, url, text and n_chars, whatever else the input
has. Very long pages are aligned by divide and conquer, in bounded memory.
"""

from __future__ import annotations

import bisect
import collections
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from folioq.llm.common import partitions, table

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^<>]*+)>""", re.S)
NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|itemprop|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
RAW = frozenset("script style textarea title noscript iframe xmp template svg".split())
SKIP = frozenset("head nav footer aside form button select option dialog menu fieldset datalist header".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt td th figcaption li article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: What a class name or id names that is no main text: its last word, once general ones are left out; fixed values.
AWAY = frozenset("ad ads advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion sidebar rail nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar comment comments commentlist disqus respond replies cookie cookies consent gdpr notice notices notification alert disclaimer popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget toolbar pagination pager skiplink copyright".split())
#: Words that say where or how, not what, and words before a name that say something about the page; fixed values.
GENERAL = frozenset("area container wrapper wrap box list section block bar inner outer panel region zone holder row group item items link links form icon icons button buttons content text left right top bottom main wide small large fixed".split())
ABOUT = frozenset("has no not with without is js hide show enable disable page layout single body".split())
#: A header's class or id is the page's if it has no part but these, fixed values.
TOP = frozenset("header head top site page main global web wrapper container bar inner".split())
HERE = frozenset("article articlebody maincontent entrycontent postcontent storybody".split())
COPY, MATES, LOOK, GHOSTS, PART = 0.6, 4, 16, 8, 0.25
PARTS = 4  # to an input partition, at least
BITS = 1 << 28  # of an alignment's rows at a time
LINE = tuple[str, bool]  # the text, and whether it stands in a marked article


@dataclass
class _Open:
    name: str
    away: bool
    article: bool
    main: bool = False


def _names_away(parts: list[str]) -> bool:
    """Whether a class name like cookie-notice or comments-area names no main text; has-sidebar and related-work don't."""
    if not parts or len(parts) > 1 and parts[0] in ABOUT:
        return False
    kept = list(parts)
    while len(kept) > 1 and kept[-1] in GENERAL:
        kept.pop()
    return kept[-1] in AWAY


def _attributes(raw: str) -> tuple[bool, bool]:
    """Whether an element's attributes rule it out, and whether they mark the article."""
    away = article = False
    for m in NAMED.finditer(raw):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name in ("class", "id"):
            for token in value.split():
                parts = [x for x in re.split(r"[^a-z0-9]+", token) if x]
                away = away or _names_away(parts) or "header" in parts and TOP.issuperset(parts)
                article = article or not HERE.isdisjoint([*parts, *("".join(x) for x in zip(parts, parts[1:]))])
        elif name == "role":
            away, article = away or value in ROLES, article or value in ("main", "article")
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            away = True
        elif name == "itemprop":
            article = article or value == "articlebody"
        elif name == "style":
            away = away or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) is not None
    return away, article


def lines(html: str) -> list[LINE]:
    """The page's lines in order; those of the article only, where markup shows one.

    An element that is ruled out by its class, but holds the page's only article, is none to rule out.
    """
    found, hidden = _parsed(html, False)
    if hidden and not any(where for _, _, where in found):
        found = _parsed(html, True)[0]
    sizes = [sum(len(t) for t, _, where in found if where >= level) for level in (1, 2)]
    if sizes[0]:
        # an article within the main part is meant, unless it's a small part of it
        level = 2 if 5 * sizes[1] >= 2 * sizes[0] else 1
        return [(t, p) for t, p, where in found if where >= level]
    return [(t, False) for t, _, _ in found]


def _parsed(html: str, trusting: bool) -> tuple[list[tuple[str, bool, int]], bool]:
    """Lines (text, prose, whether in the main part (1) or the article (2)), and whether an article lies in what is left out.

    trusting: an article's start ends whatever is left out around it.
    """
    found: list[tuple[str, bool, int]] = []
    text: list[str] = []
    stack: list[_Open] = []
    away = article = main = 0
    prose = hidden = False

    def close() -> None:
        nonlocal prose
        if text:
            line = " ".join(unescape("".join(text)).split())
            if line:
                found.append((line, prose, 2 if article else 1 if main else 0))
            text.clear()
        prose = False

    at, end = 0, len(html)
    while at < end:
        m = TAG.search(html, at)
        if not away:
            piece = html[at : m.start() if m else end]
            if piece:
                text.append(piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, raw = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW:
            if not closing and not raw.endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(html, at)
                at = stop.end() if stop else end
            continue
        if name == "br" or name == "img":
            if not away:
                text.append(" ")
            continue
        if name not in BLOCKS and name not in SKIP:
            top = stack[-1] if stack else None
            if closing:
                if top and top.name == name:
                    stack.pop()
                    away -= top.away
            elif name not in VOID and not raw.endswith("/"):
                gone = bool(raw) and not away and _attributes(raw)[0]
                if gone or away and top and top.name == name:  # one within another of its name, so that its end isn't taken for the outer one's
                    stack.append(_Open(name, gone, False))
                    away += gone
            continue
        if closing:
            if name != "p" and any(o.name == name for o in stack):
                close() if not away else None
                while True:
                    o = stack.pop()
                    away, article, main = away - o.away, article - o.article, main - o.main
                    if o.name == name:
                        break
            elif not away:
                close()
            continue
        if not away:
            close()
            prose = name in PROSE
        if name == "p" or name in VOID:
            if name == "p" and raw and not away and _attributes(raw)[0]:
                # a paragraph that is an advert or a notice ends with the paragraph
                stop = re.compile(r"</p\b[^>]*>|<(?=/?(?:p|div|article|section|main|body|ul|ol|table|h[1-6])\b)", re.I).search(html, at)
                at = (stop.end() if html[stop.start() + 1] == "/" and stop.group().lower().startswith("</p") else stop.start()) if stop else end
            continue
        gone, marked = _attributes(raw) if raw else (False, False)
        marked = marked or name == "article"
        gone = (gone or name in SKIP) and name not in ("html", "body", "main") and not (name == "header" and (article or main) and not gone)
        if name in ("h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "dd", "dt") and not gone:
            if away:
                stack.append(_Open(name, False, False))
            continue
        hidden = hidden or bool(away) and name == "article"
        if away and (name == "main" or trusting and name == "article" and not gone):
            # no menu or header holds the main part: what is open has lost its end, or its name misleads
            stack.clear()
            away = article = main = 0
        stack.append(_Open(name, gone, marked and not gone, name == "main"))
        away, article, main = away + gone, article + (marked and not gone), main + (name == "main")
    if not away:
        close()
    return found, hidden


def _zeros(xs: list[str], ys: list[str], rows: list[int] | None = None) -> np.ndarray:
    """Lengths of the longest common subsequences of xs with each ys[:k], by bit-parallel rows (kept in `rows`)."""
    places: dict[str, int] = {}
    for k, y in enumerate(ys):
        places[y] = places.get(y, 0) | 1 << k
    full = row = (1 << len(ys)) - 1
    for x in xs:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        if rows is not None:
            rows.append(row)
    # a zero bit k: the subsequence with ys[:k+1] is longer than with ys[:k]
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(ys) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(ys)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _aligned(xs: list[str], ys: list[str]) -> list[int]:
    """Positions in xs of a longest common subsequence with ys; halves xs where its rows would take too much memory."""
    if not xs or not ys:
        return []
    if len(xs) * len(ys) > BITS and len(xs) > 1:
        half = len(xs) // 2
        k = int((_zeros(xs[:half], ys) + _zeros(xs[half:][::-1], ys[::-1])[::-1]).argmax())
        return _aligned(xs[:half], ys[:k]) + [half + i for i in _aligned(xs[half:], ys[k:])]
    rows: list[int] = []
    _zeros(xs, ys, rows)
    out, k = [], len(ys) - 1
    for i in range(len(xs) - 1, -1, -1):
        while k >= 0 and rows[i] >> k & 1:
            k -= 1
        if k < 0:
            break
        if i == 0 or rows[i - 1] >> k & 1:
            out.append(i)
            k -= 1
    return out


def shared(a: list[str], b: list[str]) -> set[int]:
    """Positions in a of a longest common subsequence with b."""
    both = set(a) & set(b)
    ia = [k for k, x in enumerate(a) if x in both]
    return {ia[i] for i in _aligned([a[k] for k in ia], [x for x in b if x in both])}


def without_shared(page: list[LINE], mates: list[list[str]]) -> str:
    """The page's text less what its mates (other pages' lines, the nearest first) show not to be its own."""
    own = [t for t, _ in page]
    size = lambda some: sum(len(own[k]) for k in some)
    common = [shared(own, m) for m in mates]
    votes = collections.Counter(k for c in common for k in c)
    usual = {k for k, n in votes.items() if n > 1}
    rest = size(range(len(own))) - size(usual)
    apart = [c for c in common if len(common) == 1 or size(c - usual) <= COPY * rest]
    gone: set[int] = set()
    if apart:
        gone = {k for k in apart[0] if not page[k][1]}
    if len(apart) >= MATES:
        notices = {k for k in set.intersection(*apart) if page[k][1]}
        if size(notices) <= PART * size(k for k, (_, stays) in enumerate(page) if stays):
            gone |= notices
    return " ".join(own if len(gone) == len(own) else [t for k, t in enumerate(own) if k not in gone])


def _near(path: str, other: str) -> int:
    """How many leading parts two paths share."""
    n = 0
    for x, y in zip(path.split("/"), other.split("/")):
        if x != y:
            break
        n += 1
    return n


KEY = ("host", "path", "link", "nul", "num")


def _keyed(df: DataFrame) -> DataFrame:
    """df (page_id, url, html) with the columns of KEY, which order all pages."""
    parts = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)([^?#]*)"
    link = F.coalesce("url", F.lit(""))
    return df.select("page_id", "url", "html", F.lower(F.regexp_extract(link, parts, 1)).alias("host"), F.regexp_extract(link, parts, 2).alias("path"), link.alias("link"), F.col("page_id").isNull().alias("nul"), F.coalesce(F.col("page_id").cast("long"), F.lit(0)).alias("num"))


class _Run:
    """Pages that follow one another and have equal lines."""

    def __init__(self, page: list[LINE], digest: int):
        self.page, self.texts, self.digest, self.rows = page, [t for t, _ in page], digest, []


def _mates(run: _Run, before: list[_Run], after: list[_Run], path: str) -> list[list[str]]:
    """Up to MATES runs of other lines: the nearest by path, then by place."""
    near, seen = [], {run.digest}
    for place, other in sorted([(k, x) for k, x in enumerate(reversed(before))] + [(k, x) for k, x in enumerate(after)], key=lambda y: y[0]):
        if other.digest not in seen:
            seen.add(other.digest)
            near.append((-_near(path, other.rows[0]["path"]), place, len(near), other))
    return [x.texts for *_, x in sorted(near, key=lambda y: y[:3])[:MATES]]


def extract(df: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page of df (page_id, url, html)."""
    spark = df.sparkSession
    pages = _keyed(df)
    n = max(2, partitions(spark), PARTS * pages.rdd.getNumPartitions())
    key = F.struct(*KEY)
    # cut points: keys that a hash picks, one of each of 8 n classes over all pages; every eighth of them in order
    light = pages.select(*KEY).withColumn("pick", F.xxhash64("link", "num", F.lit(7)))
    picks = sorted(tuple(r["k"]) for r in light.groupBy(F.pmod("pick", F.lit(8 * n))).agg(F.min_by(key, "pick").alias("k")).collect())
    cuts = picks[8::8]

    def edged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[int, list] = collections.defaultdict(list)
        last: dict[int, list] = collections.defaultdict(list)
        for batch in batches:
            for k in zip(*(batch.column(c).to_pylist() for c in range(len(KEY)))):
                part = bisect.bisect_right(cuts, k)
                if len(first[part]) < GHOSTS or k < first[part][-1]:
                    bisect.insort(first[part], k)
                    del first[part][GHOSTS:]
                if len(last[part]) < GHOSTS or k > last[part][0]:
                    bisect.insort(last[part], k)
                    del last[part][:-GHOSTS]
        rows = [(*k, part) for part in first for k in {*first[part], *last[part]}]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int32()))], names=[*KEY, "part"])

    kinds = [pages.schema[c] for c in KEY]
    edges: dict[int, list] = collections.defaultdict(list)
    found = pages.select(*KEY).mapInArrow(edged, StructType([*kinds, StructField("part", IntegerType())]))
    ends = F.array_sort(F.collect_set(key))
    for x in found.groupBy("part").agg(F.slice(ends, 1, GHOSTS).alias("a"), F.slice(F.reverse(ends), 1, GHOSTS).alias("b")).collect():  # at most 2 GHOSTS keys for each of n + 1 parts
        edges[x["part"]] = [tuple(x["a"][-1]), tuple(x["b"][-1])]
    order = sorted(edges)
    until, since = {k: v[0] for k, v in edges.items()}, {k: v[1] for k, v in edges.items()}
    before, after = dict(zip(order[1:], order)), dict(zip(order, order[1:]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: collections.Counter = collections.Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out: list[tuple] = []
                for page_id, url, html, *k in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    k = tuple(k)
                    part = bisect.bisect_right(cuts, k)
                    page = lines(html or "")
                    texts, stays = [t for t, _ in page], [s for _, s in page]
                    digest = xxhash.xxh64_intdigest("\n".join(texts)) >> 1
                    row = (page_id, url, *k, texts, stays, digest)
                    out.append((*row, part, False))
                    for other, near in ((after, k >= since[part]), (before, k <= until[part])):
                        # of rows with equal keys a task sends a few: the others are no mates of different lines
                        if near and part in other and sent[part, other[part], k] < GHOSTS:
                            sent[part, other[part], k] += 1
                            out.append((*row, other[part], True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow)], names=names)

    fields = [pages.schema["page_id"], pages.schema["url"], *kinds, StructField("lines", ArrayType(StringType())), StructField("stays", ArrayType(BooleanType())), StructField("digest", LongType()), StructField("part", IntegerType()), StructField("ghost", BooleanType())]
    from pyspark.sql.pandas.types import to_arrow_schema

    made = to_arrow_schema(StructType(fields))
    arrow, names = list(made.types), made.names
    rows = pages.mapInArrow(read, StructType(fields)).repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", *KEY, "digest")
    id_type = made.field("page_id").type

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted; each run of equal pages is told from the runs around it."""

        def told(done: list[tuple[dict, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x["page_id"] for x, _ in done], id_type), pa.array([x["url"] for x, _ in done], pa.string()), pa.array([t for _, t in done], pa.string()), pa.array([len(t) for _, t in done], pa.int64())], names=["page_id", "url", "text", "n_chars"])

        def run_texts(runs: list[_Run], k: int) -> list[tuple[dict, str]]:
            texts: dict[str, str] = {}
            out = []
            for x in runs[k].rows:
                if x["ghost"]:
                    continue
                if x["path"] not in texts:
                    texts[x["path"]] = without_shared(runs[k].page, _mates(runs[k], runs[max(0, k - LOOK) : k], runs[k + 1 : k + 1 + LOOK], x["path"]))
                out.append((x, texts[x["path"]]))
            return out

        runs: list[_Run] = []  # of one part and host
        at, place = 0, None  # the next run to tell
        for batch in batches:
            for r in range(batch.num_rows):
                x = {name: batch.column(c)[r].as_py() for c, name in enumerate(names)}
                page, texts = list(zip(x.pop("lines"), x.pop("stays"))), x["digest"]
                if (x["part"], x["host"]) != place:
                    for k in range(at, len(runs)):
                        yield told(run_texts(runs, k))
                    runs, at, place = [], 0, (x["part"], x["host"])
                if not runs or runs[-1].digest != texts:
                    runs.append(_Run(page, texts))
                runs[-1].rows.append(x)
                if len(runs) > at + LOOK + 1:
                    yield told(run_texts(runs, at))
                    at += 1
                    if at > 4 * LOOK:
                        runs, at = runs[at - LOOK :], LOOK
        for k in range(at, len(runs)):
            yield told(run_texts(runs, k))

    return rows.mapInArrow(compared, StructType([pages.schema["page_id"], pages.schema["url"], StructField("text", StringType()), StructField("n_chars", LongType())]))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
