"""EPUB books: one row per chapter of the spine, titles from the navigation, content cleaned."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from html import escape
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

from folioq.dom.tree import Element, parse
from folioq.operators.batches import sliced

MOST_FILES, MOST_UNPACKED = 3000, 300 << 20
PAGES = ("application/xhtml+xml", "text/html")
#: Elements that stay, attributes that stay, and elements that go with all they hold; fixed values.
KEPT = frozenset("p div span br hr b strong i em u s sub sup small h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre code table thead tbody tfoot tr td th caption img figure figcaption section article a ruby rt rp".split())
ATTRIBUTES = frozenset("alt title colspan rowspan id lang dir".split())
GONE = frozenset("script style head iframe object embed noscript template form".split())
ROW = "bookUrl string, bookTitle string, author string, cover string, index int, id string, path string, title string, html string, chars bigint, problem string"


def safe_join(base: str, href: str) -> str | None:
    """A path within the archive; None if it leads out of it."""
    path = unquote(href.split("#")[0]).replace("\\", "/")
    if path.startswith("/") or re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", path):
        return None
    joined = posixpath.normpath(posixpath.join(base, path))
    return None if joined.startswith("..") or joined == "." else joined


def _all(root: ET.Element, name: str) -> list[ET.Element]:
    return [e for e in root.iter() if e.tag == name or e.tag.rpartition("}")[2] == name]


def cleaned(html: str | Element, folder: str, images: frozenset[str] = frozenset(), rename=lambda p: p) -> str:
    """The body's markup (or its document's) with allowed elements and attributes only; images that the book has, links within the page."""
    document = parse(html) if isinstance(html, str) else html
    body = next((e for e in document.walk() if e.tag == "body"), document)

    def told(node: Element | str) -> str:
        if isinstance(node, str):
            return escape(node, quote=False)
        if node.tag in GONE:
            return ""
        inner = "".join(map(told, node.children))
        if node.tag not in KEPT:
            return inner
        attrs = {k: v for k, v in node.attrs.items() if k in ATTRIBUTES}
        if node.tag == "img":
            path = safe_join(folder, node.attrs.get("src", ""))
            if path not in images:
                return ""
            attrs["src"] = rename(path)
        if node.tag == "a" and node.attrs.get("href", "").startswith("#"):
            attrs["href"] = node.attrs["href"]
        open_ = f"<{node.tag}" + "".join(f' {k}="{escape(v)}"' for k, v in attrs.items()) + ">"
        return open_ if node.tag in ("br", "hr", "img") else f"{open_}{inner}</{node.tag}>"

    return "".join(map(told, body.children)).strip()


def _titles(z: zipfile.ZipFile, items: dict[str, dict], folder: str, spine: ET.Element | None) -> dict[str, str]:
    """Title by path: the EPUB 3 navigation first, then the NCX."""
    out: dict[str, str] = {}
    nav = next((i for i in items.values() if "nav" in i["properties"]), None)
    if nav and nav["path"] in z.namelist():
        document = parse(z.read(nav["path"]).decode("utf-8", "replace"))
        for a in document.walk():
            if a.tag == "a" and (path := safe_join(posixpath.dirname(nav["path"]), a.attrs.get("href", ""))):
                out.setdefault(path, " ".join("".join(a.texts()).split()))
    ncx = items.get(spine.get("toc", "") if spine is not None else "") or next((i for i in items.values() if i["type"] == "application/x-dtbncx+xml"), None)
    if ncx and ncx["path"] in z.namelist():
        for point in _all(ET.fromstring(z.read(ncx["path"])), "navPoint"):
            label, src = next(iter(_all(point, "text")), None), next(iter(_all(point, "content")), None)
            if label is not None and src is not None and (path := safe_join(posixpath.dirname(ncx["path"]), src.get("src", ""))):
                out.setdefault(path, " ".join("".join(label.itertext()).split()))
    return {k: v for k, v in out.items() if v}


def chapters(raw: bytes, namespace: str = "default") -> Iterator[dict]:
    url = "local-epub:" + hashlib.md5(f"{namespace}:file:".encode() + raw).hexdigest()
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
        infos = z.infolist()
        if len(infos) > MOST_FILES or sum(i.file_size for i in infos) > MOST_UNPACKED:
            raise ValueError("too large")
        if any(safe_join("", i.filename) is None for i in infos if not i.is_dir()):
            raise ValueError("a path leads out of the archive")
        opf = next(r.get("full-path") for r in _all(ET.fromstring(z.read("META-INF/container.xml")), "rootfile"))
        package, folder = ET.fromstring(z.read(opf)), posixpath.dirname(opf)
        items = {}
        for i in _all(package, "item"):
            if path := safe_join(folder, i.get("href", "")):
                items[i.get("id", "")] = {"id": i.get("id", ""), "path": path, "type": i.get("media-type", ""), "properties": (i.get("properties") or "").split()}
        spine = next(iter(_all(package, "spine")), None)
        titles, names = _titles(z, items, folder, spine), set(z.namelist())
        text = lambda n: next((t for e in _all(package, n) if (t := "".join(e.itertext()).strip())), None)
        book, author = text("title"), text("creator")
        cover_id = next((m.get("content") for m in _all(package, "meta") if m.get("name") == "cover"), None)
        images = frozenset(i["path"] for i in items.values() if i["type"].startswith("image/") and i["path"] in names)
        ranked = [items[cover_id]["path"]] if cover_id in items else []
        ranked += [i["path"] for i in items.values() if "cover-image" in i["properties"]] + sorted(p for p in images if "cover" in p.lower())
        cover = next((p for p in ranked if p in images), None)
        seen: set[str] = set()
        n = 0
        for ref in _all(spine, "itemref") if spine is not None else []:
            item = items.get(ref.get("idref", ""))
            if not item or item["type"] not in PAGES or item["path"] not in names or item["path"] in seen:
                continue
            seen.add(item["path"])
            page = parse(z.read(item["path"]).decode("utf-8", "replace"))
            heads = (" ".join("".join(e.texts()).split()) for t in ("title", "h1", "h2", "h3") for e in page.walk() if e.tag == t)
            title = titles.get(item["path"]) or next((h for h in heads if h), None) or f"第 {n + 1} 章"
            out = cleaned(page, posixpath.dirname(item["path"]), images)
            yield {"bookUrl": url, "bookTitle": book, "author": author, "cover": cover, "index": n, "id": item["id"], "path": item["path"], "title": title, "html": out, "chars": len(re.sub(r"\s", "", re.sub("<[^>]+>", "", out))), "problem": None}
            n += 1
    except (ValueError, KeyError, StopIteration, zipfile.BadZipFile, ET.ParseError) as e:
        yield {"bookUrl": url, "problem": str(e) or type(e).__name__}


def read(spark: SparkSession, path: str, namespace: str = "default") -> DataFrame:
    """A row per chapter of every .epub file below path; a file that can't be read gives one row with its problem."""
    return imported(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.epub").load(path), namespace)


def imported(files: DataFrame, namespace: str = "default", keep: tuple[str, ...] = ()) -> DataFrame:
    """The same of files (content), wherever they come from; each row has its file's columns `keep` in front."""
    schema = StructType([*(files.schema[c] for c in keep), *_parse_datatype_string(ROW).fields])
    names = [c.split()[0] for c in ROW.split(", ")]
    kinds = [to_arrow_type(f.dataType) for f in schema.fields[len(keep) :]]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found, file = [], []
            for k, raw in enumerate(batch.column(len(keep)).to_pylist()):
                some = list(chapters(raw, namespace))
                found += some
                file += [k] * len(some)
            kept = [batch.column(k).take(pa.array(file, pa.int32())) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array([r.get(n) for r in found], k) for n, k in zip(names, kinds))], names=schema.names)

    return files.select(*keep, "content").mapInArrow(rows, schema)
