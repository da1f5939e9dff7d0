"""Resolving links, and what compares two of them."""

from __future__ import annotations

import re
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

_SAFE = "!#$%&'()*+,/:;=?@[]~-._"
_ENCODED = re.compile(r"[A-Za-z0-9" + re.escape(_SAFE) + "]*")
_CONTROLS = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def encoded(url: str) -> str:
    """Characters beyond ASCII, spaces and quotes as %XX; what is encoded stays."""
    return url if _ENCODED.fullmatch(url) else quote(url, safe=_SAFE)


def cleaned(url: str) -> str:
    """Control characters out (but tab and line ends), trimmed, cut where options begin."""
    url = _CONTROLS.sub("", url).strip()
    for mark in ("##$##", ",{'webView'"):
        url = url.split(mark)[0]
    return url


def resolve(base: str, url: str) -> str:
    """An absolute URL; an empty one is the base, // gets https."""
    url, base = cleaned(url or ""), cleaned(base or "").split("#")[0]
    if not url:
        return base
    if url.startswith("//"):
        return encoded("https:" + url)
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", url):
        return encoded(url)
    if not re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://", base):
        return url
    joined = urlsplit(urljoin(base, url))
    return encoded(urlunsplit(joined._replace(path=joined.path or "/")))


def page_stem(path: str) -> tuple[str, int | None]:
    """A content path without -N or _N (N of 2 or more) before its extension, and N."""
    m = re.fullmatch(r"(.*?)[-_]([2-9]|[1-9]\d+)(\.\w+)?/?", path)
    return (m[1] + (m[3] or ""), int(m[2])) if m else (path.rstrip("/") or path, None)


def next_page_follows(first: str, link: str) -> bool:
    """Whether link is a further page of the text at first: same place, and the same path but for the page's number."""
    a, b = urlsplit(first), urlsplit(link)
    if (a.scheme, a.hostname, a.port) != (b.scheme, b.hostname, b.port):
        return False
    stem, page = page_stem(b.path)
    own, own_page = page_stem(a.path)
    if a.path == b.path:
        return a.query != b.query
    return page is not None and page >= 2 and stem in (own, a.path)
