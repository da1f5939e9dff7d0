"""Scalar functions on URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(c: Column) -> Column:
    return F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def root_domain(c: Column) -> Column:
    """The label before the last: example of www.example.org."""
    labels = F.split(host(c), r"\.")
    return F.when(F.size(labels) >= 2, F.get(labels, F.size(labels) - 2))


def cookie_domain(c: Column) -> Column:
    """The registrable domain, nearly: three labels below a two-letter country with a general second label, else two."""
    h = host(c)
    labels = F.split(h, r"\.")
    n = F.size(labels)
    general = F.get(labels, n - 2).isin("com", "net", "org", "gov", "edu", "co") & (F.length(F.get(labels, n - 1)) == 2)
    keep = F.when(general, F.lit(3)).otherwise(F.lit(2))
    return F.when(h.rlike(r"^[\d.]+$") | (n <= keep), h).otherwise(F.array_join(F.slice(labels, n - keep + 1, keep), "."))


def cleaned(c: Column) -> Column:
    """Without control characters (but tab and line ends), trimmed."""
    return F.btrim(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), F.lit(" \t\r\n"))


def repaired(c: Column) -> Column:
    """Encoded ?, &, = and # as such, where a URL has encoded ?, & or =."""
    out = c
    for code, mark in (("%3F", "?"), ("%3f", "?"), ("%26", "&"), ("%3D", "="), ("%3d", "="), ("%23", "#")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return F.when(c.rlike("(?i)%3F|%26|%3D"), out).otherwise(c)


def component(c: Column) -> Column:
    """Percent-encoded as UTF-8, spaces as %20."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(out, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query(c: Column) -> Column:
    """Keys and values encoded, unless something is already."""
    pair = lambda p: F.concat_ws("=", F.transform(F.split(p, "=", 2), component))
    return F.when((c == "") | F.contains(c, F.lit("%")), c).otherwise(F.array_join(F.transform(F.split(c, "&"), pair), "&"))


def page_choice(c: Column, page: Column) -> Column:
    """<a,b,c> by page; further pages get the last."""
    inner = F.regexp_extract(c, "<([^<>]*,[^<>]*)>", 1)
    parts = F.split(inner, ",")
    chosen = F.trim(F.element_at(parts, F.least(F.greatest(page, F.lit(1)), F.size(parts))))
    return F.when(inner == "", c).otherwise(F.replace(c, F.concat(F.lit("<"), inner, F.lit(">")), chosen))


def placeholders(c: Column, key: Column, page: Column) -> Column:
    out = c
    for mark, value in (("{{key}}", key), ("{{page}}", page.cast("string")), ("{key}", key), ("{page}", page.cast("string")), ("searchKey", key), ("searchPage", page.cast("string"))):
        out = F.replace(out, F.lit(mark), value)
    return out


def resolved(base: Column, link: Column) -> Column:
    """Absolute, protocol-relative and root-relative links, non-ASCII encoded; other relative links below the base's folder."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    joined = F.when(link == "", base).when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(F.startswith(link, F.lit("//")), F.concat(F.lit("https:"), link))
    joined = joined.when(F.startswith(link, F.lit("/")), F.concat(origin, link)).otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), link))
    return joined


def page_stem(c: Column) -> Column:
    """A path without the number of a further page: -N or _N, N of 2 or more, before the extension."""
    return F.regexp_replace(c, r"[-_](?:[2-9]|[1-9]\d+)(\.\w+)?/?$", "$1")


def next_page_follows(first: Column, link: Column) -> Column:
    """Whether link is a further page of the text at first: scheme, host and port the same, and the path but for the page's number."""
    place = lambda c: F.lower(F.regexp_extract(c, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1))
    numbered = path(link).rlike(r"[-_](?:[2-9]|[1-9]\d+)(\.\w+)?/?$")
    asked = lambda c: F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1)
    same = path(first) == path(link)
    stem = page_stem(path(link))
    return (place(first) == place(link)) & F.when(same, asked(first) != asked(link)).otherwise(numbered & ((stem == page_stem(path(first))) | (stem == path(first))))


#: Extensions and their content types, fixed values.
TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "svg": "image/svg+xml", "ico": "image/x-icon"}


def extension(c: Column, default: str = "jpg") -> Column:
    """The extension of a URL's path in lower case, if it is one of a medium."""
    found = F.lower(F.regexp_extract(path(c), r"\.([A-Za-z0-9]{1,5})$", 1))
    return F.when(found.isin(*TYPES), found).otherwise(F.lit(default))


def content_type(ext: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in TYPES.items() for x in (k, v)]), ext), F.lit("application/octet-stream"))
