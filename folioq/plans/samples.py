"""Files and answers that queries build from the tables. Workers import this module: it needs no session."""

from __future__ import annotations

import io
import zipfile


def epub_file(name: str, brand: str, k: int) -> bytes:
    """A book of three pages, with a navigation that knows one of them."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        put = lambda n, t: z.writestr(zipfile.ZipInfo(n), t)  # noqa: E731  no times: equal books, equal bytes
        put("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        cover = '<meta name="cover" content="im"/>' if k % 2 else ""
        put("O/c.opf", f'<package><metadata><title>{name}</title><creator>{brand}</creator><identifier>{k}</identifier>{cover}</metadata><manifest><item id="a" href="t/a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="t/b.xhtml" media-type="application/xhtml+xml"/><item id="d" href="t/d.xhtml" media-type="text/html"/><item id="im" href="i/p.png" media-type="image/png"/><item id="co" href="i/cover.png" media-type="image/png"/><item id="css" href="s.css" media-type="text/css"/><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/></manifest><spine><itemref idref="b"/><itemref idref="css"/><itemref idref="a"/><itemref idref="b"/><itemref idref="d"/><itemref idref="none"/></spine></package>')
        put("O/nav.xhtml", '<html><body><nav type="toc"><ol><li><a href="t/a.xhtml">From nav</a></li></ol></nav></body></html>')
        put("O/t/a.xhtml", f'<html><head><title>T</title></head><body onload="x()"><script>no</script><h1 class="c">{name}</h1><p style="x">One <b>two</b><img src="../i/p.png" onerror="x"/><img src="http://x/y.png"/></p><a href="#n">in</a><a href="http://out">out</a><font>kept text</font></body></html>')
        put("O/t/b.xhtml", f"<html><head><title>Head {brand}</title></head><body><p>b</p></body></html>")
        put("O/t/d.xhtml", "<html><body><p>d e</p></body></html>")
        put("O/i/p.png", "p")
        put("O/i/cover.png", "c")
        put("O/s.css", "")
    return out.getvalue()


def answer(url: str, method: str, headers: dict, body: bytes | None) -> tuple[int, bytes, str, str]:
    """A server that fails, doesn't find, or answers, by the number in the URL."""
    n = int(url.rpartition("/")[2])
    return (503 if n % 3 == 0 else 404 if n % 3 == 1 else 200), f"body {n}".encode("gb18030"), "text/html; charset=gbk", url + "?final"
