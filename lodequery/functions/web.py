"""Addresses, pages, charsets and robots rules: the parts that need a parser, for use over distinct values."""

from __future__ import annotations

import codecs
import re
from html.parser import HTMLParser
from urllib.parse import parse_qsl, quote, quote_plus, urljoin, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodequery.functions.clean import MAX_DESCRIPTION, MAX_TITLE, block_text, inline_text

# Limits, tracking parameters and their prefixes.
MAX_URL, MAX_LINKS, META_BYTES = 2048, 1000, 1024
TRACKING = (
    "gclid dclid gbraid wbraid fbclid msclkid yclid twclid ttclid igshid mc_cid mc_eid _hsenc _hsmi hsctatracking "
    "vero_id vero_conv oly_anon_id oly_enc_id s_kwcid ef_id _openstat"
).split()
TRACKING_PREFIXES = ("utm_", "pk_", "piwik_", "matomo_", "mtm_")
AGENT = "lodequerybot"
_PORTS = {"http": 80, "https": 443}


def is_tracking(name: str) -> bool:
    low = name.lower()
    return low in TRACKING or low.startswith(TRACKING_PREFIXES)


def _dot_segments(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:]
    for k, part in enumerate(parts):
        plain = part.lower().replace("%2e", ".")
        if plain == "..":
            if out:
                out.pop()
            if k == len(parts) - 1:
                out.append("")
        elif plain == ".":
            if k == len(parts) - 1:
                out.append("")
        else:
            out.append(part)
    return "/" + "/".join(out)


def parse_url(value: str | None, base: str | None = None) -> tuple[str, str, int | None, str, str] | None:
    """``(scheme, host, port, path, query)`` of an http address; None for anything else or over-long."""
    if value is None or len(value) > MAX_URL:
        return None
    text = re.sub(r"[\t\n\r]", "", value.strip("".join(map(chr, range(33)))))
    try:
        text = text.replace("\\", "/") if re.match(r"(?i)https?:|[/\\]", text) else text
        whole = urljoin(base, text) if base else text
        m = re.match(r"(?i)(https?):/*(.*)$", whole, re.S)
        if not m:
            return None
        parts = urlsplit(f"{m[1].lower()}://{m[2]}")
        host = (parts.hostname or "").lower()
        if not host or re.search(r"[\x00-\x20#%/:<>?@\[\\\]^|]", host.strip("[]") if host.startswith("[") else host):
            return None
        if not host.isascii():
            host = host.encode("idna").decode("ascii")
        port = parts.port
    except (ValueError, UnicodeError):
        return None
    path = quote(_dot_segments(parts.path or "/"), safe="/%:@!$&'()*+,;=-._~[]|^")
    return parts.scheme, host, None if port == _PORTS[parts.scheme] else port, path, parts.query


def normalize_url(value: str | None, base: str | None = None) -> str | None:
    """One spelling of an http address: no fragment, credentials or tracking; parameters in order."""
    parsed = parse_url(value, base)
    if parsed is None:
        return None
    scheme, host, port, path, query = parsed
    named = [(k, v) for k, v in parse_qsl(query, keep_blank_values=True, encoding="utf-8", errors="replace") if k and not is_tracking(k)]
    named.sort(key=lambda x: (x[0].encode("utf-16-be", "surrogatepass"), x[1].encode("utf-16-be", "surrogatepass")))
    text = "&".join(f"{_form(k)}={_form(v)}" for k, v in named)
    out = f"{scheme}://{host}{f':{port}' if port is not None else ''}{path}{'?' + text if text else ''}"
    return out if len(out) <= MAX_URL else None


def _form(text: str) -> str:
    return quote_plus(text, safe="*").replace("~", "%7E")


@F.pandas_udf(StringType())
def normalize_url_udf(urls: pd.Series) -> pd.Series:
    return urls.map(normalize_url)


# -- charset ----------------------------------------------------------------

_META = re.compile(rb"<meta\b[^>]*?\bcharset\s*=\s*[\"']?\s*([a-z0-9_\-:.+]+)", re.I)


def charset_of_header(header: str | None) -> str | None:
    m = re.search(r";\s*charset\s*=\s*\"?([^\";]+)\"?", header or "", re.I)
    return (m[1].strip().lower() or None) if m else None


def _codec(label: str | None) -> str | None:
    name = (label or "").strip().lower()
    if name in ("iso-8859-1", "latin1", "ascii", "us-ascii"):
        return "cp1252"  # as web pages mean it
    try:
        return codecs.lookup(name).name if name else None
    except LookupError:
        return None


def decode_body(body: bytes, header: str | None = None) -> tuple[str, str, str]:
    """``(text, charset, source)``: byte-order mark, then header, then the page's own word, then UTF-8."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace"), name, "bom"
    head = re.sub(rb"<!--[\s\S]*?-->", b" ", body[:META_BYTES]).split(b"<!--")[0]
    meta = _META.search(head)
    for label, source in ((header, "header"), (meta[1].decode("latin-1") if meta else None, "meta")):
        codec = _codec(label)
        if codec:
            return body.decode(codec, "replace"), codec, source
    return body.decode("utf-8", "replace"), "utf-8", "default"


# -- pages ------------------------------------------------------------------

# Elements without an end, those that break lines, and those that are never content.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_NEVER = set("script style noscript template iframe object embed svg canvas form button input select textarea nav aside".split())
_NEVER_ROLES = set("navigation banner contentinfo search".split())
_RAW = {"script", "style", "textarea", "title"}
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"},
}
_SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


class Node:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []

    def walk(self):
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                todo += reversed(node.children)
        return "".join(out)


class _Tree(HTMLParser):
    """A tree good enough for scoping, removal and line breaks; ends that are implied are supplied."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        closes = _CLOSES.get(tag) or ({"p"} if tag in _BLOCK else set())
        stop = _SCOPES.get(tag, set())
        for k in range(len(self.open) - 1, 0, -1):
            name = self.open[k].name
            if name in closes:
                del self.open[k:]
                break
            if name in stop or (name in _BLOCK and name not in ("p", "li", "dt", "dd", "tr", "td", "th")):
                break
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def html_tree(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _never(node: Node, scoped: bool) -> bool:
    a = node.attrs
    return (
        node.name in _NEVER
        or "hidden" in a
        or a.get("aria-hidden") == "true"
        or a.get("role") in _NEVER_ROLES
        or (not scoped and node.name in ("header", "footer"))
    )


def _collect(root: Node, scoped: bool) -> str:
    out: list[str] = []
    todo: list = [root]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        if node is not root and _never(node, scoped):
            continue
        if node.name == "br":
            out.append("\n")
            continue
        if node.name in _BLOCK:
            out.append("\n")
            todo.append("\n")
        todo += reversed(node.children)
    return "".join(out)


def _directives(nodes: list[Node], agent: str) -> tuple[bool, bool]:
    said = {"robots": "", agent: ""}
    for n in nodes:
        name = n.attrs.get("name", "").strip().lower()
        if n.name == "meta" and name in said and "content" in n.attrs:
            said[name] += "," + n.attrs["content"].lower()
    words = {w.strip() for w in (said[agent] or said["robots"]).split(",")}
    return bool(words & {"none", "noindex"}), bool(words & {"none", "nofollow"})


def parse_html(html: str | None, page_url: str, agent: str = AGENT) -> dict | None:
    """Url, canonical url, title, text, language, description, links and directives of a page; None without a usable url."""
    url = normalize_url(page_url)
    if url is None:
        return None
    root = html_tree(html or "")
    nodes = list(root.walk())

    def first(name: str, *having: str) -> Node | None:
        return next((n for n in nodes if n.name == name and all(h in n.attrs for h in having)), None)

    base = first("base", "href")
    base_url = url
    if base is not None and parse_url(base.attrs["href"], url):
        base_url = urljoin(url, base.attrs["href"])
    noindex, nofollow = _directives(nodes, agent)
    links: dict[str, None] = {}
    for n in nodes if not nofollow else ():
        if n.name == "a" and n.attrs.get("href") and "nofollow" not in n.attrs.get("rel", "").lower().split():
            link = normalize_url(n.attrs["href"], base_url)
            if link and link != url and len(links) < MAX_LINKS:
                links.setdefault(link)
    heading = first("title")
    title = heading.text() if heading is not None else ""
    if not title:
        heading = first("h1")
        title = heading.text() if heading is not None else ""
    said = next((n for n in nodes if n.name == "meta" and n.attrs.get("name") == "description" and "content" in n.attrs), None) or next(
        (n for n in nodes if n.name == "meta" and n.attrs.get("property") == "og:description" and "content" in n.attrs), None
    )
    described = inline_text(said.attrs["content"], MAX_DESCRIPTION) if said is not None else ""
    lang = next((n.attrs.get("lang", "") for n in nodes if n.name == "html"), "").strip().lower()
    canonical = next((n for n in nodes if n.name == "link" and "canonical" in n.attrs.get("rel", "").lower().split()), None)
    mains = [n for n in nodes if n.name == "main" or n.attrs.get("role") == "main"]
    articles = [n for n in nodes if n.name == "article"]
    scope = mains[0] if len(mains) == 1 else articles[0] if len(articles) == 1 else None
    body = scope or first("body") or root
    return {
        "url": url,
        "canonical_url": normalize_url(canonical.attrs["href"], base_url) if canonical is not None and canonical.attrs.get("href") else None,
        "title": inline_text(title, MAX_TITLE),
        "text": block_text(_collect(body, scope is not None)),
        "lang": lang if re.fullmatch(r"[a-z]{1,8}(-[a-z0-9]{1,8})*", lang) else None,
        "description": described or None,
        "links": list(links),
        "noindex": noindex,
        "nofollow": nofollow,
    }


PAGE_SCHEMA = (
    "url string, canonical_url string, title string, text string, lang string, description string, links array<string>, noindex boolean, nofollow boolean"
)


def parse_pages(pages):
    """Parsed pages of ``url, html``; pages without a usable url are left out."""

    def run(batches):
        for batch in batches:
            rows = [parse_html(h, u) for u, h in zip(batch["url"], batch["html"], strict=True)]
            yield pd.DataFrame([r for r in rows if r], columns=[c.split()[0] for c in PAGE_SCHEMA.split(", ")])

    return pages.select("url", "html").mapInPandas(run, PAGE_SCHEMA)


# -- robots -----------------------------------------------------------------


def parse_robots(text: str, agent: str = AGENT) -> dict:
    """``rules`` (allow, path pattern), ``delay`` in seconds and ``sitemaps`` that hold for ``agent``."""
    groups: list[tuple[list[str], list[tuple[bool, str]], list[float]]] = []
    sitemaps, fresh = [], False
    for line in text.splitlines():
        key, _, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "sitemap" and value:
            sitemaps.append(value)
        elif key == "user-agent":
            if not fresh:
                groups.append(([], [], []))
            groups[-1][0].append(value.lower())
            fresh = True
        elif groups and key in ("allow", "disallow", "crawl-delay"):
            fresh = False
            if key == "crawl-delay":
                try:
                    groups[-1][2].append(float(value))
                except ValueError:
                    pass
            elif value:
                groups[-1][1].append((key == "allow", value))
    mine = [g for g in groups if agent in g[0]] or [g for g in groups if "*" in g[0]]
    return {"rules": [r for g in mine for r in g[1]], "delay": next((d for g in mine for d in g[2]), None), "sitemaps": sitemaps}


def robots_pattern(path: str) -> str:
    """A path pattern as a regular expression; ``*`` is anything, a final ``$`` the end."""
    end = path.endswith("$")
    return "^" + ".*".join(re.escape(p) for p in path.removesuffix("$").split("*")) + ("$" if end else "")


def robots_allow(path: str, rules: list[tuple[bool, str]]) -> bool:
    """The longest pattern that fits decides; an allow wins among equals; without one all is allowed."""
    fits = [(len(p), allow) for allow, p in rules if re.match(robots_pattern(p), path)]
    return max(fits)[1] if fits else True
