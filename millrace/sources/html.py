"""One-pass HTML extraction: each page is parsed once and gives one struct with every field."""

from __future__ import annotations

import json
import re
from urllib.parse import urljoin

import pandas as pd

from ..functions.lazy import arrow_udf, paged_udf
from ..functions.text import STOP_PATTERNS
from .dom import BLOCKS as _BLOCKS
from .dom import Node, parse

LEAST_BODY, LEAST_RETENTION = 200, 0.95
_NOISE = frozenset("script style nav footer header aside noscript".split())
_TECHNICAL = frozenset("script style noscript template svg iframe".split())
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_STOP = re.compile("|".join(f"(?:{p})" for p in STOP_PATTERNS), re.I)
_PROVIDERS = (("youtube", ("youtube.com", "youtu.be")), ("vimeo", ("vimeo.com",)), ("loom", ("loom.com",)), ("wistia", ("wistia",)), ("brightcove", ("brightcove",)))

SCHEMA = (
    "title string, description string, author string, lang string, published string, image string, body string, markdown string, retention double,"
    " headings array<string>, paragraphs array<string>, lists array<array<string>>, tables array<array<array<string>>>, code array<string>, quotes array<string>,"
    " links array<struct<text:string,url:string,title:string>>, images array<struct<src:string,alt:string,caption:string,width:int,height:int>>,"
    " videos array<struct<src:string,title:string,thumbnail:string,type:string>>,"
    " search_form struct<action:string,input:string,hidden:map<string,string>>, next_page string"
)


def _meta(root: Node) -> dict[str, str]:
    out: dict[str, str] = {}
    for n in root.all("meta"):
        name = (n.attrs.get("name") or n.attrs.get("property") or n.attrs.get("itemprop") or n.attrs.get("http-equiv") or "").lower()
        if name and n.attrs.get("content"):
            out.setdefault(name, n.attrs["content"].strip())
    return out


def _json_ld(root: Node) -> list:
    out = []
    for n in root.all("script"):
        if n.attrs.get("type", "").lower() == "application/ld+json":
            try:
                out.append(json.loads(n.raw()))
            except (ValueError, RecursionError):
                continue
    return out


def _articles(value):
    """Article objects anywhere in a JSON value."""
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, list):
            todo += reversed(v)
        elif isinstance(v, dict):
            kind = v.get("@type")
            if {"NewsArticle", "Article"} & set(kind if isinstance(kind, list) else [kind]):
                yield v
            todo += reversed(list(v.values()))


_BYLINE = re.compile("author|byline|writer", re.I)


def _author(root: Node, meta: dict, articles: list[dict]) -> str | None:
    for a in articles:
        who = a.get("author")
        who = who[0] if isinstance(who, list) and who else who
        name = who.get("name") if isinstance(who, dict) else who
        if isinstance(name, str) and name.strip():
            return name.strip()
    for key in ("author", "article:author", "twitter:creator", "og:site_name"):
        if meta.get(key):
            return meta[key]
    for n in root.walk():
        if n.attrs and _BYLINE.search(n.attrs.get("class", "") + " " + n.attrs.get("id", "")) and n.text_length() < 200:
            name = re.sub(r"^(by|posted by)\s+", "", n.text(), flags=re.I).strip()
            if 0 < len(name) < 100:
                return name
    return None


def _published(root: Node, meta: dict, articles: list[dict]) -> str | None:
    found = [meta.get(k) for k in ("article:published_time", "og:updated_time", "pubdate", "date", "last-modified")] + [n.attrs.get("datetime") for n in root.all("time")] + [a.get("datePublished") for a in articles]
    for v in found:
        if isinstance(v, str) and re.fullmatch(r"\d{4}-\d{1,2}-\d{1,2}", v.split("T")[0].strip()):
            return v.split("T")[0].strip()
    return None


# fixed values: what names of containers say, tags that are none, and names and targets of search fields
GOOD_NAMES = ("content", "article", "post", "body", "entry", "main", "story", "text")
BAD_NAMES = ("menu", "nav", "sidebar", "footer", "header", "comment", "widget", "ad-", "ads", "share", "social", "banner", "cookie")
NO_CONTAINERS = ("script", "style", "nav", "footer", "header", "aside", "noscript", "form")
SEARCH_NAMES = re.compile(r"\b(search|query|q|find|keyword|keywords|s|term|terms|text|buscar|suche)\b", re.I)
SEARCH_TARGETS = re.compile(r"(search|find|query|results|buscar|suche|zoeken|/?s=|/?q=)", re.I)


def _score(n: Node) -> float:
    """How much a container looks like the article."""
    if n.tag in NO_CONTAINERS:
        return -1000.0
    size = n.length()
    if size < 30:
        return -100.0
    if n.link_length() > 0.5 * size:
        return -500.0
    name = f"{n.attrs.get('id', '')} {' '.join(n.attrs.get('class', '').split())}".lower()
    named = 200.0 * sum(w in name for w in GOOD_NAMES) - 400.0 * sum(w in name for w in BAD_NAMES)
    return 50.0 * n.count("p") + 0.1 * size + {"article": 600.0, "main": 600.0, "section": 150.0}.get(n.tag, 0.0) + named


def container(root: Node) -> Node:
    """The best container; one whose paragraphs nearly all stand in a candidate inside it gives way to that one."""
    best, most, inside = None, 0.0, []  # inside: open candidates, each with its score, paragraphs and the most paragraphs of one within it
    found: list[list] = []
    for n in root.all("div", "section", "article", "main"):
        if (s := _score(n)) > 100:
            while inside and inside[-1][0].end <= n.at:
                inside.pop()
            row = [n, s, n.count("p"), -1]
            if inside:
                inside[-1][3] = max(inside[-1][3], row[2])
            inside.append(row)
            found.append(row)
    for n, s, paragraphs, within in found:
        if within < 0.85 * max(1, paragraphs) and (best is None or s > most):
            best, most = n, s
    return best or root.first("body") or root


def _stop_node(box: Node) -> Node | None:
    seen: dict[tuple[int, int], bool] = {}  # boxes in boxes often hold the same text
    for n in box.all(*_HEADINGS, "p", "div", "section"):
        if n.tag in _HEADINGS or n.text_length() < 80:
            span = n.span()
            if span not in seen:
                seen[span] = bool(_STOP.search(n.text()))
            if seen[span]:
                return n
    return None


# fixed values: tags that hold no text of an article, by how strict the cleaning is, and names of boxes beside it
TECHNICAL_TAGS = frozenset("script style noscript svg form button input select option".split())
BOILERPLATE_TAGS = TECHNICAL_TAGS | frozenset("nav footer header aside iframe".split())
BESIDE = re.compile("cookie|banner|popup|modal|ad-wrapper|advertisement|sidebar|widget|share-|social-|nav-|menu|toc|navigation|prev-next|left-menu|right-menu|header|footer|aside|breadcrumb|toolbar|comment|meta", re.I)


class Cleaned:
    """What is left of a container: its items, in order."""

    def __init__(self, box: Node, items: list[int]):
        self.page, self.items = box.page, items

    def text(self, skip: frozenset = frozenset()) -> str:
        page, out, quiet = self.page, [], 0
        for j in self.items:
            if page.tags[j] in skip:
                quiet = max(quiet, page.end[j])
            elif page.tags[j] is None and j >= quiet:
                out += page.pieces[page.pieces_before[j] : page.pieces_before[j + 1]]
        return " ".join(out)


def cleaned(box: Node, strict: bool) -> Cleaned:
    """A container without tags of no text; strict: nor boilerplate, nor boxes named as beside the article. It ends at the stop node."""
    gone, stop, page = BOILERPLATE_TAGS if strict else TECHNICAL_TAGS, _stop_node(box), box.page
    items, j, last = [], box.at + 1, stop.at if stop is not None else -1
    while j < box.end and j != last:
        tag, held = page.tags[j], page.held[j]
        if tag is not None and (tag in gone or strict and (BESIDE.search(held.get("id", "")) or BESIDE.search(held.get("class", "")))):
            j = page.end[j]
            continue
        items.append(j)
        j += 1
    return Cleaned(box, items)


def best_cleaned(box: Node) -> tuple[Cleaned, float]:
    """The strictly cleaned container, or the safely cleaned one where that keeps under 95 % of its text; and the share kept."""
    size = lambda c: len("".join(c.text(_TECHNICAL).split()))
    strict, safe = cleaned(box, True), cleaned(box, False)
    kept = size(strict) / max(1, size(safe))
    return (strict if kept >= LEAST_RETENTION else safe), kept


def article_text(root: Node) -> str:
    """Headings and paragraphs, a blank line between, up to a heading or short paragraph after which there is no article."""
    out: list[str] = []
    for n in root.all(*_HEADINGS, "p"):
        text = n.text()
        if (n.tag in _HEADINGS or len(text) < 80) and _STOP.match(text):
            break
        out += [text] if text else []
    return "\n\n".join(out)


_MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*"}
_NOT_INLINE = _TECHNICAL | _BLOCKS | {"img", "video", "picture", "audio", "figure"}
_PLAIN_BOXES = ("div", "section", "article", "main", "body", "#root")
_PASSED = (_BLOCKS | {"form", "figure", "span", "a", "html", "b", "i", "center"}) - _TECHNICAL - _NOISE


def _inline(n: Node) -> str:
    """Text below with its emphasis and code marked, without blocks and media."""
    page, j = n.page, n.at + 1
    open_marks: list[tuple[int, str, list[str]]] = [(n.end, "", [])]  # where each marked part ends, its mark, and what it holds
    while True:
        while j >= open_marks[-1][0]:
            _, mark, held = open_marks.pop()
            if not open_marks:
                return "".join(held)
            open_marks[-1][2].append(f"{mark}{''.join(held).strip()}{mark}")
        tag, out = page.tags[j], open_marks[-1][2]
        if tag is None:
            out.append(re.sub(r"\s+", " ", page.held[j]))
        elif tag in _MARKS:
            c = Node(page, j)
            if c.text_length():
                open_marks.append((c.end, _MARKS[tag], []))
            else:
                j = c.end
                continue
        elif tag == "code":
            c = Node(page, j)
            out.append(f"`{c.text()}`")
            j = c.end
            continue
        elif tag == "br":
            out.append("\n")
        elif tag in _NOT_INLINE:
            j = page.end[j]
            continue
        j += 1


def _block(c: Node) -> str | None:
    """Markdown of an element that is one block; None of those that only hold others."""
    if c.tag in _HEADINGS:
        return "#" * int(c.tag[1]) + " " + c.text().rstrip("¶§ ")
    if c.tag == "pre":
        return "```\n" + c.raw().strip("\n") + "\n```"
    if c.tag == "blockquote":
        return "\n".join("> " + s for s in c.text().split("\n"))
    if c.tag in ("ul", "ol"):
        return "\n".join(("1. " if c.tag == "ol" else "- ") + li.text() for li in c.children if isinstance(li, Node) and li.tag == "li")
    if c.tag == "table":
        rows = [[x.replace("|", "\\|") for x in r] for r in _table(c)]
        return "\n".join(["| " + " | ".join(rows[0]) + " |", "|" + " --- |" * len(rows[0]), *("| " + " | ".join(r) + " |" for r in rows[1:])]) if rows else ""
    return None


def markdown(box: Node, stop: Node | None = None) -> str:
    """The container as Markdown: text of links, no media; ends at the stop node."""
    page, out, j, last = box.page, [], box.at + 1, stop.at if stop is not None else -1
    while j < box.end and j != last:
        tag = page.tags[j]
        if tag is None:
            if page.tags[page.parent[j]] in _PLAIN_BOXES and page.held[j].strip():
                out.append(" ".join(page.held[j].split()))
            j += 1
            continue
        c = Node(page, j)
        j = c.end  # past it, but for those whose parts are blocks of their own
        if (whole := _block(c)) is not None:
            out.append(whole)
        elif tag == "p":
            out.append(_inline(c).strip())
            j = c.at + 1
        elif tag in ("span", "a", "b", "i") and not c.has_block():
            if page.tags[page.parent[c.at]] != "p" and c.text_length():
                out.append(_inline(c).strip())
        elif tag in _PASSED:
            j = c.at + 1
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(s for s in out if s.strip()))


def _table(n: Node) -> list[list[str]]:
    return [[c.text() for c in r.all("td", "th")] for r in n.all("tr") if r.all("td", "th")]


def _distinct(values: list) -> list:
    return list({json.dumps(v, sort_keys=True): v for v in reversed(values) if v}.values())[::-1]


def _integer(v: str | None) -> int | None:
    m = re.match(r"\d+", v or "")
    return int(m[0]) if m else None


def _images(root: Node, base: str) -> list[dict]:
    out: dict[str, dict] = {}
    for n in root.all("img"):
        src = n.attrs.get("src") or n.attrs.get("data-src")
        if not src:
            continue
        up, caption = n.parent, None
        for _ in range(2):
            if up is not None and up.tag == "figure":
                caption = next((c.text() for c in up.all("figcaption")), None)
            up = up.parent if up is not None else None
        url = urljoin(base, src)
        out.setdefault(url, {"src": url, "alt": n.attrs.get("alt", ""), "caption": caption or n.attrs.get("title") or n.attrs.get("caption") or "", "width": _integer(n.attrs.get("width")), "height": _integer(n.attrs.get("height"))})
    return list(out.values())


def _videos(root: Node, base: str) -> list[dict]:
    out: dict[str, dict] = {}
    for n in root.all("video", "iframe", "embed", "object"):
        if n.tag == "video":
            sources = [n.attrs.get("src"), *(s.attrs.get("src") for s in n.all("source"))]
            src, kind = next((s for s in sources if s), None), "html5"
        else:
            src = n.attrs.get("src") or n.attrs.get("data")
            kind = next((k for k, hosts in _PROVIDERS if src and any(h in src for h in hosts)), "iframe")
        if src:
            url = urljoin(base, src)
            out.setdefault(url, {"src": url, "title": n.attrs.get("title", ""), "thumbnail": urljoin(base, n.attrs["poster"]) if n.attrs.get("poster") else "", "type": kind})
    return list(out.values())


def links(root: Node, base: str) -> list[dict]:
    out: dict[tuple, dict] = {}
    for n in root.all("a"):
        href = n.attrs.get("href", "").strip()
        if href and not href.lower().startswith(("javascript:", "mailto:", "tel:", "#")):
            row = {"text": n.text(), "url": urljoin(base, href), "title": n.attrs.get("title", "")}
            out.setdefault(tuple(row.values()), row)
    return list(out.values())


def search_form(root: Node, base: str) -> dict | None:
    """The form most likely to search the site; the first of equals, none below two points."""
    best, most = None, 1
    for form in root.all("form"):
        get = form.attrs.get
        points = 3 * bool(SEARCH_TARGETS.search(get("action", ""))) - 2 * (get("method", "").lower() == "post")
        points += 2 * sum(bool(SEARCH_NAMES.search(get(k, ""))) for k in ("role", "class", "id", "aria-label"))
        fields = []
        for i in form.all("input"):
            kind = i.attrs.get("type", "").lower() or "text"
            worth = 5 if kind == "search" else 3 if kind == "text" and any(SEARCH_NAMES.search(i.attrs.get(k, "")) for k in ("name", "id", "placeholder")) else 0
            points += worth
            fields += [i] if worth else []
        if fields and points > most:
            hidden = {i.attrs["name"]: i.attrs.get("value", "") for i in form.all("input") if i.attrs.get("type", "").lower() == "hidden" and i.attrs.get("name")}
            name = fields[0].attrs.get("name") or fields[0].attrs.get("id") or "q"
            best, most = {"action": urljoin(base, get("action", "")), "input": name, "hidden": hidden}, points
    return best


_PAGED = re.compile(r"[?&](?:page|p|pg|paged|start|offset)=\d+|/page/\d+", re.I)
_NUMBER = re.compile(r"[?&](?:page|p|pg|paged)=(\d{1,6})(?:&|#|$)|/page/(\d{1,6})(?:[/?#]|$)", re.I)


def _page_number(url: str) -> int:
    """Which page of a listing a URL is; one without a number is the first."""
    m = _NUMBER.search(url)
    return int(m[1] or m[2]) if m else 1


def _host(url: str) -> str:
    return re.sub(r"^www\.", "", (re.match(r"(?:[^:/?#]+:)?//([^/?#]*)", url) or ("", ""))[1].lower())


def next_page(root: Node, base: str) -> str | None:
    """The next page of a listing: by rel, by the words of a link with a page number, or by a link that shows and has the next number."""
    for n in root.all("link", "a"):
        if "next" in n.attrs.get("rel", "").lower().split() and n.attrs.get("href"):
            return urljoin(base, n.attrs["href"])
    for n in root.all("a"):
        if n.text().lower() in ("next", ">", "»", "next page", "older", "forward") and _PAGED.search(n.attrs.get("href", "")):
            return urljoin(base, n.attrs["href"])
    here = _page_number(base)
    for n in root.all("a"):
        href = urljoin(base, n.attrs.get("href", ""))
        if n.text() == str(here + 1) and _page_number(href) == here + 1 and _host(href) == _host(base):
            return href
    return None


def extract(html: str | None, url: str | None) -> dict:
    """Every field of a page; missing parts are null or empty."""
    root, base = parse(html or ""), url or ""
    meta, articles = _meta(root), list(_articles(_json_ld(root)))
    named = next((n.text() for n in root.all("title") if n.text()), None)
    h1 = next((n.text() for n in root.all("h1") if n.text()), None)
    box = container(root)
    stop = _stop_node(box)
    body = box.text(_NOISE, stop)
    if len(body) < LEAST_BODY:
        body = root.text(_NOISE | {"head", "title"})
    whole = box.text(_TECHNICAL)
    kept = len(re.sub(r"\s", "", box.text(_NOISE, stop))) / max(1, len(re.sub(r"\s", "", whole)))
    tag = next((n.attrs.get("lang") for n in root.all("html") if n.attrs.get("lang")), None) or meta.get("content-language")
    image = meta.get("og:image") or meta.get("twitter:image") or next((n.attrs.get("href") for n in root.all("link") if n.attrs.get("rel") == "image_src"), None)
    image = image or next((n.attrs["src"] for n in root.all("img") if n.attrs.get("src") and not any(w in n.attrs["src"].lower() for w in (".gif", "logo", "icon", "avatar"))), None)
    return {
        "title": (named or meta.get("og:title") or h1 or "Untitled")[:200],
        "description": meta.get("description") or meta.get("og:description"),
        "author": (_author(root, meta, articles) or "Unknown")[:100],
        "lang": re.split("[-_]", tag)[0].lower() if tag else None,
        "published": _published(root, meta, articles),
        "image": urljoin(base, image) if image else None,
        "body": body,
        "markdown": markdown(box, stop if kept >= LEAST_RETENTION else None),
        "retention": float(kept),
        "headings": _distinct([n.text().rstrip("¶§ ") for n in root.all(*_HEADINGS)]),
        "paragraphs": _distinct([n.text() for n in box.all("p")]),
        "lists": _distinct([[x.text() for x in n.all("li")] for n in box.all("ul", "ol")]),
        "tables": _distinct([_table(n) for n in box.all("table")]),
        "code": _distinct([n.raw().strip() for n in root.all("pre")]),
        "quotes": _distinct([n.text() for n in root.all("blockquote")]),
        "links": links(root, base),
        "images": _images(root, base),
        "videos": _videos(root, base),
        "search_form": search_form(root, base),
        "next_page": next_page(root, base),
    }


@paged_udf(SCHEMA)
def extracted(html: list, url: list) -> list[dict]:
    """Struct of every field of a page, from one parse; a page that cannot be read, as with an address that is none, has null fields."""
    return [_extracted(h, u) for h, u in zip(html, url)]


def _extracted(html: str | None, url: str | None) -> dict:
    try:
        return extract(html, url)
    except Exception:  # noqa: BLE001  one page must not end the task of thousands
        return dict.fromkeys(extract("", ""))


@paged_udf("clean string, kept double, full_text string")
def clean_text(html: list) -> list[dict]:
    """The container's text after cleaning, the share that strict cleaning keeps, and the archive's text of headings and paragraphs."""

    def one(page: str | None) -> dict:
        root = parse(page or "")
        node, kept = best_cleaned(container(root))
        return {"clean": node.text(_TECHNICAL), "kept": kept, "full_text": article_text(root)}

    return [one(h) for h in html]


# fixed values: names of Chinese charsets, all read as their superset, and those that servers send without knowing
CHINESE = ("gb2312", "gbk", "gb18030", "csgb2312", "chinese", "xgbk", "gbk2312", "gb231280")
UNSURE = ("iso88591", "windows1252", "latin1", "")
_CHARSET = re.compile(rb"""(?i)<meta[^>]+charset\s*=\s*["']?\s*([\w-]+)""")


def _plain_name(name: str | None) -> str:
    return re.sub("[-_]", "", (name or "").strip().lower())


def page_text(raw: bytes, content_type: str | None) -> tuple[str, str]:
    """Page bytes as text, and the charset they were read by: the header's, unless it says nothing or Latin
    while the page itself names a Chinese one; without a header's the page's own, else UTF-8. Chinese sets are read as GB18030; unknown ones as UTF-8.
    """
    header = m[1] if (m := re.search(r"""(?i)charset\s*=\s*["']?\s*([\w-]+)""", content_type or "")) else ""
    own = m[1].decode("latin-1") if (m := _CHARSET.search(raw[:4096])) else ""
    chosen = header or own or "utf-8"
    if _plain_name(header) in UNSURE and _plain_name(own) in CHINESE:
        chosen = own
    if _plain_name(chosen) in CHINESE:
        chosen = "gb18030"
    try:
        return raw.decode(chosen, "replace"), chosen.lower()
    except LookupError:
        return raw.decode("utf-8", "replace"), "utf-8"


@arrow_udf("string")
def decoded(data: pd.Series, charset: pd.Series) -> pd.Series:
    """Page bytes as text by page_text, given the header's charset."""
    return pd.Series([None if d is None else page_text(d, f"charset={c}" if c else None)[0] for d, c in zip(data, charset)])


@arrow_udf("string")
def html_unescaped(text: pd.Series) -> pd.Series:
    import html as _html

    return text.map(lambda t: _html.unescape(t) if t is not None else None)
