"""HTML and XML pages as tables of sections. The parsers of the standard library run on batches of pages; everything after the
rows exist is expressions."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S

#: Elements that are taken out.
NOISE = {"nav", "footer", "header", "aside", "script", "style", "noscript", "form", "button"}
#: Classes (whole names) whose elements are taken out.
NOISE_CLASSES = {"breadcrumbs", "share-links", "in-page-nav", "local-header", "sticky-header", "feedback", "print-link"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SECTION = "seq int, level int, heading string, text string"


class _Sections(HTMLParser):
    """Headings start sections; paragraphs and items of more than `least` characters are their text, tables are one block."""

    def __init__(self, least: int):
        super().__init__(convert_charrefs=True)
        self.least, self.stack, self.skip = least, [], 0
        self.out, self.heading, self.level, self.texts = [], "Introduction", 1, []
        self.block, self.cells, self.rows = None, None, None

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        noisy = tag in NOISE or bool(NOISE_CLASSES & set((dict(attrs).get("class") or "").split()))
        self.stack.append((tag, noisy))
        self.skip += noisy
        if self.skip:
            return
        if tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None or tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6") and self.rows is None:
            self.block = []

    def handle_endtag(self, tag):
        if tag not in [t for t, _ in self.stack]:
            return
        while True:
            name, noisy = self.stack.pop()
            if not self.skip:
                self._closed(name)
            self.skip -= noisy
            if name == tag:
                return

    def _closed(self, tag):
        text = " ".join(" ".join(self.block).split()) if self.block is not None else ""
        if tag in ("td", "th") and self.cells is not None:
            self.cells.append(text)
            self.block = None
        elif tag == "tr" and self.cells is not None:
            self.rows.append(" | ".join(self.cells))
            self.cells = None
        elif tag == "table" and self.rows is not None:
            if any(self.rows):
                self.texts.append("[TABLE]\n" + "\n".join(self.rows))
            self.rows = self.block = None
        elif self.rows is None and tag[:1] == "h" and tag[1:].isdigit():
            self.flush()
            self.heading, self.level, self.block = text, int(tag[1]), None
        elif self.rows is None and tag in ("p", "li"):
            if len(text) > self.least:
                self.texts.append(text)
            self.block = None

    def handle_data(self, data):
        if not self.skip and self.block is not None and data.strip():
            self.block.append(data.strip())

    def flush(self):
        if self.texts:
            self.out.append((self.level, self.heading, "\n\n".join(self.texts)))
        self.texts = []


def sections_of(html: str | None, least: int = 20) -> list[tuple[int, str, str]]:
    parser = _Sections(least)
    parser.feed(html or "")
    parser.close()
    while parser.stack:
        parser.handle_endtag(parser.stack[-1][0])
    parser.flush()
    return parser.out


def article_of(xml: str | None) -> list[tuple[int, str, str]]:
    """Abstract and nested sections of a journal article's XML; nothing for text that is not XML."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return []
    name = lambda e: e.tag.split("}")[-1]
    text = lambda e: " ".join(" ".join(e.itertext()).split())
    out = [(1, "Abstract", text(e)) for e in root.iter() if name(e) == "abstract"]

    def walk(e, level):
        for child in e:
            if name(child) == "sec":
                title = next((text(c) for c in child if name(c) == "title"), "")
                body = "\n\n".join(text(c) for c in child if name(c) in ("p", "list", "table-wrap"))
                if body:
                    out.append((level, title, body))
                walk(child, level + 1)
            else:
                walk(child, level)

    walk(root, 1)
    return out


def _words(e) -> str:
    return " ".join(" ".join(e.itertext()).split()) if e is not None else ""


def article_metadata(xml: str | None) -> dict | None:
    """Title, identifiers, publication types, keywords (at most thirty), authors ("A, B, C et al.") and licence of an article's
    XML; None without a title."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return None
    for e in root.iter():
        e.tag = e.tag.split("}")[-1] if isinstance(e.tag, str) else ""
    title = _words(root.find(".//article-title"))
    if not title:
        return None
    groups = [(g, g.get("kwd-group-type", "").lower()) for g in root.iter("kwd-group")]
    subjects = [_words(s) for g in root.iter("subj-group") if g.get("subj-group-type", "").lower() in ("heading", "article-type", "publication-type") for s in g.findall("subject")]
    types = subjects + [_words(k) for g, kind in groups if "pub" in kind for k in g.findall("kwd")]
    controlled = [_words(k) for g, kind in groups if "mesh" in kind or "controlled" in kind for k in g.findall("kwd")]
    free = [w for w in map(_words, root.iter("kwd")) if w[:1].isupper() and len(w.split()) <= 6]
    people = []
    for c in root.iter("contrib"):
        if c.get("contrib-type") == "author":
            surname, given = _words(c.find("name/surname")), _words(c.find("name/given-names"))
            person = f"{surname} {''.join(w[0] for w in given.split())}".strip() if surname else _words(c.find("collab"))
            people += [person] if person else []
    return {
        "title": title,
        "doi": next((_words(a) for a in root.iter("article-id") if a.get("pub-id-type") == "doi"), ""),
        "journal": _words(root.find(".//journal-title")),
        "year": _words(root.find(".//pub-date/year")),
        "authors": ", ".join(people[:3]) + (" et al." if len(people) > 3 else ""),
        "licence": next((x.get("license-type") for x in root.iter("license") if x.get("license-type")), "open-access"),
        "article_type": root.get("article-type", ""),
        "pub_types": [t for t in types if t],
        "keywords": sorted({w for w in controlled or free if w})[:30],
    }


def xml_metadata(articles: DataFrame, key: str, body: str) -> DataFrame:
    """One row for each article that has a title."""
    kind = dict(articles.dtypes)[key]
    texts = ["title", "doi", "journal", "year", "authors", "licence", "article_type"]

    def run(batches):
        for batch in batches:
            rows = [(k, m) for k, x in zip(batch.column(key).to_pylist(), (x.as_py() for x in batch.column("body")), strict=True) if (m := article_metadata(x))]
            columns = [pa.array([k for k, _ in rows], batch.schema.field(key).type), *[pa.array([m[c] for _, m in rows], pa.string()) for c in texts]]
            columns += [pa.array([m[c] for _, m in rows], pa.list_(pa.string())) for c in ("pub_types", "keywords")]
            yield pa.RecordBatch.from_arrays(columns, [key, *texts, "pub_types", "keywords"])

    return articles.select(key, F.col(body).alias("body")).mapInArrow(run, f"{key} {kind}, {', '.join(f'{c} string' for c in texts)}, pub_types array<string>, keywords array<string>")


#: Characters of sections that a task holds as Python's texts.
HELD = 1 << 20


def _rows(parse, key: str):
    """Pages one by one; their sections leave HELD characters at a time, so that a batch of many or long pages is not held twice."""

    def run(batches):
        for batch in batches:
            kinds = (batch.schema.field(key).type, pa.int32(), pa.int32(), pa.string(), pa.string())
            out, size = [], 0

            def rows():
                columns = list(zip(*out, strict=True)) if out else [[]] * 5
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [key, "seq", "level", "heading", "text"])

            for k, page in zip(batch.column(key), batch.column("body"), strict=True):
                k = k.as_py()
                for i, s in enumerate(parse(page.as_py())):
                    out.append((k, i, *s))
                    size += len(s[-1])
                    if size >= HELD:
                        yield rows()
                        out, size = [], 0
            yield rows()

    return run


def html_sections(pages: DataFrame, key: str, body: str, least: int = 20) -> DataFrame:
    kind = dict(pages.dtypes)[key]
    return pages.select(key, F.col(body).alias("body")).mapInArrow(_rows(lambda h: sections_of(h, least), key), f"{key} {kind}, {SECTION}")


def xml_sections(articles: DataFrame, key: str, body: str) -> DataFrame:
    kind = dict(articles.dtypes)[key]
    return articles.select(key, F.col(body).alias("body")).mapInArrow(_rows(article_of, key), f"{key} {kind}, {SECTION}")


def paragraphs(html: Column) -> Column:
    """The texts of p elements, without tags."""
    return F.transform(F.regexp_extract_all(html, F.lit("(?is)<p(?:\\s[^>]*)?>(.*?)</p>"), F.lit(1)), lambda p: F.trim(F.regexp_replace(p, "<[^>]*>", "")))


def routed(content_type: Column, body: Column) -> Column:
    """The parser of a body: 'html', 'xml', 'bundle' (a JSON object with chapters) or 'other', by the content type and, where it
    names none of them, by how the body begins."""
    kind, start = F.lower(F.coalesce(content_type, F.lit(""))), F.ltrim(F.coalesce(body, F.lit("")))
    named = F.when(F.contains(kind, F.lit("html")), "html").when(F.contains(kind, F.lit("xml")), "xml").when(F.contains(kind, F.lit("json")), "bundle").when(F.contains(kind, F.lit("pdf")), "other")
    seen = F.when(start.startswith("{"), "bundle").when(F.lower(F.substring(start, 1, 5)) == "<?xml", "xml").when(start.startswith("<"), "html").otherwise("other")
    return F.coalesce(named, seen)


def is_script_rendered(html: Column, least: int = 50) -> Column:
    """Fewer than three paragraphs of more than 50 characters."""
    return F.size(F.filter(paragraphs(html), lambda p: F.length(p) > least)) < 3


def links(html: Column, pattern: str = ".*") -> Column:
    """Distinct targets of a elements that match, in order, without query and fragment."""
    found = F.filter(F.regexp_extract_all(html, F.lit('(?i)<a\\s[^>]*href="([^"]*)"'), F.lit(1)), lambda h: h.rlike(pattern))
    return F.array_distinct(F.transform(found, S.without_query))


def resolved(base: Column, href: Column) -> Column:
    """Absolute links as they are, rooted ones behind the base's host, others behind its folder."""
    host = F.regexp_extract(base, "^([a-zA-Z]+://[^/]+)", 1)
    folder = F.regexp_replace(S.without_query(base), "[^/]*$", "")
    return F.when(href.rlike("^[a-zA-Z]+://"), href).when(href.startswith("/"), F.concat(host, href)).otherwise(F.concat(folder, href))


def years(text: Column) -> Column:
    """The year of the last update, else of publication."""
    updated = F.regexp_extract(text, "(?i)Last\\s+updated[:\\s]+\\d+\\s+\\w+\\s+(\\d{4})", 1)
    published = F.regexp_extract(text, "(?i)Published[:\\s]+\\d+\\s+\\w+\\s+(\\d{4})", 1)
    return F.coalesce(F.nullif(updated, F.lit("")), F.nullif(published, F.lit(""))).cast("int")
