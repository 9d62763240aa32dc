"""Web pages: plain text by expressions, and tag facts from one Arrow-batched parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.functions.extract import clean_credit, credit_in_text, looks_like_credit
from plinth.functions.text import as_col, collapse_spaces, let
from plinth.session import bounded_batches

# Elements whose content is not page text.
DROPPED_ELEMENTS = ["script", "style", "nav", "footer", "header", "aside"]

# Entities decoded in page text. The ampersand comes last.
ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"),
    ("&middot;", "·"), ("&amp;", "&"),
]


def page_text(html: Column | str, max_chars: int | None = None) -> Column:
    """Text of a page without scripts and furniture, cut only where `max_chars` is given."""
    out = as_col(html)
    for element in DROPPED_ELEMENTS:
        out = F.regexp_replace(out, f"(?is)<{element}\\b.*?</{element}\\s*>", " ")
    out = F.regexp_replace(out, "(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, "<[^>]*>", " ")
    for entity, plain in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(plain))
    out = collapse_spaces(out)
    return out if max_chars is None else F.substring(out, 1, max_chars)


def _records(*names: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in names]))


_TEXTS = T.ArrayType(T.StringType())
FACTS = T.StructType([
    T.StructField("images", _records("src", "srcset", "classes")), T.StructField("metas", _records("key", "content")),
    T.StructField("captions", _TEXTS), T.StructField("credits", _TEXTS), T.StructField("rows", T.ArrayType(_TEXTS)),
])
_CREDIT_MARKS = ("credit", "photographer", "caption", "byline")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _PageFacts(HTMLParser):
    """Collects the few tag facts the rules need; tolerant of unclosed tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.images, self.metas, self.captions, self.credits, self.rows = [], [], [], [], []
        self.open: list[tuple[str, str]] = []
        self.taking: list[tuple[str, list[str], list[str]]] = []
        self.tables: list[bool] = []
        self.row: list[str] | None = None
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        values = {k: v or "" for k, v in attrs}
        classes = values.get("class", "")
        if tag == "img":
            parent = self.open[-1][1] if self.open else ""
            source = values.get("src") or values.get("data-src") or values.get("data-lazy-src")
            self.images.append((source, values.get("srcset") or values.get("data-srcset"),
                                f"{parent} {classes}".lower().strip()))
        elif tag == "meta":
            key = values.get("property") or values.get("name")
            if key and values.get("content"):
                self.metas.append((key, values["content"]))
        elif tag == "table":
            self.tables.append("wikitable" in classes.split())
        elif tag == "tr":
            self._end_row()
            self.row = [] if self.tables and self.tables[-1] else None
        elif tag in ("td", "th"):
            self._end_cell()
            self.cell = [] if self.row is not None else None
        if tag == "figcaption":
            self.taking.append((tag, [], self.captions))
        elif tag not in _VOID and (any(m in classes for m in _CREDIT_MARKS) or "credit" in values.get("id", "")):
            self.taking.append((tag, [], self.credits))
        if tag not in _VOID:
            self.open.append((tag, classes))

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self._end_cell()
        elif tag == "tr":
            self._end_row()
        elif tag == "table" and self.tables:
            self._end_row()
            self.tables.pop()
        if self.taking and self.taking[-1][0] == tag:
            _, parts, into = self.taking.pop()
            into.append("".join(parts))
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        text = data.strip()
        if self.cell is not None:
            self.cell.append(text)
        for _, parts, _ in self.taking:
            parts.append(text)

    def _end_cell(self):
        if self.cell is not None and self.row is not None:
            self.row.append("".join(self.cell))
        self.cell = None

    def _end_row(self):
        self._end_cell()
        if self.row:
            self.rows.append(self.row)
        self.row = None

    def finish(self) -> tuple:
        self.close()
        self._end_row()
        for _, parts, into in self.taking:
            into.append("".join(parts))
        return self.images, self.metas, self.captions, self.credits, self.rows


def page_facts(html: Column | str) -> Column:
    """Images, meta tags, captions, credit elements and award-table rows of each page.

    Pages go to Python in batches of bounded bytes; a batch of Spark's 10,000 rows is all pages of a task.
    """
    bounded_batches(SparkSession.active())
    return _facts_of(html)


@F.pandas_udf(FACTS)
def _facts_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = ["images", "metas", "captions", "credits", "rows"]
    for html in batches:
        out = []
        for text in html:
            parser = _PageFacts()
            parser.feed(text or "")
            out.append(parser.finish())
        frame = pd.DataFrame(out, columns=names)
        frame["images"] = [[dict(zip(("src", "srcset", "classes"), i)) for i in r] for r in frame["images"]]
        frame["metas"] = [[dict(zip(("key", "content"), m)) for m in r] for r in frame["metas"]]
        yield frame


#: A page of plain texts and plain tags only: no comments, entities, unquoted or empty attributes, or stray signs.
_PLAIN_PAGE = re.compile('(?:[^<>&]++|<(?:/[A-Za-z][A-Za-z0-9]*|[A-Za-z][A-Za-z0-9]*(?:[ \\n]+[A-Za-z][A-Za-z-]*="[^"<>&]*")*+)>)*+')
_NAME = re.compile("/?[A-Za-z0-9]+")
_CLASS = re.compile('[ \\n]class="([^"]*)"', re.IGNORECASE)
#: Tags whose content a parser may take as text, and those that make rows.
_RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "plaintext", "noembed", "noframes", "noscript"}
_OF_ROWS = {"td", "th", "tr", "table", "/td", "/th", "/tr", "/table"}


def _award_rows(html: str | None) -> list[list[str]]:
    """Rows of the award tables of a page, as the parser gives them. Plain pages are read tag by tag, which is many
    times as fast; all others are parsed."""
    if not html or ("wikitable" not in html and "&" not in html):
        return []
    rows = _plain_rows(html) if _PLAIN_PAGE.fullmatch(html) else None
    if rows is None:
        parser = _PageFacts()
        parser.feed(html)
        rows = parser.finish()[4]
    return rows


def _plain_rows(html: str) -> list[list[str]] | None:
    rows, tables, row, cell = [], [], None, None
    for part in html.split("<")[1:]:
        tag, _, text = part.partition(">")
        name = tag
        if name not in _OF_ROWS:
            name = _NAME.match(tag)[0].lower()
            if name in _RAW:
                return None
        if name == "table":
            classes = _CLASS.findall(tag)
            tables.append(bool(classes) and "wikitable" in classes[-1].split())
        elif name in _OF_ROWS and (name != "/table" or tables):
            if cell is not None:
                row.append("".join(cell))
                cell = None
            if name == "td" or name == "th":
                cell = None if row is None else []
            elif name != "/td" and name != "/th":
                if row:
                    rows.append(row)
                row = [] if name == "tr" and tables and tables[-1] else None
                if name == "/table":
                    tables.pop()
        if text and cell is not None:
            cell.append(text.strip())
    if cell is not None:
        row.append("".join(cell))
    return rows + [row] if row else rows


@F.arrow_udf(T.ArrayType(_TEXTS))
def _award_rows_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for html in batches:
        yield pa.array([_award_rows(page) for page in html.to_pylist()], pa.list_(pa.list_(pa.string())))


def award_table_rows(html: Column | str) -> Column:
    """The rows of `page_facts` alone."""
    bounded_batches(SparkSession.active())
    return _award_rows_of(html)


def join_url(base: Column | str, ref: Column) -> Column:
    """Reference resolved against the page address."""
    page = F.regexp_extract(as_col(base), "^([^?#]*)", 1)
    scheme = F.regexp_extract(page, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    host = F.regexp_extract(page, "^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    folder = F.when(F.length(page) > F.length(host), F.regexp_extract(page, "^(.*/)", 1)).otherwise(
        F.concat(host, F.lit("/")))
    return (
        F.when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(host, ref))
        .otherwise(F.concat(folder, ref))
    )


def bump_cdn_width(url: Column | str, target: int = 1600) -> Column:
    """Raise numeric width, w and size parameters below the target, and quality below 85 to 90."""
    value = as_col(url)
    query = F.regexp_extract(value, "^[^?#]*\\?([^#]*)", 1)

    def raised(pair: Column) -> Column:
        name = F.substring_index(pair, "=", 1)
        number = F.regexp_extract(pair, "^[^=]*=(-?\\d+)$", 1).try_cast("int")
        small = name.isin("width", "w", "size") & (number < target)
        dull = (name == "quality") & (number < 85)
        return F.when(small, F.concat(name, F.lit(f"={target}"))).when(dull, F.lit("quality=90")).otherwise(pair)

    def rebuilt(bumped: Column) -> Column:
        whole = F.concat(
            F.regexp_extract(value, "^([^?#]*)", 1), F.lit("?"), bumped, F.regexp_extract(value, "(#.*)?$", 1))
        return F.when((F.length(query) > 0) & (bumped != query), whole).otherwise(value)

    return let(F.array_join(F.transform(F.split(query, "&"), raised), "&"), rebuilt)


_HERO = "hero|banner|cover|splash|featured"
_NOT_CONTENT = "logo|favicon|sprite|social"


def _metas(facts: Column, keys: list[str]) -> Column:
    """Content of the first meta tag of each key, keys in order."""
    def first(key: str) -> Column:
        return F.get(F.filter(facts["metas"], lambda m: m["key"] == key), F.lit(0))["content"]

    return F.array_compact(F.array(*[first(k) for k in keys]))


def image_candidates(facts: Column | str, base: Column | str, min_width: int = 800) -> Column:
    """Distinct image addresses with the rule that found them, best rule first, page order within.

    Facts come from `page_facts`. All images of the page are looked at.
    """
    page = as_col(facts)
    images = page["images"]

    def entry(priority, position, kind, url) -> Column:
        return F.struct(F.lit(priority).alias("priority"), position.cast("int").alias("position"),
                        kind.alias("kind"), url.alias("url"))

    def widest(image: Column, position: Column) -> Column:
        sized = F.transform(F.split(image["srcset"], ","), lambda part: F.struct(
            F.regexp_extract(F.trim(part), "^\\S+\\s+(\\d+)w", 1).try_cast("int").alias("width"),
            F.regexp_extract(F.trim(part), "^(\\S+)", 1).alias("url")))
        best = F.aggregate(sized, F.struct(F.lit(0).alias("width"), F.lit("").alias("url")),
                           lambda acc, x: F.when(F.coalesce(x["width"] > acc["width"], F.lit(False)), x).otherwise(acc))
        return F.when(best["width"] >= min_width, entry(
            1, position, F.concat(F.lit("srcset "), best["width"].cast("string"), F.lit("w")), join_url(base, best["url"])))

    def usable(image: Column) -> Column:
        return (F.length(image["src"]) > 0) & ~image["src"].startswith("data:")

    def hero(image: Column, position: Column) -> Column:
        hit = usable(image) & image["classes"].rlike(_HERO)
        return F.when(hit, entry(2, position, F.lit("hero img"), bump_cdn_width(join_url(base, image["src"]))))

    def large(image: Column, position: Column) -> Column:
        width = F.regexp_extract(image["src"], "[-_](\\d{3,4})x(\\d{3,4})", 1).try_cast("int")
        height = F.regexp_extract(image["src"], "[-_](\\d{3,4})x(\\d{3,4})", 2).try_cast("int")
        hit = usable(image) & ~F.lower(image["src"]).rlike(_NOT_CONTENT) & (width >= min_width) & (height >= 400)
        kind = F.concat(F.lit("large img ("), width.cast("string"), F.lit("x"), height.cast("string"), F.lit(")"))
        return F.when(hit, entry(3, position, kind, join_url(base, image["src"])))

    def shared(keys: list[str]) -> Column:
        return F.filter(_metas(page, keys), lambda u: u.startswith("http"))

    og = shared(["og:image:secure_url", "og:image", "og:image:url"])
    def wider(url: Column, position: Column) -> Column:
        return let(bump_cdn_width(url), lambda b: F.when(b != url, entry(4, position, F.lit("og:image bumped"), b)))

    bumped = F.filter(F.transform(og, wider), lambda e: e.isNotNull())
    plain = F.transform(og, lambda u, i: entry(5, i, F.lit("og:image"), u))
    cards = F.transform(shared(["twitter:image", "twitter:image:src"]), lambda u, i: entry(6, i, F.lit("twitter:image"), u))
    ranked = F.sort_array(F.concat(
        F.array_compact(F.transform(images, widest)), F.array_compact(F.transform(images, hero)),
        F.array_compact(F.transform(images, large)), bumped, plain, cards))
    # `ranked` inside the filter's body would be worked out again for each of its own elements.
    return let(ranked, lambda held: let(F.transform(held, lambda e: e["url"]), lambda urls: F.filter(
        held, lambda e, i: F.array_position(urls, e["url"]) == i + 1)))


# Meta keys that may carry a credit, in the order they are tried.
CREDIT_METAS = ["author", "photographer", "dc.creator", "twitter:creator", "article:author"]


def photo_credit(facts: Column | str, html: Column | str) -> Column:
    """Credit from meta tags, captions, credit elements, then patterns in the page text."""
    page = as_col(facts)
    meta = F.trim(F.get(_metas(page, CREDIT_METAS), F.lit(0)))
    caption = F.get(F.filter(page["captions"], looks_like_credit), F.lit(0))
    element = F.get(F.filter(page["credits"], lambda t: looks_like_credit(t) & (F.length(t) < 200)), F.lit(0))
    text = collapse_spaces(F.regexp_replace(as_col(html), "<[^>]*>", " "))
    return F.coalesce(meta, clean_credit(caption), clean_credit(element), credit_in_text(text))
