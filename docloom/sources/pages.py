"""HTML pages and binary attachments: links, texts, image URLs, signatures and decoded bytes, as Arrow functions over the standard library."""

from __future__ import annotations

import io
import lzma
import re
import zipfile
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SILENT = {"script", "style", "noscript"}


class Reader(HTMLParser):
    """Text outside silent elements, links with their text, image sources."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.images: list[str] = []
        self.silent, self.href, self.label = 0, None, []

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        if tag in SILENT:
            self.silent += 1
        elif tag == "a" and found.get("href"):
            self.href, self.label = found["href"], []
        elif tag == "img" and found.get("src"):
            self.images.append(found["src"])

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "a" and self.href is not None:
            self.links.append((self.href, " ".join("".join(self.label).split())))
            self.href = None

    def handle_data(self, data):
        if self.silent:
            return
        if self.href is not None:
            self.label.append(data)
        if data.strip():
            self.text.append(data.strip())


class Rows(HTMLParser):
    """Rows of lists and tables: the text of a list item, or of each cell, and the first link."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("li", "tr"):
            self.open.append({"cells": [[]] if tag == "li" else [], "href": None})
        elif self.open and tag in ("td", "th"):
            self.open[-1]["cells"].append([])
        elif self.open and tag == "a" and self.open[-1]["href"] is None:
            self.open[-1]["href"] = dict(attrs).get("href")

    def handle_endtag(self, tag):
        if tag in ("li", "tr") and self.open:
            row = self.open.pop()
            self.rows.append({"cells": [" ".join("".join(c).split()) for c in row["cells"]], "href": row["href"]})

    def handle_data(self, data):
        if self.open and self.open[-1]["cells"]:
            self.open[-1]["cells"][-1].append(data)


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("cells", T.ArrayType(T.StringType())), T.StructField("url", T.StringType())])))
def html_rows(html: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Rows of lists and tables of (html, base url): cells and the resolved first link, null where there is none."""
    kind = pa.list_(pa.struct([("cells", pa.list_(pa.string())), ("url", pa.string())]))
    for xs, bases in html:
        out = []
        for x, base in zip(xs, bases, strict=True):
            r = Rows()
            r.feed(x.as_py() or "")
            r.close()
            out.append([{"cells": w["cells"], "url": urljoin(base.as_py() or "", w["href"]) if w["href"] else None} for w in r.rows])
        yield pa.array(out, kind)


def read(html: str | None) -> Reader:
    r = Reader()
    r.feed(html or "")
    r.close()
    return r


@F.arrow_udf(T.StringType())
def html_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A line for each run of text; scripts and styles dropped."""
    for xs in batches:
        yield pa.array(["\n".join(read(x.as_py()).text) for x in xs], pa.string())


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("name", T.StringType())])))
def html_links(html: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Links of (html, base url), resolved, the first of each URL, in order."""
    kind = pa.list_(pa.struct([("url", pa.string()), ("name", pa.string())]))
    for xs, bases in html:
        out = []
        for x, base in zip(xs, bases, strict=True):
            seen: dict[str, str] = {}
            for href, name in read(x.as_py()).links:
                seen.setdefault(urljoin(base.as_py() or "", href), name)
            out.append([{"url": u, "name": n} for u, n in seen.items()])
        yield pa.array(out, kind)


@F.arrow_udf(T.ArrayType(T.StringType()))
def html_images(html: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Image URLs of (html, base url), resolved, the first of each, in order."""
    for xs, bases in html:
        yield pa.array([list(dict.fromkeys(urljoin(b.as_py() or "", i) for i in read(x.as_py()).images)) for x, b in zip(xs, bases, strict=True)], pa.list_(pa.string()))


#: Leading bytes in hexadecimal and what they tell, in the order of the test (fixed values).
SIGNATURES = [("504B0304", "zip"), ("D0CF11E0A1B11AE1", "ole"), ("89504E470D0A1A0A", "png"), ("FFD8FF", "jpeg")]


def signature(content: Column) -> Column:
    """html, zip, ole, png, jpeg, pdf or unknown; a PDF header may stand in the first 1024 bytes."""
    head = F.hex(F.substring(content, 1, 1024))
    start = F.lower(F.ltrim(F.substring(content, 1, 256).cast("string")))
    found = F.when(start.rlike(r"\A(?:<!doctype html|<html)"), "html")
    for prefix, kind in SIGNATURES:
        found = found.when(head.startswith(prefix), kind)
    return found.when(head.rlike("^(?:[0-9A-F]{2})*?255044462D"), "pdf").otherwise("unknown")


@F.arrow_udf(T.StringType())
def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Bytes as text by the first encoding that fits: UTF-8 with or without a mark, CP949, EUC-KR; else empty."""
    for xs in batches:
        out = []
        for x in xs:
            data, text = x.as_py() or b"", ""
            for name in ("utf-8-sig", "cp949", "euc-kr"):
                try:
                    text = data.decode(name)
                    break
                except UnicodeDecodeError:
                    continue
            out.append(text)
        yield pa.array(out, pa.string())


#: Bytes that the sections of a zipped document may have once unpacked; more is refused, whatever the file says.
UNPACKED = 256 << 20


def section_number(name: str) -> int | None:
    found = re.fullmatch(r"Contents/section(\d+)\.xml", name)
    return int(found[1]) if found else None


def hwpx_paragraphs(data: bytes) -> str | None:
    """Paragraphs of a zipped XML document, sections by number, blank ones left out; null where it is damaged, encrypted or too large."""
    lines, left = [], UNPACKED
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = sorted((n for n in z.namelist() if section_number(n) is not None), key=section_number)
            for n in names:
                with z.open(n) as f:
                    section = f.read(left + 1)
                left -= len(section)
                if left < 0:
                    return None
                for p in ElementTree.fromstring(section).iter():
                    if p.tag.endswith("}p"):
                        lines.append("".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")))
    except (zipfile.BadZipFile, ElementTree.ParseError, zlib.error, lzma.LZMAError, RuntimeError, NotImplementedError, EOFError, OSError, ValueError, KeyError):
        return None
    return "\n".join(x for x in lines if x.strip())


@F.arrow_udf(T.StringType())
def hwpx_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """hwpx_paragraphs of each value; null for null."""
    for xs in batches:
        yield pa.array([None if (data := x.as_py()) is None else hwpx_paragraphs(data) for x in xs], pa.string())


def attachment_kind(content: Column, name: Column) -> Column:
    """pdf, hwpx, hwp, image, html, text or other, by signature first, then by the name's ending."""
    kind, ending = signature(content), F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(kind == "pdf", "pdf").when((kind == "zip") & (ending == "hwpx"), "hwpx").when(kind == "ole", "hwp")
        .when(kind.isin("png", "jpeg"), "image").when(kind == "html", "html").when((kind == "unknown") & ending.isin("txt", "csv", "md"), "text").otherwise("other")
    )


def attachment_text(content: Column, name: Column) -> Column:
    """struct of kind, method and text: native readers for text, HTML and zipped documents; null, with the method `provider`, for what a provider is to read."""
    kind = attachment_kind(content, name)
    only = lambda k: F.when(kind == k, content)
    text = F.when(kind == "hwpx", hwpx_text(only("hwpx"))).when(kind == "text", decoded(only("text"))).when(kind == "html", html_text(decoded(only("html"))))
    method = F.when(kind.isin("hwpx", "text", "html"), "native").when(kind == "other", "none").otherwise("provider")
    return F.struct(kind.alias("kind"), method.alias("method"), text.alias("text"))
