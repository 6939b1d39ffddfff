"""Stable identities: content hashes, composite ids, canonical-JSON fingerprints and change hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(c: Column) -> Column:
    return F.sha2(F.coalesce(c.cast("string"), F.lit("")), 256)


def composite_id(prefix: str, *parts: Column) -> Column:
    """prefix:part:part, nulls as empty parts."""
    return F.concat_ws(":", F.lit(prefix), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def chunk_id(document_id: Column, index: Column, text: Column) -> Column:
    """Depends on the chunk's text: a changed text is another chunk."""
    return F.sha2(F.concat_ws(":", document_id.cast("string"), index.cast("string"), text), 256)


def span_id(document_id: Column, size: int, overlap: int, index: Column) -> Column:
    """Depends on settings and place, not on text: a changed text is the same chunk, encoded anew."""
    return F.sha2(F.concat_ws(":", document_id.cast("string"), F.lit(size), F.lit(overlap), index.cast("string")), 256)


def canonical(**fields: Column) -> Column:
    """Compact JSON with fields in alphabetical order; nulls must be made values before."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def source_hash(title: Column, date: Column, content: Column, image_urls: Column, attachments: Column) -> Column:
    """What a cheap look at a page tells; attachments are structs of name and url."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    refs = F.array_sort(F.transform(attachments, lambda a: F.struct(empty(a["url"]).alias("url"), empty(a["name"]).alias("name"))))
    return F.sha2(canonical(title=empty(title), date=empty(date), content=empty(content), image_urls=F.array_sort(image_urls), attachments=refs), 256)


def review_identity(review_id: Column, source: Column, semester: Column, content: Column) -> Column:
    """The review's own id, else its source hash, else a hash of semester and content before masking."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(filled(review_id), filled(source), F.sha2(F.to_json(F.array(F.coalesce(semester, F.lit("")), content)), 256))


def review_fingerprint(lecture: Column, semester: Column, content: Column) -> Column:
    """Of lecture, semester and content with white space collapsed: what tells a review seen before."""
    filled = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.sha2(F.concat_ws("\n", filled(lecture), filled(semester), F.trim(F.regexp_replace(filled(content), r"(?U)\s+", " "))), 256)


def config_fingerprint(version: str, **fields: Column) -> Column:
    """Of canonical JSON under a version tag: another version or value is another configuration."""
    return F.sha2(F.concat(F.lit(f"{version}:"), canonical(**fields)), 256)
