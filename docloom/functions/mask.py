"""Masking of personal data: e-mail, then resident number, then phone, each on what the one before left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import bound

#: Kind, pattern and token in the order of use (fixed values).
MASKS = [
    ("email", r"(?U)(?<![\w.+-])[\w.+-]++@[\w-]+(?:\.[\w-]+)+", "[EMAIL]"),
    ("resident_id", r"(?<!\d)\d{6}[ -]?[1-8]\d{6}(?!\d)", "[RESIDENT_ID]"),
    ("phone", r"(?<!\d)(?:(?:\+82[ .-]?(?:0)?|0)(?:1[016789]|2|[3-6][1-5]|70))[ .-]?\d{3,4}[ .-]?\d{4}(?!\d)", "[PHONE]"),
]


def masked(text: Column, masks=MASKS) -> Column:
    """struct of `text`, masked, and `counts`, a map of the kinds that were found; each step works on what the one before left."""
    out = F.struct(text.alias("text"), F.create_map().cast("map<string,int>").alias("counts"))
    for mask in masks:
        out = bound(out, _step(*mask))
    return out


def _step(kind: str, pattern: str, token: str):
    def step(s: Column) -> Column:
        t = s["text"]
        sign = F.contains(t, F.lit("@")) if kind == "email" else t.rlike(r"\d{4}")
        more = lambda n: F.struct(F.regexp_replace(t, pattern, token).alias("text"), F.map_concat(s["counts"], F.create_map(F.lit(kind), n)).alias("counts"))
        return bound(F.when(sign, F.regexp_count(t, F.lit(pattern))).otherwise(0), lambda n: F.when(n > 0, more(n)).otherwise(s))

    return step


def mask_personal_data(text: Column, masks=MASKS) -> tuple[Column, Column]:
    """(masked text, counts): counts is a map of the kinds that were found."""
    done = masked(text, masks)
    return done["text"], done["counts"]
