"""The Arrow functions by name, for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from docloom.functions import distributions, text
from docloom.sources import pages

FUNCTIONS = {
    "nfc": text.nfc,
    "nfkc_folded": text.nfkc_folded,
    "html_unescaped": text.unescaped,
    "html_text": pages.html_text,
    "html_links": pages.html_links,
    "html_images": pages.html_images,
    "decoded_bytes": pages.decoded,
    "hwpx_text": pages.hwpx_text,
    "t_p_value": distributions.t_p_value,
    "t_critical": distributions.t_critical,
    "mcnemar_p": distributions.mcnemar_p,
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to this session's SQL; their names."""
    for name, function in FUNCTIONS.items():
        spark.udf.register(name, function)
    return sorted(FUNCTIONS)
