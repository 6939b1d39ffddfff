"""All registered queries of the engine's own operators, the SQL that checks them, and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import chunk, prep
from docloom.plans import data_queries, record_queries, source_queries, stat_queries, text_queries

QUERIES = text_queries.QUERIES | data_queries.QUERIES | stat_queries.QUERIES | record_queries.QUERIES | source_queries.QUERIES
ORACLES = text_queries.ORACLES | data_queries.ORACLES | stat_queries.ORACLES | record_queries.ORACLES | source_queries.ORACLES


def flagship(spark, sf_dir):
    """Documents normalised, hashed, de-duplicated (the last copy stays), chunked at boundaries, reported by source."""
    docs = text_queries.read(spark, sf_dir, "documents").withColumn("text", text.normalize_text(F.col("text")))
    kept = prep.last_wins(docs.withColumn("content_hash", F.sha2("text", 256)), ["content_hash"], ["doc_id"])
    return prep.report(chunk.boundary_chunks(kept), ["source"], "chunk_text")
