"""Queries of this subpackage by name, and the SQL that checks those that SQL can express."""

from docloom.llm.alignment import op11_alignment
from docloom.llm.chat import OP8_SQL, op8_chat
from docloom.llm.media import op10_media_columns
from docloom.llm.minhash import NEAR_SQL, minhash_near_classes, op3_minhash
from docloom.llm.mixing import OP6_SQL, op6_mixing
from docloom.llm.pii import OP9_SQL, op9_pii
from docloom.llm.quality import op5_quality
from docloom.llm.runs import op13_runs
from docloom.llm.sentencepiece import op4_sentencepiece
from docloom.llm.simhash import op7_simhash
from docloom.llm.substrings import op12_suffix_dedup
from docloom.llm.urls import op1_url_filters
from docloom.llm.warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_warc": op2_warc,
    "op3_minhash": op3_minhash,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_quality": op5_quality,
    "op6_mixing": op6_mixing,
    "op7_simhash": op7_simhash,
    "op8_chat": op8_chat,
    "op9_pii": op9_pii,
    "op10_media_columns": op10_media_columns,
    "op11_alignment": op11_alignment,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_runs": op13_runs,
    "minhash_near_classes": minhash_near_classes,
}
ORACLES = {"op2_warc": OP2_SQL, "op6_mixing": OP6_SQL, "op8_chat": OP8_SQL, "op9_pii": OP9_SQL, "minhash_near_classes": NEAR_SQL}
