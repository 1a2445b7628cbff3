"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from lodestrata.llm.bpe import op3_bpe_codec
from lodestrata.llm.decontaminate import op8_decontaminate
from lodestrata.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from lodestrata.llm.license_scan import op2_license_scan
from lodestrata.llm.near_dedup import OP1_SQL, op1_minhash_near_dedup
from lodestrata.llm.quality import op5_quality
from lodestrata.llm.secret_scan import op9_secret_scan
from lodestrata.llm.toxicity import op4_toxicity
from lodestrata.llm.url_filter import OP10_SQL, op10_url_filter
from lodestrata.llm.warc import OP6_SQL, op6_warc

QUERIES = {
    f.__name__: f
    for f in (op1_minhash_near_dedup, op2_license_scan, op3_bpe_codec, op4_toxicity, op5_quality, op6_warc, op7_exact_dedup, op8_decontaminate, op9_secret_scan, op10_url_filter)
}
ORACLE_SQL = {"op1_minhash_near_dedup": OP1_SQL, "op6_warc": OP6_SQL, "op7_exact_dedup": OP7_SQL, "op10_url_filter": OP10_SQL}
