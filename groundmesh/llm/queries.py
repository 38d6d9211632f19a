"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe import op10
from .divergence import OP11_SQL, op11
from .fingerprints import op6
from .licenses import OP13_SQL, op13
from .lines import OP9_SQL, op9
from .mixing import op8
from .neardup import OP3_SQL, op3
from .quality import op2
from .repeats import OP4_SQL, op4
from .resample import OP12_SQL, op12
from .sharding import op7
from .toxicity import op5
from .warc import OP1_SQL, op1

QUERIES = {
    "op1_warc_derivatives": op1,
    "op2_quality_ratio": op2,
    "op3_hyperminhash_groups": op3,
    "op4_run_length_repeats": op4,
    "op5_subword_toxicity": op5,
    "op6_piecewise_hashes": op6,
    "op7_feistel_shards": op7,
    "op8_source_schedule": op8,
    "op9_line_templates": op9,
    "op10_chunked_bpe": op10,
    "op11_iceberg_divergence": op11,
    "op12_importance_resample": op12,
    "op13_license_signatures": op13,
}
ORACLE = {"op1_warc_derivatives": OP1_SQL, "op3_hyperminhash_groups": OP3_SQL, "op4_run_length_repeats": OP4_SQL, "op9_line_templates": OP9_SQL, "op11_iceberg_divergence": OP11_SQL, "op12_importance_resample": OP12_SQL, "op13_license_signatures": OP13_SQL}
