"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op10_sharding import op10_sharding
from .op11_tokens import op11_tokens
from .op12_whitening import op12_whitening
from .op13_structure import op13_structure
from .op1_licenses import OP1_SQL, op1_licenses
from .op2_embeddings import OP2_SQL, op2_embeddings
from .op3_simhash import op3_simhash
from .op4_quality import op4_quality
from .op5_chat import op5_chat
from .op6_toxicity import op6_toxicity
from .op7_decontamination import OP7_SQL, op7_decontamination
from .op8_mixing import OP8_SQL, op8_mixing
from .op9_substring import OP9_SQL, op9_substring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_embeddings": op2_embeddings,
    "op3_simhash": op3_simhash,
    "op4_quality": op4_quality,
    "op5_chat": op5_chat,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_mixing": op8_mixing,
    "op9_substring": op9_substring,
    "op10_sharding": op10_sharding,
    "op11_tokens": op11_tokens,
    "op12_whitening": op12_whitening,
    "op13_structure": op13_structure,
}
ORACLES: dict[str, str] = {
    "op1_licenses": OP1_SQL,
    "op2_embeddings": OP2_SQL,
    "op7_decontamination": OP7_SQL,
    "op8_mixing": OP8_SQL,
    "op9_substring": OP9_SQL,
}
