"""The numbered operators' queries and their DuckDB SQL."""

from __future__ import annotations

from emberlog.llm.codes import OP11_SQL, op11_vector_codes
from emberlog.llm.decontaminate import op5_decontaminate
from emberlog.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from emberlog.llm.jaccard import OP6_SQL, op6_jaccard
from emberlog.llm.line_dedup import op4_line_dedup
from emberlog.llm.minhash import OP13_SQL, op13_minhash
from emberlog.llm.phrases import OP12_SQL, op12_phrases
from emberlog.llm.pieces import op2_pieces
from emberlog.llm.quality import op7_quality
from emberlog.llm.repeats import OP9_SQL, op9_substring_dedup
from emberlog.llm.sharding import op3_sharding
from emberlog.llm.toxicity import op1_toxicity
from emberlog.llm.warc import OP8_SQL, op8_warc

QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_pieces, op3_sharding, op4_line_dedup, op5_decontaminate, op6_jaccard, op7_quality, op8_warc,
    op9_substring_dedup, op10_exact_dedup, op11_vector_codes,
    op12_phrases, op13_minhash,
)}
SQL = {
    "op6_jaccard": OP6_SQL, "op8_warc": OP8_SQL, "op9_substring_dedup": OP9_SQL, "op10_exact_dedup": OP10_SQL, "op11_vector_codes": OP11_SQL,
    "op12_phrases": OP12_SQL, "op13_minhash": OP13_SQL,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
