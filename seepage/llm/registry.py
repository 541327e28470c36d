"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from seepage.llm.bpe import op1_byte_bpe
from seepage.llm.decontaminate import op5_decontamination
from seepage.llm.embeddings import OP7_SQL, op7_embedding_near_dedup
from seepage.llm.langid import op4_language_id
from seepage.llm.lexical import OP12_SQL, op12_lexical_search
from seepage.llm.licenses import OP6_SQL, op6_license_scan
from seepage.llm.maxent import op3_maxent
from seepage.llm.minhash import op8_order_minhash
from seepage.llm.mixing import OP11_SQL, op11_pareto_mix
from seepage.llm.quality import op10_quality
from seepage.llm.spelling import OP13_SQL, op13_spelling_variants
from seepage.llm.toxicity import op2_toxicity
from seepage.llm.warc import OP9_SQL, op9_warc

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_maxent": op3_maxent,
    "op4_language_id": op4_language_id,
    "op5_decontamination": op5_decontamination,
    "op6_license_scan": op6_license_scan,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_order_minhash": op8_order_minhash,
    "op9_warc": op9_warc,
    "op10_quality": op10_quality,
    "op11_pareto_mix": op11_pareto_mix,
    "op12_lexical_search": op12_lexical_search,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op6_license_scan": OP6_SQL,
    "op7_embedding_near_dedup": OP7_SQL,
    "op9_warc": OP9_SQL,
    "op11_pareto_mix": OP11_SQL,
    "op12_lexical_search": OP12_SQL,
    "op13_spelling_variants": OP13_SQL,
}
