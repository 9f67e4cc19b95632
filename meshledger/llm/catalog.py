"""The corpus queries and the SQL of those that SQL can express."""

from __future__ import annotations

from meshledger.llm.decontaminate import SQL as DECONTAMINATE_SQL
from meshledger.llm.decontaminate import op8_decontaminate
from meshledger.llm.encoding import op4_sentencepiece
from meshledger.llm.extract import op7_extract
from meshledger.llm.jaccard import op3_jaccard
from meshledger.llm.kneser_ney import op2_kneser_ney
from meshledger.llm.langid import op9_language_id
from meshledger.llm.neighbours import op6_nearest
from meshledger.llm.pii import op12_pii
from meshledger.llm.quality import op1_quality
from meshledger.llm.retrieval import SQL as SEARCH_SQL
from meshledger.llm.retrieval import op11_search
from meshledger.llm.substrings import SQL as SUBSTRINGS_SQL
from meshledger.llm.substrings import op5_substrings
from meshledger.llm.toxicity import op10_toxicity
from meshledger.llm.variants import SQL as VARIANTS_SQL
from meshledger.llm.variants import op13_variants

QUERIES = {
    "op1_quality": op1_quality,
    "op2_kneser_ney": op2_kneser_ney,
    "op3_jaccard": op3_jaccard,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_substrings": op5_substrings,
    "op6_nearest": op6_nearest,
    "op7_extract": op7_extract,
    "op8_decontaminate": op8_decontaminate,
    "op9_language_id": op9_language_id,
    "op10_toxicity": op10_toxicity,
    "op11_search": op11_search,
    "op12_pii": op12_pii,
    "op13_variants": op13_variants,
}
SQL = {
    "op5_substrings": SUBSTRINGS_SQL,
    "op8_decontaminate": DECONTAMINATE_SQL,
    "op11_search": SEARCH_SQL,
    "op13_variants": VARIANTS_SQL,
}
