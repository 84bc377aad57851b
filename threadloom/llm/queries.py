"""The queries of this subpackage and their SQL, for the registry in ``__spark_entry__``."""

from threadloom.llm.bpe import op7_bpe
from threadloom.llm.codes import OP13_SQL, op13_vector_codes
from threadloom.llm.dedup_exact import OP3_SQL, op3_exact_dedup
from threadloom.llm.dedup_substring import op9_dedup_substring
from threadloom.llm.html_text import op5_html_text
from threadloom.llm.image_copies import op4_image_copies
from threadloom.llm.jaccard import op2_jaccard
from threadloom.llm.langid import op6_langid
from threadloom.llm.merkle import OP11_SQL, op11_merkle
from threadloom.llm.mixing import op8_mixing
from threadloom.llm.packing import op12_packing
from threadloom.llm.sharding import op1_sharding
from threadloom.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_jaccard": op2_jaccard,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_image_copies": op4_image_copies,
    "op5_html_text": op5_html_text,
    "op6_langid": op6_langid,
    "op7_bpe": op7_bpe,
    "op8_mixing": op8_mixing,
    "op9_dedup_substring": op9_dedup_substring,
    "op10_toxicity": op10_toxicity,
    "op11_merkle": op11_merkle,
    "op12_packing": op12_packing,
    "op13_vector_codes": op13_vector_codes,
}

SQL = {"op3_exact_dedup": OP3_SQL, "op11_merkle": OP11_SQL, "op13_vector_codes": OP13_SQL}
