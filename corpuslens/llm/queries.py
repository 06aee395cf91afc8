"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from corpuslens.llm.chat import OP4_SQL, op4_chat_formatting
from corpuslens.llm.class_lm import op9_class_lm
from corpuslens.llm.embedding_dedup import OP1_SQL, op1_embedding_near_dedup
from corpuslens.llm.language_id import op8_language_id, pages_language_id
from corpuslens.llm.minhash_dedup import op3_minhash_near_dedup
from corpuslens.llm.mixing import OP6_SQL, op6_mixing
from corpuslens.llm.packing import OP10_SQL, op10_packing
from corpuslens.llm.quality import OP2_SQL, op2_quality_rules
from corpuslens.llm.sharding import op5_kd_tree_sharding
from corpuslens.llm.warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_kd_tree_sharding": op5_kd_tree_sharding,
    "op6_mixing": op6_mixing,
    "op7_warc": op7_warc,
    "op8_language_id": op8_language_id,
    "pages_language_id": pages_language_id,
    "op9_class_lm": op9_class_lm,
    "op10_packing": op10_packing,
}

ORACLES = {
    "op1_embedding_near_dedup": OP1_SQL,
    "op2_quality_rules": OP2_SQL,
    "op4_chat_formatting": OP4_SQL,
    "op6_mixing": OP6_SQL,
    "op7_warc": OP7_SQL,
    "op10_packing": OP10_SQL,
}
