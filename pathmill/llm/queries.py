"""The corpus operators' queries, each over its whole table, and their SQL where SQL can express them."""

from pathmill.llm.decontam import op8_bm25_decontamination
from pathmill.llm.exactsubstr import op4_suffix_dedup
from pathmill.llm.fixity import OP3_SQL, op3_merkle_fixity
from pathmill.llm.linededup import OP5_SQL, op5_line_dedup
from pathmill.llm.ordinal import op1_ordinal_quality
from pathmill.llm.packing import op6_best_fit_packing
from pathmill.llm.rules import op7_quality_rules
from pathmill.llm.sharding import op10_kd_sharding
from pathmill.llm.simhash import op2_simhash
from pathmill.llm.urlfilter import op9_url_templates

QUERIES = {
    "op1_ordinal_quality": op1_ordinal_quality,
    "op2_simhash": op2_simhash,
    "op3_merkle_fixity": op3_merkle_fixity,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_bm25_decontamination": op8_bm25_decontamination,
    "op9_url_templates": op9_url_templates,
    "op10_kd_sharding": op10_kd_sharding,
}

ORACLE_SQL = {
    "op3_merkle_fixity": OP3_SQL,
    "op5_line_dedup": OP5_SQL,
}
