"""Queries of the training-data operators and their SQL where it exists."""

from . import (
    attention_lm, chat_collapse, chat_repair, collocations, decontaminate, html_wrappers, ngram_join, packing, quality_rules,
    repair_store, sharding, token_counts, warc_bundles,
)

QUERIES = {
    "op1_lm_scoring": attention_lm.query,
    "op2_token_store": repair_store.query,
    "op3_packing": packing.query,
    "op4_html_extraction": html_wrappers.query,
    "op5_sharding": sharding.query,
    "op6_quality_rules": quality_rules.query,
    "op7_chat_formatting": chat_collapse.query,
    "op8_ngram_join": ngram_join.query,
    "op9_decontamination": decontaminate.query,
    "op10_token_counts": token_counts.query,
    "op11_chat_repair": chat_repair.query,
    "op12_collocations": collocations.query,
    "op13_warc_bundles": warc_bundles.query,
}
ORACLE_SQL = {
    "op7_chat_formatting": chat_collapse.ORACLE_SQL, "op9_decontamination": decontaminate.ORACLE_SQL, "op11_chat_repair": chat_repair.ORACLE_SQL,
    "op12_collocations": collocations.ORACLE_SQL, "op13_warc_bundles": warc_bundles.ORACLE_SQL,
}
