"""Queries and SQL of the corpus operators, for __spark_entry__."""

from . import ctw, exact_dedup, filter_audit, jaccard, minhash, mixing, packing, quality, secrets, telephony, turn_repair, url_filter, warc

QUERIES = {
    "op1_quality": quality.query,
    "op2_warc": warc.query,
    "op3_url_filter": url_filter.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_packing": packing.query,
    "op6_jaccard": jaccard.query,
    "op7_ctw": ctw.query,
    "op8_mixing": mixing.query,
    "op9_secrets": secrets.query,
    "op10_telephony": telephony.query,
    "op11_turn_repair": turn_repair.query,
    "op12_minhash": minhash.query,
    "op13_filter_audit": filter_audit.query,
}
ORACLES = {
    "op2_warc": warc.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op6_jaccard": jaccard.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op11_turn_repair": turn_repair.ORACLE,
    "op12_minhash": minhash.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
