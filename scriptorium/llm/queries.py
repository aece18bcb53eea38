"""Registry of this subpackage's queries and of their SQL."""

from . import q01_urls, q02_warc, q03_fingerprints, q04_toxicity, q05_sharding, q06_decontam, q07_jaccard, q08_packing, q09_html, q10_quality, q11_importance, q12_mixing, q13_vectors

QUERIES = {
    "op1_url_filter": q01_urls.op1_url_filter,
    "op2_warc": q02_warc.op2_warc,
    "op3_fingerprints": q03_fingerprints.op3_fingerprints,
    "op4_toxicity": q04_toxicity.op4_toxicity,
    "op5_sharding": q05_sharding.op5_sharding,
    "op6_decontamination": q06_decontam.op6_decontamination,
    "op7_jaccard_join": q07_jaccard.op7_jaccard_join,
    "op8_packing": q08_packing.op8_packing,
    "op9_html": q09_html.op9_html,
    "op10_quality": q10_quality.op10_quality,
    "op11_importance": q11_importance.op11_importance,
    "op12_mixing": q12_mixing.op12_mixing,
    "op13_vector_codes": q13_vectors.op13_vector_codes,
}

SQL = {
    "op1_url_filter": q01_urls.sql(),
    "op2_warc": q02_warc.SQL,
    "op12_mixing": q12_mixing.SQL,
    "op13_vector_codes": q13_vectors.SQL,
}
