"""The corpus operators' queries by name, and SQL for those that SQL can state."""

from __future__ import annotations

from glyphwell.llm import chunks, decontaminate, embedding, licenses, packing, quality, sharding, simhash, toxicity, urls

QUERIES = {
    "op1_embedding_near_dedup": embedding.query,
    "op2_quality_classifier": quality.query,
    "op3_url_filter": urls.query,
    "op4_harmonic_packing": packing.query,
    "op5_substring_dedup": chunks.query,
    "op6_benchmark_decontamination": decontaminate.query,
    "op7_license_scan": licenses.query,
    "op8_sharding": sharding.query,
    "op9_toxicity": toxicity.query,
    "op10_simhash_near_dedup": simhash.query,
    "embedding_copies_of_all": embedding.with_copies,
}
ORACLES: dict[str, str] = {
    "op1_embedding_near_dedup": embedding.ORACLE,
    "embedding_copies_of_all": embedding.COPIES_ORACLE,
    "op4_harmonic_packing": packing.ORACLE,
    "op6_benchmark_decontamination": decontaminate.ORACLE,
    "op8_sharding": sharding.ORACLE,
}
