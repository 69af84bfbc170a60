"""The registered queries of the corpus operators and their SQL."""

from tessera.llm import decontamination, encoding, filter_audit, fingerprints, licenses, lm_scoring, periodic_runs, quality, resharding, simhash_dedup, suffix_dedup, wavelet_shards, wrappers

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _module in (fingerprints, resharding, quality, decontamination, wrappers, suffix_dedup, encoding, licenses, simhash_dedup, lm_scoring, periodic_runs, wavelet_shards, filter_audit):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE_SQL
