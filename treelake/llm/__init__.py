"""Operations of a training-data pipeline on the tables documents and pages. Nothing else in the library imports this package."""


def queries():
    from . import alignment, bpe, divergence, fingerprints, license_scan, mixing, near_dedup, ngram_join, quality, sharding, substring_dedup, suffix_dedup, url_filter

    return {
        "op10_scaled_sketches": fingerprints.op10_scaled_sketches,
        "op11_ngram_join": ngram_join.op11_ngram_join,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_token_alignment": alignment.op13_token_alignment,
        "op1_line_dedup": substring_dedup.op1_line_dedup,
        "op2_license_scan": license_scan.op2_license_scan,
        "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
        "op4_redirect_filter": url_filter.op4_redirect_filter,
        "op5_divergence_rules": quality.op5_divergence_rules,
        "op6_near_duplicates": near_dedup.op6_near_duplicates,
        "op7_byte_bpe": bpe.op7_byte_bpe,
        "op8_hilbert_shards": sharding.op8_hilbert_shards,
        "op9_mix_sources": mixing.op9_mix_sources,
    }


def oracle_sql():
    from . import divergence, license_scan, mixing, quality

    return {
        "op12_source_divergence": divergence.ORACLE,
        "op2_license_scan": license_scan.oracle(),
        "op5_divergence_rules": quality.oracle(),
        "op9_mix_sources": mixing.ORACLE,
    }
