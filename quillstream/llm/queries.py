"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import align, decontam, langid, lattice, minhash, mixing, oracles, perplexity, quality, suffixes, toxicity, turns, urls, warc


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_suffix_dedup": suffixes.documents_query,
    "op2_order_minhash": minhash.documents_query,
    "op3_warc_convert": warc.pages_query,
    "op4_ppm_language": langid.documents_query,
    "op5_url_filter": urls.pages_query,
    "op6_pu_quality": quality.documents_query,
    "op7_lattice_embeddings": lattice.embeddings_query,
    "op8_source_mix": mixing.documents_query,
    "op9_zstd_toxicity": toxicity.documents_query,
    "op10_seed_align": decontam.documents_query,
    "op11_kneser_ney": perplexity.documents_query,
    "op12_token_align": align.documents_query,
    "op13_turn_repair": turns.conversations_query,
    "pipeline": pipeline,
}
#: The others train models, align texts or link by alignment; tests hold them against brute force or held-out rows.
ORACLES: dict[str, str] = {
    "op1_suffix_dedup": oracles.REPEATS,
    "op3_warc_convert": oracles.ARCHIVES,
    "op5_url_filter": oracles.URL_FILTER,
    "op7_lattice_embeddings": oracles.LINKS,
    "op8_source_mix": oracles.MIX,
    "op11_kneser_ney": oracles.KNESER_NEY,
    "op13_turn_repair": oracles.TURNS,
}
