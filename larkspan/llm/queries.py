"""The corpus operators' queries and their SQL, as __spark_entry__ registers them."""

from __future__ import annotations

import corpus_pipeline

from .bpe_trie import op7_trie_bpe
from .fingerprints import op6_exact_fingerprints
from .line_dedup import OP9_SQL, op9_line_dedup
from .media import op3_png_media
from .mixing import OP8_SQL, op8_golden_mixing
from .ngram_join import OP5_SQL, op5_ngram_jaccard_join
from .pii import op1_weak_supervision_pii
from .quality import op12_latent_neighbour_quality
from .sharding import op4_rendezvous_sharding
from .source_audit import OP13_SQL, op13_radix_source_audit
from .substring_dedup import OP2_SQL, op2_automaton_substring_dedup
from .toxicity import op10_nb_ngram_toxicity
from .vector_codes import OP11_SQL, op11_annular_vector_codes


def queries():
    return {
        "op1_weak_supervision_pii": op1_weak_supervision_pii,
        "op2_automaton_substring_dedup": op2_automaton_substring_dedup,
        "op3_png_media": op3_png_media,
        "op4_rendezvous_sharding": op4_rendezvous_sharding,
        "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
        "op6_exact_fingerprints": op6_exact_fingerprints,
        "op7_trie_bpe": op7_trie_bpe,
        "op8_golden_mixing": op8_golden_mixing,
        "op9_line_dedup": op9_line_dedup,
        "op10_nb_ngram_toxicity": op10_nb_ngram_toxicity,
        "op11_annular_vector_codes": op11_annular_vector_codes,
        "op12_latent_neighbour_quality": op12_latent_neighbour_quality,
        "op13_radix_source_audit": op13_radix_source_audit,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {"op2_automaton_substring_dedup": OP2_SQL, "op5_ngram_jaccard_join": OP5_SQL, "op8_golden_mixing": OP8_SQL, "op9_line_dedup": OP9_SQL, "op11_annular_vector_codes": OP11_SQL, "op13_radix_source_audit": OP13_SQL}
