"""The queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from .decontamination import q_decontamination
from .exact import q_exact
from .jaccard import q_jaccard
from .language import q_language
from .mixing import q_mixing
from .oracle import ORACLE
from .pages import q_pages
from .passages import q_passages
from .periodicity import q_periodicity
from .quality import q_quality
from .search import q_search
from .secrets import q_secrets
from .sharding import q_sharding
from .toxicity import q_toxicity

QUERIES = {
    "op1_hyperdimensional_language": q_language,
    "op2_template_deduction": q_pages,
    "op3_phrase_automata": q_passages,
    "op4_classifier_chain": q_toxicity,
    "op5_secret_ledger": q_secrets,
    "op6_soft_membership_mix": q_mixing,
    "op7_parity_sketch_join": q_jaccard,
    "op8_pigeonhole_edit_match": q_decontamination,
    "op9_virtual_slots": q_sharding,
    "op10_weak_supervision": q_quality,
    "op11_dyadic_square_catching": q_periodicity,
    "op12_bag_search": q_search,
    "op13_streaming_exact_dedup": q_exact,
}

__all__ = ["ORACLE", "QUERIES"]
