"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .chat import OP7_SQL, op7_chat_rotation
from .decontam import op5_decontamination
from .divergence import OP11_SQL, op11_divergence
from .neardup import op10_bagminhash
from .pieces import op9_sentencepiece
from .pii import op6_pii
from .prefixes import OP12_SQL, op12_prefix_trie
from .repeats import op8_suffix_repeats
from .secrets import op2_secret_scan
from .simhash import op13_simhash
from .tokenids import op1_token_ids
from .topk import OP4_SQL, op4_exact_topk
from .toxicity import op3_toxicity

QUERIES = {
    "op1_token_ids": op1_token_ids,
    "op2_secret_scan": op2_secret_scan,
    "op3_toxicity": op3_toxicity,
    "op4_exact_topk": op4_exact_topk,
    "op5_decontamination": op5_decontamination,
    "op6_pii": op6_pii,
    "op7_chat_rotation": op7_chat_rotation,
    "op8_suffix_repeats": op8_suffix_repeats,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_bagminhash": op10_bagminhash,
    "op11_divergence": op11_divergence,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_simhash": op13_simhash,
}

ORACLES: dict[str, str] = {
    "op4_exact_topk": OP4_SQL,
    "op7_chat_rotation": OP7_SQL,
    "op11_divergence": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
}
