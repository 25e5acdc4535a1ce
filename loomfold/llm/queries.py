"""The queries of this subpackage, by name."""

from loomfold.llm import bpe, chat, classifier, lattice, licenses, minhash, ngrams, packing, secrets, transducer
from loomfold.llm.common import table


def queries() -> dict:
    return {
        "op1_hierarchical_packing": lambda s, d: packing.pack(table(s, d, "documents")),
        "op2_randomness_battery": lambda s, d: secrets.digests(table(s, d, "documents")),
        "op3_fast_similarity_sketch": minhash.query,
        "op4_chat_round_trip": chat.query,
        "op5_lattice_hashing": lattice.query,
        "op6_kneser_ney_bands": ngrams.query,
        "op7_license_digests": licenses.query,
        "op8_token_counts": lambda s, d: transducer.count_tokens(table(s, d, "documents")),
        "op9_nb_svm": classifier.query,
        "op10_bpe_two_tier": lambda s, d: bpe.digests(table(s, d, "documents")),
    }


def oracle_sql() -> dict:
    """None: the ten need sketches, trained models, tokenizers or patterns with look-around; each is tested against brute force or the library."""
    return {}
