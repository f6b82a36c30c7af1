"""The corpus operators' registered queries and their oracle SQL."""

from __future__ import annotations

from scorebook.llm import decontaminate, exact_dedup, gif, langid, lattice_lm, minhash, mixing, phrases, pii, prefix_trie, secrets, sharding, warc

QUERIES = {
    "op1_gif": gif.op1_gif,
    "op2_minhash": minhash.op2_minhash,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_pii": pii.op4_pii,
    "op5_mixing": mixing.op5_mixing,
    "op6_sharding": sharding.op6_sharding,
    "op7_lattice_lm": lattice_lm.op7_lattice_lm,
    "op8_secrets": secrets.op8_secrets,
    "op9_warc": warc.op9_warc,
    "op10_langid": langid.op10_langid,
    "op11_exact_dedup": exact_dedup.op11_exact_dedup,
    "op12_phrases": phrases.op12_phrases,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

#: The others have no SQL form; tests compare them with brute-force versions.
ORACLE_SQL = {
    "op9_warc": warc.OP9_SQL,
    "op11_exact_dedup": exact_dedup.OP11_SQL,
    "op12_phrases": phrases.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
