"""The queries of this subpackage and their SQL."""

from . import bpe, embeddings, lines, media, mixing, neardup, neighbours, quotes, shards, tokenfiles, toxicity, tries, whitening

QUERIES = {
    "op1_media_columns": media.op1_media_columns,
    "op2_token_files": tokenfiles.op2_token_files,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_minhash_neardup": neardup.op4_minhash_neardup,
    "op5_source_mix": mixing.op5_source_mix,
    "op6_quote_threads": quotes.op6_quote_threads,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_shard_packing": shards.op8_shard_packing,
    "op9_embedding_neardup": embeddings.op9_embedding_neardup,
    "op10_byte_bpe": bpe.op10_byte_bpe,
    "op11_prefix_trie": tries.op11_prefix_trie,
    "op12_whitening": whitening.op12_whitening,
    "op13_nearest_neighbours": neighbours.op13_nearest_neighbours,
}

ORACLES = {
    "op3_line_dedup": lines.OP3_SQL,
    "op5_source_mix": mixing.OP5_SQL,
    "op6_quote_threads": quotes.OP6_SQL,
    "op9_embedding_neardup": embeddings.OP9_SQL,
    "op11_prefix_trie": tries.OP11_SQL,
}
