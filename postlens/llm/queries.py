"""All registered queries of the corpus operators by name."""

from postlens.llm import (
    exact_dedup, hard_negatives, language_id, mixing, near_dedup, packing, pii, prefix_trie, quality, substring_dedup, token_counts, url_filters, warc)

QUERIES = {
    **warc.QUERIES,
    **exact_dedup.QUERIES,
    **token_counts.QUERIES,
    **mixing.QUERIES,
    **pii.QUERIES,
    **packing.QUERIES,
    **substring_dedup.QUERIES,
    **near_dedup.QUERIES,
    **url_filters.QUERIES,
    **quality.QUERIES,
    **language_id.QUERIES,
    **prefix_trie.QUERIES,
    **hard_negatives.QUERIES,
}
