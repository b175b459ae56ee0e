"""All queries of this subpackage."""

from graftwork.llm import bpe, exact_dedup, html_text, licenses, maxent, minhash, neighbours, packing, spelling, suffixes, toxicity, trie, warc  # noqa: F401
from graftwork.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
