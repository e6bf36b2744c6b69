"""All queries of the subpackage."""

from quantweave.llm import bpe, chat, decontam, lm, mixing, pii, quality, repair, secrets, simhash, substring, tokens, trie  # noqa: F401
from quantweave.llm.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
