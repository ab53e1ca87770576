"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from lectern.llm import bpe, embeddings, exact, html, language, lines, merkle, packing, ranks, runs, sharding, simhash, toxicity  # noqa: F401
from lectern.llm.common import ORACLES, QUERIES  # noqa: F401
