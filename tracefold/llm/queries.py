"""All registered queries of the operators; importing the modules registers them."""

from __future__ import annotations

from tracefold.llm import (  # noqa: F401
    decontaminate, language, licenses, neighbours, packing, quality, ranking, sharding, simhash,
    tokens, toxicity, urls, warc,
)
from tracefold.llm.common import QUERIES, SQL  # noqa: F401
