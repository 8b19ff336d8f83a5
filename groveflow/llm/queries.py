"""All queries of this subpackage: importing a module registers its query."""

import corpus_pipeline
import groveflow.llm.balltree  # noqa: F401
import groveflow.llm.bpe  # noqa: F401
import groveflow.llm.chat  # noqa: F401
import groveflow.llm.decontaminate  # noqa: F401
import groveflow.llm.digest  # noqa: F401
import groveflow.llm.jaccard  # noqa: F401
import groveflow.llm.language  # noqa: F401
import groveflow.llm.licenses  # noqa: F401
import groveflow.llm.lmscore  # noqa: F401
import groveflow.llm.personal  # noqa: F401
import groveflow.llm.suffixes  # noqa: F401
import groveflow.llm.trie  # noqa: F401
import groveflow.llm.urls  # noqa: F401
from groveflow.llm.registry import QUERIES, SQL, query

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
__all__ = ["QUERIES", "SQL"]
