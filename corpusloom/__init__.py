"""Semantic corpus search on Spark: scan, chunk, embed, upsert, search."""

import sys

from pyspark import cloudpickle

from corpusloom.config import Settings, SourceRoot
from corpusloom.operators.chunk import chunk_files
from corpusloom.operators.embed import HashEmbedder, ModelEmbedder, embed_documents, embed_queries, embed_query
from corpusloom.operators.search import search, search_batch

__all__ = [
    "HashEmbedder",
    "ModelEmbedder",
    "Settings",
    "SourceRoot",
    "chunk_files",
    "embed_documents",
    "embed_queries",
    "embed_query",
    "search",
    "search_batch",
]

# Functions of this package travel to the executors by value: nothing to install there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
