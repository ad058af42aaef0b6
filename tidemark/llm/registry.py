"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.clusters import OP11_SQL, op11_query
from tidemark.llm.common import table
from tidemark.llm.jaccard import op10_query
from tidemark.llm.langid import op8_query
from tidemark.llm.mixing import OP2_SQL, op2_query
from tidemark.llm.pii import op9_query
from tidemark.llm.quality import op5_query
from tidemark.llm.sharding import op1_query
from tidemark.llm.tokencount import op4_query
from tidemark.llm.tokenfile import op7_query
from tidemark.llm.vectors import op3_query
from tidemark.llm.warc import OP13_SQL, op13_query
from tidemark.llm.whitening import op12_query


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.bpe import bpe_digest

    return bpe_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_label_propagation_shards": op1_query,
    "op2_sainte_lague_mix": op2_query,
    "op3_cross_polytope_links": op3_query,
    "op4_trie_token_counts": op4_query,
    "op5_ngram_quality": op5_query,
    "op6_forced_boundary_bpe": op6_query,
    "op7_mph_token_files": op7_query,
    "op8_segmentation_langid": op8_query,
    "op9_disclosure_sanitiser": op9_query,
    "op10_jaccard_metric_join": op10_query,
    "op11_heap_bound_kmeans": op11_query,
    "op12_block_matrix_whitening": op12_query,
    "op13_warc_capture_index": op13_query,
}

ORACLE_SQL: dict[str, str] = {"op2_sainte_lague_mix": OP2_SQL, "op11_heap_bound_kmeans": OP11_SQL, "op13_warc_capture_index": OP13_SQL}
