"""Registry of the engine's queries and of the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratapack.plans import oracles
from stratapack.plans import queries as q

flagship = q.flagship

#: Every public function of the queries module with (spark, sf_dir) is a query.
NAMES = (
    "flagship scan_canonical_order classify_text route_matrix route_counts extension_stats content_digest fnv_checksum rolling_hash file_dedup dedup_savings block_dedup "
    "token_dictionary dictionary_roundtrip gzip_normalize delta_roundtrip branch_roundtrip byte_histogram entropy cosine_neighbors similarity_chain solid_groups cdc_chunks "
    "chunk_dedup block_layout codec_best_of_n codec_selective archive_roundtrip archive_write_read archive_balanced archive_max archive_insane archive_chunk_scope archive_verify archive_tamper missing_blocks roundtrip_multiset path_guard stamp_parse "
    "dictionary_sizes legacy_spans bench_matrix bench_aggregate bench_baseline bench_weissman bench_tool_scores bench_delta bench_gate bench_best_rival"
).split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: getattr(q, n) for n in NAMES}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
