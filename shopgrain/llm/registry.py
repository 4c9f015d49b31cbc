"""Queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op12_minimal_hash
from .bpe import op13_prefix_bpe
from .decontamination import op1_pigeonhole_edit
from .html import op6_host_suffix_array
from .langid import op3_nearest_centroid
from .lmscore import op5_context_mixing
from .neardup import op10_chosen_path
from .packing import op2_bin_completion
from .runs import op11_difference_cover
from .sharding import op8_virtual_slots
from .substrings import op7_rabin_karp
from .suffixdedup import op9_induced_sorting
from .topk import op4_pivot_distance

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pigeonhole_edit, op2_bin_completion, op3_nearest_centroid, op4_pivot_distance, op5_context_mixing, op6_host_suffix_array, op7_rabin_karp, op8_virtual_slots, op9_induced_sorting, op10_chosen_path, op11_difference_cover, op12_minimal_hash, op13_prefix_bpe)}
ORACLES: dict[str, str] = {
    "op4_pivot_distance": """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.id AS query_id, c.id AS vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id % 50 = 0 AND c.id <> q.id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
