"""Row-local operators on streaming frames.

The operators that work row by row (validation, scalar functions, windowing, crops, scoring,
score features) are plain projections and generators, and take a streaming DataFrame as they
are. ``score_stream`` is their composition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.windows import make_windows
from ..plans.contigs import Scorer


def score_stream(
    sequences: DataFrame, scorer: Scorer, size: int, stride: int, min_len: int | None = None
) -> DataFrame:
    """Scored windows of a stream of sequences; no state is kept."""
    return scorer(make_windows(sequences, size, stride, min_len=min_len))
