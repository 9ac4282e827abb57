"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .balltree import op11_hard_negatives, op11_sql
from .forest import op3_nearest
from .hamming import op4_embedding_dedup
from .jaccard import op5_ngram_jaccard
from .licenses import op2_license_scan, op2_sql
from .lloyd import op13_centroids, op13_sql
from .packing import op1_packing
from .pieces import op8_piece_dropout
from .pii import op6_pii
from .pseudo import op7_pseudo_likelihood
from .tokenfile import op10_token_files
from .toxicity import op9_toxicity
from .urls import op12_sql, op12_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_license_scan, op3_nearest, op4_embedding_dedup, op5_ngram_jaccard, op6_pii, op7_pseudo_likelihood, op8_piece_dropout, op9_toxicity, op10_token_files, op11_hard_negatives, op12_url_filter, op13_centroids)}


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": op2_sql(), "op11_hard_negatives": op11_sql(), "op12_url_filter": op12_sql(), "op13_centroids": op13_sql()}
