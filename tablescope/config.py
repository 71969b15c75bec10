"""Thresholds shared by all operators.

Each field can be overridden by an environment variable named
``TABLESCOPE_<FIELD>``, read once when the module is imported.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

ENV_PREFIX = "TABLESCOPE_"


@dataclass(frozen=True)
class Settings:
    # These decide results.
    sample_rows: int = 20_000
    line_sample_rows: int = 5_000
    wilk_rows: int = 5_000
    preview_rows: int = 500
    sparse_missing_frac: float = 0.60
    rare_category_frac: float = 0.02
    winsor_frac: float = 0.01
    near_zero_variance_frac: float = 0.01
    id_uniqueness_ratio: float = 0.95
    categorical_max_unique_ratio: float = 0.5
    categorical_max_unique_abs: int = 50
    text_avg_len: int = 30
    high_cardinality: int = 100
    numeric_success_rate: float = 0.5
    datetime_success_rate: float = 0.6
    datetime_success_rate_unhinted: float = 0.9
    iqr_multiplier: float = 1.5
    zscore_threshold: float = 3.0
    iqr_to_sigma: float = 0.7413
    contamination: float = 0.05
    min_rows_anomaly: int = 10
    alpha: float = 0.05
    correlation_strong: float = 0.7
    correlation_moderate: float = 0.4
    confidence_level: float = 0.95
    min_rows_forecast: int = 14
    min_rows_ml: int = 30
    test_size: float = 0.2
    cv_folds: int = 5
    max_kmeans_k: int = 8
    forest_trees: int = 150
    max_onehot_levels: int = 20
    seed: int = 42
    weight_completeness: float = 0.4
    weight_uniqueness: float = 0.2
    weight_consistency: float = 0.2
    weight_validity: float = 0.2

    # Execution bounds: these decide only how a result is computed.
    exact_rows: int = 200_000
    hot_group_rows: int = 1_000_000
    split_block_rows: int = 500_000
    sketch_accuracy: int = 1_000
    prefix_buckets: int = 10_000


def load_settings(environ=os.environ) -> Settings:
    """Settings with the overrides found in ``environ``; unreadable values are ignored."""
    found = {}
    for spec in fields(Settings):
        raw = environ.get(ENV_PREFIX + spec.name.upper())
        if raw is None:
            continue
        try:
            found[spec.name] = type(spec.default)(raw)
        except ValueError:
            continue
    return Settings(**found)


SETTINGS = load_settings()
