"""The whole preparation of a feature panel for training, in order."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, types as T

from ..functions.numeric import finite
from ..operators import prepare, quality, registry, selection, splits
from ..session import compiled, written


class Prepared(NamedTuple):
    """The scaled table, its features, the columns that left at each step, the fitted scales, and the cleaned table before selection."""

    table: DataFrame
    features: list[str]
    gone: dict[str, list[str]]
    scales: dict[str, prepare.Scale]
    cleaned: DataFrame


def numeric_features(panel: DataFrame) -> list[str]:
    numeric = [f.name for f in panel.schema.fields if isinstance(f.dataType, T.NumericType)]
    return [c for c in registry.feature_columns(numeric) if c not in registry.IDENTIFIERS]


def clean_panel(panel: DataFrame, clip: str = "iqr", only: list[str] | None = None) -> tuple[DataFrame, list[str], list[str]]:
    """Identifiers, targets, split and numeric features: empty columns out, missing values filled, outliers clipped.

    Everything fitted uses the training rows.  Features are treated one by one, so with ``only`` the others are neither
    computed nor written.  The panel is written once, and once more if a value was filled; clipping is a projection of
    that.  Returns the table, its features and the empty columns.
    """
    panel = panel if "split" in panel.columns else splits.temporal_split(panel)
    features = [c for c in numeric_features(panel) if only is None or c in only]
    ids = [c for c in panel.columns if c in registry.IDENTIFIERS or c == "split" or registry.is_target(c)]
    with compiled(panel.sparkSession):
        base = written(panel.select(*ids, *[finite(c).alias(c) for c in features]), "panel")
    shares = prepare.null_shares(base, features)
    empty = [c for c in features if shares[c] >= 1.0]
    features = [c for c in features if c not in empty]
    present = base.drop(*empty)
    filled = prepare.impute(present, features, stored=True, shares=shares)
    filled = filled if filled is present else written(filled, "filled")
    return prepare.clip_outliers(filled, features, clip, stored=True), features, empty


def prepared_panel(
    panel: DataFrame, target: str = "target_5", with_sentiment: bool = True, k: int | None = None, clip: str = "iqr", scale: str = "robust",
    score: str = "mutual_info",
) -> Prepared:
    """Clean, choose the k best features (protected ones first), prune correlated ones, scale.

    Targets and identifiers are neither clipped nor scaled.  Scores, correlations and scales come from the training rows.
    """
    cleaned, features, empty = clean_panel(panel, clip)
    chosen = selection.select_k_best(cleaned, features, target, with_sentiment, score, k)
    kept = selection.prune_correlated(cleaned, chosen, target, with_sentiment)
    scales = prepare.fit_scales(cleaned, kept, scale, stored=True)
    ids = [c for c in cleaned.columns if c not in features]
    table = prepare.apply_scales(cleaned.select(*ids, *kept), scales)
    gone = {"empty": empty, "not selected": [c for c in features if c not in chosen], "correlated": [c for c in chosen if c not in kept]}
    return Prepared(table, kept, gone, scales, cleaned)


def preparation_summary(made: Prepared, with_sentiment: bool = True) -> DataFrame:
    """One row: features against their goals, and the share of training rows."""
    goal = selection.K_ENHANCED if with_sentiment else selection.K_BASELINE
    return quality.preparation_report(made.table, made.features, goal, with_sentiment)
