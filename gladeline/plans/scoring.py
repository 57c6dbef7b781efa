"""The scoring run: compare, select, refit, score every parcel, store, and list the parcels to watch."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gladeline.plans.modelling import BINARY, FEATURE_SETS, MODELS, Settings, compare_models, score_all, select_best
from gladeline.session import cut_lineage
from gladeline.sources.store import apply_scores, read_table, write_snapshot


@dataclass(frozen=True)
class ScoringRun:
    """What a run leaves behind: the comparison, the variant chosen, and the scored frame."""

    comparison: DataFrame
    model: str
    features: str
    scored: DataFrame


def scoring_run(
    frame: DataFrame, store: str, settings: Settings = Settings(), sets: Mapping[str, Sequence[str]] = FEATURE_SETS,
    kinds: Sequence[str] = MODELS, refit: Settings | None = None,
) -> ScoringRun:
    """Score every parcel with the best binary variant and store class and score as a new version of the assessments.

    ``refit`` are the settings of the last fit on all labelled rows, those of the comparison by default.
    """
    frame = cut_lineage(frame)
    comparison = cut_lineage(compare_models(frame, settings, sets, kinds))
    best = select_best(comparison, sets).first()
    scored = cut_lineage(score_all(frame, best["model"], sets[best["features"]], BINARY, refit or settings))
    assessments = read_table(frame.sparkSession, store, "assessments")
    write_snapshot(apply_scores(assessments, scored.select("farm_id", "risk_score", "risk_class")), store, "assessments")
    return ScoringRun(comparison, best["model"], best["features"], scored)


def watch_list(scored: DataFrame, context: Sequence[str], n: int = 10) -> DataFrame:
    """Clean parcels with the highest modelled risk, with the context columns that explain it; ties go by id."""
    clean = scored.filter(F.col("risk_binary") == "CLEAN")
    return clean.select("farm_id", "area_ha", *context, "risk_score").orderBy(F.desc_nulls_last("risk_score"), "farm_id").limit(n)
