"""A cross-section of the catalogue beside its SQL; ``python tests/compare.py <dir>`` runs all of it."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"

CHECKED = (
    "mosaic", "mosaic_masked", "table_query", "list_farms_first_page", "get_farm", "page", "clip", "resample", "loss_mask", "zonal_sum", "parcel_context", "buffer_runs", "both_distances",
    "connected_components", "assign_farm_id", "build_parcels", "list_farms", "early_warning", "class_stats",
    "stats_document", "describe", "masking_report", "roc_auc", "classification_report", "stratified_folds",
    "key_violations", "polygonize_parcels",
)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, SF) == ""


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 10


def test_watch_list_builds_one_mosaic(spark, monkeypatch):
    from gladeline import standin

    built, cells = [], standin.cells
    monkeypatch.setattr(standin, "cells", lambda *at: built.append(at) or cells(*at))
    assert queries()["watch_list"](spark, SF).count() <= 25 and len(built) == 1
