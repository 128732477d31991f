"""Registered queries against their oracle SQL at the smallest scale.

By default a spread of quick queries runs; ``FULL_ORACLE=1`` runs every query that has an oracle.
"""

import os

import pytest

import __spark_entry__ as entry

from .oracle import connect, differences

SF_DIR = "/root/testdata/sf0.001"
QUICK = [
    "qc_reasons", "population_funnel", "target_profile_by_stage", "standardized_columns", "content_fingerprint", "round_labels", "signatures",
    "assigned_groups", "exclude_known", "weighted_descriptors", "within_group_percentile", "grouped_folds", "task_chunks", "group_mean_oof",
    "spearman_by_model", "top_fraction_overlap", "cluster_bootstrap", "observed_bounds", "weighted_choice", "percentile_ranks", "applicability_domain_cells",
    "tuned_forest", "extra_trees_nodes", "regularized_first_tree", "neighbour_mutual_information", "mrmr_neighbours", "published_run", "paired_bootstrap", "panel_profile",
]
ORACLES = entry.oracle_sql()
NAMES = sorted(ORACLES) if os.environ.get("FULL_ORACLE") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not available")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    assert differences(entry.queries()[name](spark, SF_DIR), con, ORACLES[name]) is None


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_flagship(spark):
    places = [r["place"] for r in entry.entry(spark).orderBy("place").collect()]
    assert places == [1, 2, 3]
