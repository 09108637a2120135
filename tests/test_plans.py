"""Plans and invariants of the registered queries."""

import re

import pytest

import __spark_entry__ as entry
from tunespark.jobs.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["query_id", "track_id", "score", "rank"]


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["d6_energy", "e2_apply_filters", "f1_cosine_scores", "i3_agreement_summary", "j2_find_or_create", "j9_add_tracks"])
def test_no_python_and_no_single_task_window(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("BatchEvalPython|ArrowEvalPython|MapIn|InPandas", plan)
    assert not re.search(r"Window(?!GroupLimit)[^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*SinglePartition", plan)


def test_scan_reads_only_what_it_needs(spark):
    plan = QUERIES["j7_playlist_overview"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "o_totalprice" not in plan


@pytest.mark.parametrize("name", ["f2_rank_top_k", "f4_artist_cap", "f5_filtered_search", "f6_similar_to", "f8_blend", "h1_find_tracks"])
def test_requests_meet_the_catalog_in_tiles_alone(spark, name):
    """No join of requests with tracks, no interpreted function over vectors' components but the check of each vector, and k rows a request and task in the ranking's exchange."""
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "zip_with(q_vector" not in plan
    if name != "h1_find_tracks":
        assert "MapInArrow" in plan


def test_only_the_best_leave_a_task(spark):
    from tunespark.jobs import fixtures as X
    from tunespark.operators import tiles

    tracks, queries = X.catalog(spark, SF).repartition(3), X.query_vectors(spark, SF).withColumnRenamed("vector", "q_vector")
    hits = tiles.top_k(queries, tracks, 4)
    n = queries.count()
    assert hits.where("track_id is not null").count() == 3 * 4 * n and hits.where("track_id is null").count() == 3 * n


def test_genre_agreement_starts_from_written_neighbours(spark):
    """The lists come from a table; no pairs of blocks go through an exchange of the query's own."""
    plan = QUERIES["i4_genre_agreement"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "Generate" not in plan
