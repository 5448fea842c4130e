"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from spanloom.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return str(value) if isinstance(value, (str, bool)) else f"{float(value):.5f}"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    picks = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in picks) for r in want.fetchall())


def test_tracks_count_every_detection(spark):
    got = QUERIES["box_tracks"](spark, SF).collect()
    assert sum(r.observations for r in got) == spark.read.parquet(f"{SF}/events.parquet").count()
    assert len({(r.source, r.track) for r in got}) == len(got)


def test_only_what_sql_cannot_say_has_no_sql():
    """They are held against brute force or cases instead: test_folds_and_streams.py, test_addresses.py, test_scrolling.py, test_watermarks.py, test_fixed_text.py, test_absorption.py, test_text_tracks.py, test_scenes.py, test_subtitles.py."""
    assert set(QUERIES) - set(ORACLES) == {"box_tracks", "promoted_addresses", "scrolling_lines", "repeated_marks", "fixed_overlays", "known_reads", "reconciled_cards", "refined_regions", "text_tracks", "safety_cards", "subtitle_lines"}


def test_no_query_is_empty_or_a_nested_loop(spark):
    for name in ("edit_distance_match", "nearest_memory", "platform_names"):
        df = QUERIES[name](spark, "/root/testdata/sf0.01")
        assert df.count() > 0
        assert "NestedLoop" not in df._jdf.queryExecution().toString() and "Cartesian" not in df._jdf.queryExecution().toString()
