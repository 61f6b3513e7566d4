"""Every registered query with SQL gives the same rows on the smallest driver tables."""

import os

import pytest

import compare
from tonearm.queries import catalogue

FOLDER = os.environ.get("ORACLE_FOLDER", "/root/testdata/sf0.001")
# The heavy ones are covered by one representative unless everything is asked for.
QUICK = """
conform_schema parse_bool split_tags clean_lyric_text excerpt line_count duration_text fold_tempo union_by_name
dedup_most_complete latest_nonblank_merge merge_tag_tables lyric_terms_topk title_terms assemble_tags
frequency_distinct dynamic_score recommend chart_table batch last_n history_preference search_similar
nearest_neighbors label_similarity catalog_variants match_shortcuts snapshot_flatten snapshot_upsert
audio_measures chunk_windows merge_sink lyric_files last_n_stream upsert_stream history_stream
tag_csv_folder lyric_folder snapshot_folder audio_folder embedding_files jsonl_records history_array_file
""".split()
NAMES = sorted(catalogue.ORACLE) if os.environ.get("ORACLE_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    assert compare.difference(spark, con, FOLDER, catalogue.QUERIES[name], catalogue.ORACLE[name]) is None


def test_registry_names_are_consistent():
    assert set(catalogue.ORACLE) <= set(catalogue.QUERIES)
