"""Registered queries of a job or two beside their SQL, on the smallest tables: names of columns and all rows."""

import os

import duckdb
import pytest

from tracegraph.plans import queries

DATA = "/root/testdata/sf0.001"
NAMES = [
    "read_nodes", "read_edges", "edges_not_seger", "read_segments", "segment_counts", "segments_to_nodes", "segments_to_edges", "migrated_nodes", "migrated_edges",
    "crop_constant", "crop_reflect", "slab", "level_info", "add_nodes", "add_edges", "delete_nodes", "delete_edges", "delete_cascade", "change_type", "update_nodes",
    "check_nodes", "max_nid", "last_task", "roi_nodes", "tiles_clipped", "tiles_whole", "tiles_sliding", "tiles_spliced", "tiles_spliced_by_size", "edge_boxes",
    "local_points", "degree", "induced_edges", "dangling", "edges_by_creator", "sharp_bends", "edge_lengths", "down_sampled", "contrast", "overlay", "image_pairs",
]


def plain(value) -> str:
    """One spelling for a value of either engine."""
    if value is None or value != value:
        return "null"
    return repr(float(value)).removesuffix(".0") if isinstance(value, float) else str(value)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    with duckdb.connect() as con:
        for file in os.listdir(DATA):
            if file.endswith(".parquet"):
                con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{DATA}/{file}'")
        want = con.execute(queries.SQL[name])
        columns, rows = [c[0] for c in want.description], want.fetchall()
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert sorted([plain(v) for v in r] for r in got.select(*columns).collect()) == sorted([plain(v) for v in r] for r in rows)
