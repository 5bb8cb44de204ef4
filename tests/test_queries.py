"""Registered queries against their SQL, on the smallest tables."""

from __future__ import annotations

import ast
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from plumbline import queries as core

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = "mask_algebra coverage_union run_mask_scores handle_sets pool_max_3d windows_2d voxel_store voxel_cube negative_planes plane_metrics chamfer_of_normals camera_rays view_look_at euler_orders least_rotations smoothed_vertices least_cost_assignments nn_self knn_k5 top_planes split_names greedy_matching tumbling session quaternion_laws axis_angles planar_motions rigid_motions plane_depths pixel_kinds masked_bounds segment_normals plane_least_squares gaussian_path ended_groups transfer_parts vertex_normals fan_triangles plane_instances joint_values intrinsics_and_crops screen_coordinates cone_parts turns_about_axes group_elements scaled_bundles points_on_planes overlap_scores limits_of_joints".split()


@pytest.fixture(scope="module")
def sql():
    if not os.path.isdir(SF_DIR):
        pytest.skip("the driver's tables aren't here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def rows(table) -> list[tuple]:
    return sorted((tuple(r.values()) for r in table.select(sorted(table.column_names)).to_pylist()), key=repr)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, sql, name):
    want = sql.sql(core.oracle_sql()[name])
    want = want.to_arrow_table() if hasattr(want, "to_arrow_table") else want.arrow().read_all()
    got = core.queries()[name](spark, SF_DIR).toArrow()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


def test_most_queries_have_sql():
    without = set(core.queries()) - set(core.oracle_sql())
    assert without == {"kmeans_top", "box_split", "ransac_planes", "weighted_draws"}


def test_names_are_known_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)


@pytest.mark.parametrize("module", ["queries", "function_queries"])
def test_every_name_is_given_once(module):
    tree = ast.parse((Path(core.__file__).parent / f"{module}.py").read_text())
    names = [x.name for x in tree.body if isinstance(x, ast.FunctionDef)]
    names += [t.id for x in tree.body if isinstance(x, ast.Assign) for t in x.targets if isinstance(t, ast.Name)]
    assert len(names) == len(set(names))
