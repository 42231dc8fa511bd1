"""Columns of the tables that the operators pass to one another.

Every table carries ``arbor_id``, so that one plan works on a whole forest.
"""

from __future__ import annotations

NODES = "arbor_id bigint, nid bigint, pid bigint, x double, y double, z double"
NODES_STRAHLER = NODES + ", strahler int"
INDEX = (
    "depth bigint, dfs bigint, size bigint, bfs bigint, n_children bigint, order_no int, "
    "seg_head bigint, seg_depth bigint, seg_id bigint, seg_pos int, root_nid bigint"
)
INDEXED = NODES + ", " + INDEX
MASKS = "arbor_id bigint, nid bigint, i int, j int, k int, v tinyint"
VOXELS = "arbor_id bigint, vx bigint, vy bigint, vz bigint, seg_count int, view_count int, distance double"
BLOCKS = "arbor_id bigint, bx bigint, by bigint, bz bigint, uniform double, data array<double>"
RANKINGS = "arbor_id bigint, nid bigint, pid bigint, connectivity double, branch_score double, dx double, dy double, dz double"
EDGES = "u bigint, v bigint, score double"
FRAGMENTS = "x bigint, y bigint, z bigint, frag_id bigint"
