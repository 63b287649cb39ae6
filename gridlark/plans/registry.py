"""Queries by name, and the SQL that gives the same rows."""

from . import analysis, axisymmetric, grid, mesh, tensors, trees

MODULES = (grid, trees, mesh, tensors, analysis, axisymmetric)
QUERIES: dict = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
FLAGSHIP = "mesh_l2_norm"
