"""Schemas of object tables, enumerations, and the one rule for missing values.

NaN, None and empty strings all mean missing in the inputs. Inside the engine missing is NULL, so means, medians and
quantiles skip it; ``ingest`` is where the change is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phase codes of a voxel: fixed values.
PHASES = {"outside": 0, "air": 1, "ice": 2, "grain": 3}
#: Edge of a voxel in micrometres, and of one of a map binned by two: fixed values.
VOXEL_UM, BINNED_UM = 24.7660229, 49.532

GRAINS = "specimen string, scan int, grain_id long, voxels long, z double, y double, x double, r_vox double"
THROATS = "specimen string, scan int, bead_a long, bead_b long, gap_vox double, dsum_min double, crack_vox double, crack_frac double, cover_a double, cover_b double, q_crack double, connected boolean"
VOXELS = "scan int, z int, y int, x int, grey double"
#: Columns of a correlation result, in file order: fixed values of the format.
CORRELATION = "NodeNumber int, Zpos double, Ypos double, Xpos double, Fzz double, Fzy double, Fzx double, Zdisp double, Fyz double, Fyy double, Fyx double, Ydisp double, Fxz double, Fxy double, Fxx double, Xdisp double, error double, iterations int, returnStatus int, deltaPhiNorm double"
CUBES = "tag string, cube_vox int, n_cubes int, n_ok int, cubes array<struct<z_frac: double, phi_ice: double, tau_z: double, Deff: array<double>, tau: array<double>, ok: boolean, error: string>>, seconds int, tau_ice double, tau_ice_sd double, phi_ice_cube double"


def ingest(df: DataFrame) -> DataFrame:
    """``df`` with NaN and empty strings as NULL, in every double, float and string column."""
    fixed = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        fixed.append((F.when(~F.isnan(c), c) if kind in ("double", "float") else F.when(c != "", c) if kind == "string" else c).alias(name))
    return df.select(*fixed)
