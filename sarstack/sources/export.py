"""Exports that leave Spark: one raster as legacy VTK, a product as one archive."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pixels up to which a raster may be gathered for a VTK file.
MAX_PIXELS = 16_000_000


def to_vtk(df: DataFrame, path: str, values: list[str], dy: float = 1.0, dx: float = 1.0) -> None:
    """Write one raster (yi, xi, values) as VTK structured points; missing pixels are nan."""
    box = df.agg(F.min("yi").alias("y0"), F.max("yi").alias("y1"), F.min("xi").alias("x0"), F.max("xi").alias("x1")).first()
    if box.y0 is None:
        raise ValueError("the raster is empty")
    ny, nx = box.y1 - box.y0 + 1, box.x1 - box.x0 + 1
    if ny * nx > MAX_PIXELS:
        raise ValueError(f"{ny} x {nx} pixels; at most {MAX_PIXELS} fit in one file")
    t = df.select("yi", "xi", *values).toArrow()
    at = (t.column("yi").to_numpy() - box.y0) * nx + t.column("xi").to_numpy() - box.x0
    with open(path, "w", encoding="ascii") as f:
        f.write(f"# vtk DataFile Version 3.0\nsarstack\nASCII\nDATASET STRUCTURED_POINTS\nDIMENSIONS {nx} {ny} 1\nORIGIN {box.x0 * dx} {box.y0 * dy} 0\nSPACING {dx} {dy} 1\nPOINT_DATA {ny * nx}\n")
        for v in values:
            grid = np.full(ny * nx, np.nan)
            grid[at] = t.column(v).to_numpy(zero_copy_only=False).astype(float)
            f.write(f"SCALARS {v} float 1\nLOOKUP_TABLE default\n")
            np.savetxt(f, grid.reshape(ny, nx), fmt="%.6g")


def archive(df: DataFrame, path: str) -> str:
    """The product's Parquet files as one ZIP on the driver's machine (local mode or a shared disk)."""
    with tempfile.TemporaryDirectory() as d:
        df.write.parquet(f"file://{d}/product")
        return shutil.make_archive(str(Path(path).with_suffix("")), "zip", d)
