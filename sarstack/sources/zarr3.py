"""Zarr v3 stores of complex scenes as a Spark data source.

Layout: ``{store}/{group}/{scene}/re|im/c/{iy}/{ix}`` chunks, Zstandard-coded
int16 or float32 with ``scale_factor`` and ``_FillValue`` in the attributes of
the array's ``zarr.json``; the scene's own ``zarr.json`` holds its metadata
(startTime, polarization, burst, BPR). An absent chunk is a block without
data, and its rows are simply not there.

Each chunk is one input partition, so the planner sees as many tasks as there
are chunks, and filters on burst, polarization, date and index ranges drop
chunks before anything is read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "burst string, pol string, date timestamp, bpr double, yi int, xi int, re double, im double"


@dataclass
class Chunk(InputPartition):
    path: str
    burst: str
    pol: str
    date: str
    bpr: float | None
    iy: int
    ix: int
    shape: tuple[int, int]
    chunk: tuple[int, int]
    dtype: str
    scale: float
    fill: float | None


def _json(fs: pafs.FileSystem, path: str) -> dict | None:
    try:
        with fs.open_input_stream(path) as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return None


def decode(raw: bytes | None, dtype: str, chunk: tuple[int, int], scale: float, fill: float | None) -> np.ndarray:
    """One chunk as doubles; absent or filled values are NaN."""
    if raw is None:
        return np.full(chunk, np.nan)
    data = pa.input_stream(pa.py_buffer(raw), compression="zstd").read()
    v = np.frombuffer(data, "<i2" if dtype == "int16" else "<f4").reshape(chunk)
    out = v.astype(float) * scale
    if fill is not None:
        out[v == fill] = np.nan
    return out


class ZarrReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.kept: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list) -> Iterator:
        """Takes comparisons that can drop chunks; all rows are filtered again by Spark."""
        ops = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            name = f.attribute[0] if type(f) in ops else None
            if name in ("burst", "pol", "yi", "xi"):
                self.kept.append((name, ops[type(f)], f.value))
            yield f

    def _may_hold(self, c: Chunk) -> bool:
        lo = {"yi": c.iy * c.chunk[0], "xi": c.ix * c.chunk[1]}
        hi = {"yi": min(lo["yi"] + c.chunk[0], c.shape[0]) - 1, "xi": min(lo["xi"] + c.chunk[1], c.shape[1]) - 1}
        for name, op, v in self.kept:
            if name in ("burst", "pol"):
                if op == "=" and getattr(c, name) != v:
                    return False
            elif (op == "=" and not lo[name] <= v <= hi[name]) or (op == ">" and hi[name] <= v) or (op == ">=" and hi[name] < v) or (op == "<" and lo[name] >= v) or (op == "<=" and lo[name] > v):
                return False
        return True

    def partitions(self) -> list[Chunk]:
        fs, root = pafs.FileSystem.from_uri(self.uri)
        out: list[Chunk] = []
        for group in sorted(x.path for x in fs.get_file_info(pafs.FileSelector(root)) if x.type == pafs.FileType.Directory):
            for scene in sorted(x.path for x in fs.get_file_info(pafs.FileSelector(group)) if x.type == pafs.FileType.Directory):
                meta, arr = _json(fs, f"{scene}/zarr.json"), _json(fs, f"{scene}/re/zarr.json")
                if not meta or not arr or "startTime" not in meta.get("attributes", {}):
                    continue
                a, own = meta["attributes"], arr.get("attributes", {})
                shape, chunk = tuple(arr["shape"]), tuple(arr["chunk_grid"]["configuration"]["chunk_shape"])
                for iy in range(-(-shape[0] // chunk[0])):
                    for ix in range(-(-shape[1] // chunk[1])):
                        c = Chunk(scene, group.rsplit("/", 1)[-1], a.get("polarization", ""), a["startTime"], a.get("BPR"), iy, ix, shape, chunk, arr["data_type"], float(own.get("scale_factor", 1.0)), own.get("_FillValue"))
                        if self._may_hold(c):
                            out.append(c)
        c0 = [(c.burst, c.pol, c.date, c.iy, c.ix) for c in out]
        if len(c0) != len(set(c0)):
            raise ValueError("a burst has two scenes of one date")
        return out

    def read(self, c: Chunk) -> Iterator[pa.RecordBatch]:
        if not isinstance(c, Chunk):
            return
        fs, _ = pafs.FileSystem.from_uri(self.uri)

        def part(name: str) -> np.ndarray:
            try:
                with fs.open_input_stream(f"{c.path}/{name}/c/{c.iy}/{c.ix}") as f:
                    raw = f.read()
            except FileNotFoundError:
                raw = None
            return decode(raw, c.dtype, c.chunk, c.scale, c.fill)

        re, im = part("re"), part("im")
        ok = np.isfinite(re) & np.isfinite(im)
        y, x = np.nonzero(ok)
        yi, xi = y + c.iy * c.chunk[0], x + c.ix * c.chunk[1]
        inside = (yi < c.shape[0]) & (xi < c.shape[1])
        y, x, yi, xi = y[inside], x[inside], yi[inside], xi[inside]
        n = len(y)
        if n:
            date = datetime.fromisoformat(c.date.replace("Z", ""))
            yield pa.RecordBatch.from_arrays(
                [pa.array([c.burst] * n), pa.array([c.pol] * n), pa.array([date] * n, pa.timestamp("us", "UTC")), pa.array([c.bpr] * n, pa.float64()), pa.array(yi.astype(np.int32)), pa.array(xi.astype(np.int32)), pa.array(re[y, x]), pa.array(im[y, x])],
                names=["burst", "pol", "date", "bpr", "yi", "xi", "re", "im"],
            )


class ZarrSource(DataSource):
    """``spark.read.format("zarr3").load(uri)`` after ``register(spark)``."""

    @classmethod
    def name(cls) -> str:
        return "zarr3"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZarrReader:
        return ZarrReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZarrSource)


def write_scene(root: str, group: str, scene: str, z: np.ndarray, attrs: dict, chunk: tuple[int, int] = (64, 64), scale: float = 0.5) -> None:
    """Write one scene as int16 chunks; blocks without data are left out. For tests and small exports."""
    fs, base = pafs.FileSystem.from_uri(root)
    at = f"{base}/{group}/{scene}"
    meta = lambda d, body: (fs.create_dir(d, recursive=True), _put(fs, f"{d}/zarr.json", json.dumps(body).encode()))
    meta(at, {"zarr_format": 3, "node_type": "group", "attributes": attrs})
    for name, part in (("re", z.real), ("im", z.imag)):
        meta(f"{at}/{name}", {"zarr_format": 3, "node_type": "array", "shape": list(z.shape), "data_type": "int16", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(chunk)}}, "attributes": {"scale_factor": scale, "_FillValue": 32767}})
        for iy in range(-(-z.shape[0] // chunk[0])):
            for ix in range(-(-z.shape[1] // chunk[1])):
                block = part[iy * chunk[0] : (iy + 1) * chunk[0], ix * chunk[1] : (ix + 1) * chunk[1]]
                if not np.isfinite(block).any():
                    continue
                full = np.full(chunk, 32767, "<i2")
                full[: block.shape[0], : block.shape[1]] = np.where(np.isfinite(block), np.round(np.nan_to_num(block) / scale), 32767)
                sink = pa.BufferOutputStream()
                with pa.CompressedOutputStream(sink, "zstd") as f:
                    f.write(full.tobytes())
                fs.create_dir(f"{at}/{name}/c/{iy}", recursive=True)
                _put(fs, f"{at}/{name}/c/{iy}/{ix}", sink.getvalue().to_pybytes())


def _put(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    with fs.open_output_stream(path) as f:
        f.write(data)
