"""Height tiles as a data source: windows of tile files as partitions, bounds and layers pushed down, a writer for the same format.

A file is the compressed text 'CLID', the length of a JSON header, the header, and two grids of unsigned 16-bit decimetres, south first. The folder
must be one that all executors open by its path.
"""

from __future__ import annotations

import gzip
import json
import math
import os
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

#: Fixed values of the format: its mark, version and no-data value, and the longest side of a window in metres.
MAGIC, VERSION, VOID, MOST_WINDOW_M = b"CLID", 1, 0xFFFF, 2400
LAYERS = ("ndsm", "terrain")
SCHEMA = "tile string, layer string, x double, y double, metres double"
_NAME = re.compile(rf"^(-?\d+_-?\d+)\.v{VERSION}\.bin\.gz$")


def windows(low: int, high: int, most: int = MOST_WINDOW_M) -> list[tuple[int, int]]:
    """Near-equal whole pieces of a span, none longer than ``most`` by more than rounding; they meet without gaps."""
    parts = max(1, math.ceil((high - low) / most))
    edges = [low + math.floor((high - low) * i / parts + 0.5) for i in range(parts)] + [high]
    return list(zip(edges, edges[1:]))


def encode(key: str, grids: dict[str, dict], cells: dict[str, np.ndarray], fetched_at: str = "") -> bytes:
    """A tile file of metres by layer; null values are NaN. Heights are rounded to decimetres and held between 0 and 6553.4 m."""
    header = json.dumps({"v": VERSION, "key": key, "fetchedAt": fetched_at, **grids}).encode()
    body = [MAGIC, struct.pack("<I", len(header)), header]
    for layer in LAYERS:
        metres = np.asarray(cells[layer], np.float64).ravel()
        known = ~np.isnan(metres)
        out = np.full(len(metres), VOID, "<u2")
        out[known] = np.clip(np.floor(metres[known] * 10 + 0.5), 0, VOID - 1)
        body.append(out.tobytes())
    return gzip.compress(b"".join(body), mtime=0)


def decode(data: bytes, key: str | None = None) -> tuple[dict, dict[str, np.ndarray]] | None:
    """Header and decimetres by layer; none if mark, version, key or length are wrong."""
    try:
        raw = gzip.decompress(data)
        if raw[:4] != MAGIC:
            return None
        start = 8 + struct.unpack("<I", raw[4:8])[0]
        header = json.loads(raw[8:start])
        sizes = [header[layer]["cols"] * header[layer]["rows"] for layer in LAYERS]
    except (OSError, EOFError, ValueError, KeyError, TypeError, struct.error):
        return None
    if header.get("v") != VERSION or (key is not None and header.get("key") != key) or len(raw) != start + 2 * sum(sizes):
        return None
    values = np.frombuffer(raw, "<u2", offset=start)
    return header, {"ndsm": values[: sizes[0]], "terrain": values[sizes[0] :]}


def _header(path: str) -> dict | None:
    """The header alone: a tile's first kilobytes tell where it lies."""
    try:
        with gzip.open(path, "rb") as file:
            if file.read(4) != MAGIC:
                return None
            header = json.loads(file.read(struct.unpack("<I", file.read(4))[0]))
        return header if header.get("v") == VERSION and all({"x0", "y0", "cellM", "cols", "rows"} <= header[layer].keys() for layer in LAYERS) else None
    except (OSError, EOFError, ValueError, KeyError, AttributeError, struct.error):
        return None


@dataclass
class Window(InputPartition):
    """Columns and rows of one layer of a file."""

    path: str
    tile: str
    layer: str
    cols: tuple[int, int]
    rows: tuple[int, int]

    def __post_init__(self):
        super().__init__(self.path)


class HeightReader(DataSourceReader):
    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder, most
        self.bounds = {"x": [-math.inf, math.inf], "y": [-math.inf, math.inf]}
        self.equal: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of x and y and values of tile and layer choose partitions; Spark still tests the bounds row by row."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            if name in self.bounds and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.bounds[name][0] = max(self.bounds[name][0], f.value)
            if name in self.bounds and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.bounds[name][1] = min(self.bounds[name][1], f.value)
            if name in ("tile", "layer") and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.equal[name] = self.equal.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[Window]:
        found = []
        for name in sorted(os.listdir(self.folder)) if os.path.isdir(self.folder) else []:
            match = _NAME.match(name)
            if not match or match[1] not in self.equal.get("tile", {match[1]}):
                continue
            path = os.path.join(self.folder, name)
            header = _header(path)
            for layer in LAYERS if header and header.get("key") == match[1] else ():
                grid = header[layer]
                if layer not in self.equal.get("layer", {layer}):
                    continue
                cell = grid["cellM"]
                spans = {axis: self._within(axis, grid[f"{axis}0"], cell, windows(0, grid[n], max(1, int(self.most / cell)))) for axis, n in (("x", "cols"), ("y", "rows"))}
                found += [Window(path, match[1], layer, cols, rows) for rows in spans["y"] for cols in spans["x"]]
        return found

    def _within(self, axis: str, origin: float, cell: float, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        low, high = self.bounds[axis]
        return [(a, b) for a, b in spans if origin + (b - 0.5) * cell >= low and origin + (a + 0.5) * cell <= high]

    def read(self, window: Window | None) -> Iterator[pa.RecordBatch]:
        if window is None:  # nothing is left to read
            return
        with open(window.path, "rb") as file:
            found = decode(file.read(), window.tile)
        if found is None:
            return
        header, layers = found
        grid = header[window.layer]
        values = layers[window.layer].reshape(grid["rows"], grid["cols"])
        middles = grid["x0"] + (np.arange(*window.cols) + 0.5) * grid["cellM"]
        for row in range(*window.rows):
            own = values[row, slice(*window.cols)]
            n = len(own)
            y = grid["y0"] + (row + 0.5) * grid["cellM"]
            columns = [pa.array([window.tile] * n), pa.array([window.layer] * n), pa.array(middles), pa.array(np.full(n, y)), pa.array(own / 10.0, mask=own == VOID)]
            yield pa.RecordBatch.from_arrays(columns, names=["tile", "layer", "x", "y", "metres"])


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class HeightWriter(DataSourceArrowWriter):
    """Each task writes the tiles of its rows under names of its own; they get their places only when all tasks have succeeded."""

    def __init__(self, folder: str, cell: dict[str, float]):
        self.folder, self.cell = folder, cell

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        batches, names = list(iterator), []
        table = pa.Table.from_batches(batches) if batches else None
        os.makedirs(self.folder, exist_ok=True)
        for tile in table.column("tile").unique().to_pylist() if table else []:
            rows = table.filter(pc.equal(table.column("tile"), tile))
            grids, cells = {}, {}
            for layer in LAYERS:
                own = rows.filter(pc.equal(rows.column("layer"), layer))
                x, y, metres = (own.column(c).to_numpy() for c in ("x", "y", "metres"))
                cell = self.cell[layer]
                x0, y0 = (float(v.min() - cell / 2) if len(v) else 0.0 for v in (x, y))
                col, row = (np.floor((v - o) / cell).astype(int) for v, o in ((x, x0), (y, y0)))
                grids[layer] = {"x0": x0, "y0": y0, "cellM": cell, "cols": int(col.max(initial=-1)) + 1, "rows": int(row.max(initial=-1)) + 1}
                grid = np.full((grids[layer]["rows"], grids[layer]["cols"]), np.nan)
                grid[row, col] = metres
                cells[layer] = grid
            temporary, final = f".{uuid.uuid4().hex}", f"{tile}.v{VERSION}.bin.gz"
            with open(os.path.join(self.folder, temporary), "wb") as file:
                file.write(encode(tile, grids, cells))
            names.append((temporary, final))
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        for temporary, final in (n for m in messages if m for n in m.names):
            os.replace(os.path.join(self.folder, temporary), os.path.join(self.folder, final))

    def abort(self, messages: list[Written | None]) -> None:
        for temporary, _ in (n for m in messages if m for n in m.names):
            os.unlink(os.path.join(self.folder, temporary))


class HeightTiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "height_tiles"

    def schema(self) -> str:
        return SCHEMA

    def _folder(self) -> str:
        return re.sub(r"^file:/+", "/", self.options["path"])

    def reader(self, schema: StructType) -> HeightReader:
        return HeightReader(self._folder(), int(self.options.get("window", MOST_WINDOW_M)))

    def writer(self, schema: StructType, overwrite: bool) -> HeightWriter:
        return HeightWriter(self._folder(), {layer: float(self.options.get(f"{layer}_cell", 1)) for layer in LAYERS})


def read_heights(spark: SparkSession, folder: str, window: int = MOST_WINDOW_M) -> DataFrame:
    """tile, layer, x, y, metres of the tile files in ``folder``, x and y of cells' middles; null where there is no data.

    A partition is a window of ``window`` metres at most of one layer of a file. Comparisons of x and y with numbers and of tile and layer with values
    leave out windows and files before they are read. Files that are not tiles, of another version, or named after another key give no rows.
    """
    spark.dataSource.register(HeightTiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("height_tiles").option("window", str(window)).load(folder)


def write_heights(cells: DataFrame, folder: str, cell_m: dict[str, float]) -> None:
    """Write tile, layer, x, y, metres as tile files, one for each tile; a tile's rows go to one task, so tiles must fit one.

    Files are replaced whole and only after all tasks have written; what lies in the folder under other names stays.
    """
    spark = cells.sparkSession
    spark.dataSource.register(HeightTiles)
    writer = cells.select("tile", "layer", "x", "y", "metres").repartition("tile").write.format("height_tiles").mode("append")
    for layer, size in cell_m.items():
        writer = writer.option(f"{layer}_cell", str(size))
    writer.save(folder)
