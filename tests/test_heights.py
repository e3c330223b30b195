"""Height tiles: round trip, windows that are left out, files that are not tiles."""

import gzip
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbra.sources import heights


def _cells(spark, n=20):
    rows = [(f"{t}_0", layer, t * n + c + 0.5, r + 0.5, None if (r * n + c) % 7 == 0 else (r * 31 + c * 17 + t) % 400 / 10) for t in range(3) for layer in heights.LAYERS for r in range(n) for c in range(n)]
    return spark.createDataFrame(rows, "tile string, layer string, x double, y double, metres double"), rows


def test_round_trip(spark, tmp_path):
    frame, rows = _cells(spark)
    heights.write_heights(frame, str(tmp_path), {"ndsm": 1, "terrain": 1})
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"{t}_0.v1.bin.gz" for t in range(3)]
    got = heights.read_heights(spark, str(tmp_path)).collect()
    key = lambda r: tuple(r)[:4]
    assert sorted(map(tuple, got), key=key) == sorted(rows, key=key)


def test_windows_are_left_out(spark, tmp_path):
    frame, rows = _cells(spark)
    heights.write_heights(frame, f"file://{tmp_path}", {"ndsm": 1, "terrain": 1})
    whole = heights.read_heights(spark, f"file://{tmp_path}", 5)
    assert whole.rdd.getNumPartitions() == 3 * 2 * 16
    some = whole.where("layer = 'ndsm' AND x >= 22 AND x < 34 AND y > 9.5")
    # One tile of three, one layer of two, columns from 20 on in three windows of five, rows from 5 on in three.
    assert some.rdd.getNumPartitions() == 3 * 3
    assert some.count() == sum(r[1] == "ndsm" and 22 <= r[2] < 34 and r[3] > 9.5 for r in rows)
    assert whole.where(F.col("tile").isin("0_0", "9_9")).rdd.getNumPartitions() == 32
    assert heights.read_heights(spark, str(tmp_path / "nothing")).count() == 0


def test_what_is_not_a_tile_gives_no_rows(spark, tmp_path):
    grid = {"x0": 0.0, "y0": 0.0, "cellM": 1, "cols": 2, "rows": 1}
    data = heights.encode("1_1", {"ndsm": grid, "terrain": grid}, {"ndsm": np.array([1.04, math.nan]), "terrain": np.array([-3.0, 99999.0])})
    header, layers = heights.decode(data, "1_1")
    assert layers["ndsm"].tolist() == [10, 0xFFFF] and layers["terrain"].tolist() == [0, 0xFFFE] and header["key"] == "1_1"
    assert heights.decode(data, "1_2") is None and heights.decode(gzip.compress(gzip.decompress(data)[:-2])) is None and heights.decode(b"no") is None
    (tmp_path / "1_1.v1.bin.gz").write_bytes(data)
    (tmp_path / "5_5.v1.bin.gz").write_bytes(data)
    (tmp_path / "2_2.v1.bin.gz").write_bytes(gzip.compress(b"CLIDxxxx"))
    (tmp_path / "3_3.v1.bin.gz").write_bytes(b"text")
    (tmp_path / "readme.txt").write_bytes(b"text")
    assert {r.tile for r in heights.read_heights(spark, str(tmp_path)).collect()} == {"1_1"}


@pytest.mark.parametrize(("low", "high", "most"), [(0, 2400, 2400), (0, 2401, 2400), (-7, 10_000, 2400), (5, 5, 10), (0, 7, 2)])
def test_windows_meet(low, high, most):
    found = heights.windows(low, high, most)
    assert found[0][0] == low and found[-1][1] == high and all(a[1] == b[0] for a, b in zip(found, found[1:]))
    assert max(b - a for a, b in found) <= most + 0.5 and len({b - a for a, b in found}) <= 2
