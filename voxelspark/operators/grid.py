"""Grid arithmetic: indices, cells, affine maps, resampling, set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

AXES = ("x", "y", "z")
Num = int | float | str


def _col(v: Num | Column) -> Column:
    if isinstance(v, Column):
        return v
    return F.col(v) if isinstance(v, str) else F.lit(v)


@dataclass(frozen=True)
class Grid:
    """Grid size and voxel size in mm; each entry is a number or the name of a column."""

    nx: Num
    ny: Num
    nz: Num
    vx: Num = 1.0
    vy: Num = 1.0
    vz: Num = 1.0

    @property
    def dims(self) -> list[Column]:
        return [_col(v) for v in (self.nx, self.ny, self.nz)]

    @property
    def spacing(self) -> list[Column]:
        return [_col(v) for v in (self.vx, self.vy, self.vz)]

    def flat_index(self, x: Num = "x", y: Num = "y", z: Num = "z") -> Column:
        _, ny, nz = self.dims
        return (_col(x) * (ny * nz) + _col(y) * nz + _col(z)).cast("long")

    def coords(self, idx: Num = "flat_idx") -> list[Column]:
        """C-order x, y, z of a flat index."""
        _, ny, nz = self.dims
        i = _col(idx)
        return [
            F.floor(i / (ny * nz)).cast("int").alias("x"),
            F.floor((i % (ny * nz)) / nz).cast("int").alias("y"),
            (i % nz).cast("int").alias("z"),
        ]

    def inside(self, x: Num = "x", y: Num = "y", z: Num = "z") -> Column:
        ok = F.lit(True)
        for c, n in zip((x, y, z), self.dims):
            ok = ok & (_col(c) >= 0) & (_col(c) < n)
        return ok

    def voxel_volume(self) -> Column:
        vx, vy, vz = self.spacing
        return vx * vy * vz


def mm_to_iterations(mm: Num | Column, spacing: Sequence[Num | Column]) -> Column:
    """Dilation steps for a length: half-even rounding over the mean voxel size, at least 1."""
    vx, vy, vz = (_col(v) for v in spacing)
    return F.greatest(F.lit(1), F.bround(_col(mm) / ((vx + vy + vz) / 3)).cast("int"))


def mm_to_steps(block_mm: Num | Column, buffer_mm: Num | Column, spacing: Sequence[Num | Column]) -> list[Column]:
    """Cell size and clamped buffer in voxels per axis: sx, sy, sz, bx, by, bz."""
    steps, buffers = [], []
    for ax, v in zip(AXES, spacing):
        s = F.greatest(F.lit(1), F.bround(_col(block_mm) / _col(v)).cast("int"))
        b = F.greatest(F.lit(0), F.bround(_col(buffer_mm) / _col(v)).cast("int"))
        room = F.greatest(F.lit(0), (F.floor(s / 2) - 1).cast("int"))
        steps.append(s.alias(f"s{ax}"))
        buffers.append(F.least(b, room).alias(f"b{ax}"))
    return steps + buffers


def cube_half_width(cube_cm: Num | Column, spacing: Sequence[Num | Column]) -> Column:
    """Half width in voxels of a cube given in centimetres."""
    vx, vy, vz = (_col(v) for v in spacing)
    width = F.greatest(F.lit(1), F.bround(_col(cube_cm) * 10.0 / ((vx + vy + vz) / 3)).cast("int"))
    return F.greatest(F.lit(1), F.floor(width / 2).cast("int"))


def cell_key(steps: Sequence[Num | Column]) -> Column:
    """One number per grid cell."""
    cx, cy, cz = (F.floor(F.col(a) / _col(s)).cast("long") for a, s in zip(AXES, steps))
    return cx * 10**8 + cy * 10**4 + cz


def in_cell_core(steps: Sequence[Num | Column], buffers: Sequence[Num | Column]) -> Column:
    """Whether a voxel keeps the buffer distance from the faces of its cell."""
    ok = F.lit(True)
    for a, s, b in zip(AXES, steps, buffers):
        r = F.col(a) % _col(s)
        ok = ok & (r >= _col(b)) & (r < _col(s) - _col(b))
    return ok


def scaled_coordinates(grid: Grid, weight: float = 0.2) -> list[Column]:
    return [(F.col(a) / n * weight).alias(f"{a}_norm") for a, n in zip(AXES, grid.dims)]


def voxel_size(affine: Sequence[Num | Column]) -> list[Column]:
    """Column norms of a row-major 4x4 affine (12 leading entries are enough)."""
    a = [_col(v) for v in affine]
    return [
        F.sqrt(a[i] * a[i] + a[4 + i] * a[4 + i] + a[8 + i] * a[8 + i]).alias(f"v{ax}") for i, ax in enumerate(AXES)
    ]


def offsets(kind: int) -> list[tuple[int, int, int]]:
    """Neighbour offsets of the 6-, 18- or 26-neighbourhood."""
    reach = {6: 1, 18: 2, 26: 3}[kind]
    span = (-1, 0, 1)
    return [(i, j, k) for i in span for j in span for k in span if 0 < abs(i) + abs(j) + abs(k) <= reach]


def shifted(df: DataFrame, steps: Sequence[tuple[int, int, int]], extra: str | None = None) -> DataFrame:
    """One row per voxel and offset, at the shifted position (fixed fan-out of ``len(steps)``)."""
    items = F.array(*[F.struct(*[F.lit(v).alias(f"d{a}") for a, v in zip(AXES, s)]) for s in steps])
    out = df.withColumn("_o", F.explode(items))
    if extra:
        out = out.withColumn(extra, F.col("_o"))
    return out.withColumns({a: F.col(a) + F.col(f"_o.d{a}") for a in AXES}).drop("_o")


def expand_cubes(centres: DataFrame, keys: Sequence[str], half_width: Num | Column, grid: Grid) -> DataFrame:
    """All voxels within a Chebyshev distance of a centre, clipped to the grid.

    Works axis by axis and keeps the distinct positions after each axis, so overlapping
    cubes are merged early.
    """
    state = centres.select(*keys, *AXES, _col(half_width).alias("_h"))
    for a, n in zip(AXES, grid.dims):
        lo = F.greatest(F.lit(0), F.col(a) - F.col("_h"))
        hi = F.least(n - 1, F.col(a) + F.col("_h"))
        state = state.withColumn(a, F.explode(F.sequence(lo.cast("int"), hi.cast("int")))).distinct()
    return state.drop("_h")


def affine_apply(affine: Sequence[Num | Column], at: Sequence[Num | Column]) -> list[Column]:
    a, p = [_col(v) for v in affine], [_col(v) for v in at]
    return [a[4 * r] * p[0] + a[4 * r + 1] * p[1] + a[4 * r + 2] * p[2] + a[4 * r + 3] for r in range(3)]


def resample_nearest(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    to_source: Sequence[Num | Column],
    value: str,
    out: str,
) -> DataFrame:
    """Value of the nearest source voxel; 0 outside the source.

    ``to_source`` maps target indices to source indices (row-major 3x4 affine).
    """
    at = affine_apply(to_source, AXES)
    pos = target.withColumns({f"_s{a}": F.floor(c + 0.5).cast("int") for a, c in zip(AXES, at)})
    src = source.select(*keys, *[F.col(a).alias(f"_s{a}") for a in AXES], F.col(value).alias("_value"))
    joined = pos.join(src, [*keys, "_sx", "_sy", "_sz"], "left")
    return joined.withColumn(out, F.coalesce("_value", F.lit(0))).drop("_sx", "_sy", "_sz", "_value")


def resample_linear(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    to_source: Sequence[Num | Column],
    value: str,
    out: str,
) -> DataFrame:
    """Trilinear interpolation: eight weighted corners, one equi-join, one sum."""
    at = affine_apply(to_source, AXES)
    pos = target.select(*keys, *AXES, *[c.alias(f"_p{a}") for a, c in zip(AXES, at)])
    corners = F.array(
        *[
            F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"), F.lit(k).alias("dz"))
            for i in (0, 1)
            for j in (0, 1)
            for k in (0, 1)
        ]
    )
    pos = pos.withColumn("_c", F.explode(corners))
    weight = F.lit(1.0)
    for a in AXES:
        frac = F.col(f"_p{a}") - F.floor(f"_p{a}")
        weight = weight * F.when(F.col(f"_c.d{a}") == 1, frac).otherwise(1 - frac)
    pos = pos.withColumns({f"_s{a}": (F.floor(f"_p{a}") + F.col(f"_c.d{a}")).cast("int") for a in AXES})
    pos = pos.withColumn("_w", weight).where("_w > 0")
    src = source.select(*keys, *[F.col(a).alias(f"_s{a}") for a in AXES], F.col(value).alias("_value"))
    joined = pos.join(src, [*keys, "_sx", "_sy", "_sz"], "left")
    return joined.groupBy(*keys, *AXES).agg(F.sum(F.col("_w") * F.coalesce("_value", F.lit(0.0))).alias(out))


def union_masks(parts: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """One boolean column per named voxel set plus ``any``; absent rows count as false."""
    tagged = None
    for name, df in parts.items():
        part = df.select(*keys, *AXES, F.lit(name).alias("_part"))
        tagged = part if tagged is None else tagged.unionByName(part)
    flags = [F.bool_or(F.col("_part") == n).alias(n) for n in parts]
    return tagged.groupBy(*keys, *AXES).agg(*flags).withColumn("any", F.lit(True))


def common_cells(cells: DataFrame, keys: Sequence[str], cell: str = "cell", klass: str = "target") -> DataFrame:
    """Cells holding voxels of both classes, with the class counts."""
    counts = cells.groupBy(*keys, cell).agg(
        F.count_if(F.col(klass) == 1).alias("n_pos"), F.count_if(F.col(klass) == 0).alias("n_neg")
    )
    return counts.where("n_pos > 0 AND n_neg > 0")


def gather(features: DataFrame, index: DataFrame, keys: Sequence[str], idx: str = "flat_idx") -> DataFrame:
    """Rows of ``features`` for every requested index; misses drop out."""
    return index.join(features, [*keys, idx])


def restrict(df: DataFrame, mask: DataFrame, keys: Sequence[str], idx: str = "flat_idx") -> DataFrame:
    """Rows whose voxel is in ``mask``."""
    return df.join(mask.select(*keys, idx), [*keys, idx], "left_semi")


def parse_sampling(text: str | Column) -> list[Column]:
    """``mode:key=value:...`` as a lower-case mode and a map of doubles."""
    c = F.lower(F.trim(_col(text)))
    pieces = F.filter(F.split(c, ":"), lambda p, i: (i > 0) & p.contains("="))
    entries = F.transform(
        pieces,
        lambda p: F.struct(
            F.trim(F.substring_index(p, "=", 1)).alias("key"),
            F.trim(F.regexp_replace(p, "^[^=]*=", "")).cast("double").alias("value"),
        ),
    )
    first = F.aggregate(
        entries,
        F.create_map().cast("map<string,double>"),
        lambda m, e: F.when(F.map_contains_key(m, e["key"]), m).otherwise(
            F.map_concat(m, F.map_from_arrays(F.array(e["key"]), F.array(e["value"])))
        ),
    )
    return [F.trim(F.split(c, ":")[0]).alias("mode"), first.alias("options")]


def expand_lists(specs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Every combination of the list-valued ``fields`` of each row."""
    for f in fields:
        specs = specs.withColumn(f, F.explode(f))
    return specs


def members(df: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Rows whose ``label`` is in the column of that name of ``labels``."""
    return df.join(labels.select(label).distinct(), label, "left_semi")


def shared_cells(a: DataFrame, b: DataFrame, keys: Sequence[str], cell: str = "cell") -> DataFrame:
    """Cells that both tables hold, once each."""
    return a.select(*keys, cell).intersect(b.select(*keys, cell))
