"""Morphology, distances, components and smoothing on sparse voxel tables.

A voxel set is a DataFrame with ``keys`` and x, y, z; a missing row is background.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import cut_lineage
from .columns import spread
from .grid import AXES, Grid, offsets, shifted


# ---- lines of bits -------------------------------------------------------------------------

LINE = 32  # positions along x in one word, at bits 1 to LINE; bits 0 and LINE + 1 repeat the next positions of the adjacent words
_OWN = ((1 << LINE) - 1) << 1


def _any(names: Sequence[str], mask: int = -1) -> Column:
    return reduce(lambda a, b: a | b, [F.col(n).bitwiseAND(F.lit(mask)) != 0 for n in names])


def line_words(voxels: DataFrame, keys: Sequence[str], flags: Mapping[str, Column]) -> DataFrame:
    """keys, _c, y, z and one word per flag for every stretch of ``LINE`` positions along x that holds a flagged voxel."""
    c, r = F.floor(F.col("x") / LINE), F.pmod(F.col("x"), F.lit(LINE)).cast("int")
    own = F.struct(c.alias("c"), (r + 1).alias("bit"))
    after, before = F.struct((c + 1).alias("c"), F.lit(0).alias("bit")), F.struct((c - 1).alias("c"), F.lit(LINE + 1).alias("bit"))
    places = F.when(r == 0, F.array(own, before)).when(r == LINE - 1, F.array(own, after)).otherwise(F.array(own))
    rows = voxels.select(*keys, "y", "z", places.alias("_p"), *[F.coalesce(f, F.lit(False)).alias(n) for n, f in flags.items()])
    rows = rows.where(reduce(lambda a, b: a | b, [F.col(n) for n in flags])).withColumn("_p", F.explode("_p"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_p.bit"))
    words = [F.bit_or(F.when(F.col(n), bit).otherwise(F.lit(0).cast("long"))).alias(n) for n in flags]
    return rows.groupBy(*keys, F.col("_p.c").alias("_c"), "y", "z").agg(*words).where(_any(list(flags), _OWN))


def eroded_words(words: DataFrame, keys: Sequence[str], names: Sequence[str], kind: int) -> DataFrame:
    """Words of the voxels whose 6 or 26 neighbours are all set: a line is compared with its 4 or 8 neighbour lines."""
    near = sorted({(j, k) for _, j, k in offsets(kind)} | {(0, 0)})
    steps = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(k).alias("k")) for j, k in near])).alias("_o")
    middle = (F.col("_o.j") == 0) & (F.col("_o.k") == 0) if kind == 6 else F.lit(True)

    def part(n: str) -> Column:
        w = F.col(n)
        inner = w.bitwiseAND(F.shiftleft(w, 1)).bitwiseAND(F.shiftright(w, 1))
        return F.bit_and(F.when(middle, inner).otherwise(w).bitwiseAND(F.lit(_OWN))).alias(n)

    rows = words.select(*keys, "_c", "y", "z", *names, steps).withColumns({"y": F.col("y") + F.col("_o.j"), "z": F.col("z") + F.col("_o.k")})
    seen = rows.groupBy(*keys, "_c", "y", "z").agg(F.count(F.lit(1)).alias("_n"), *[part(n) for n in names])
    return seen.where((F.col("_n") == len(near)) & _any(names)).drop("_n")


def box_dilated_words(words: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Words of all positions within a 3x3x3 cube around a set voxel."""

    def wide(n: str) -> Column:
        w = F.col(n).bitwiseAND(F.lit(_OWN))
        return w.bitwiseOR(F.shiftleft(w, 1)).bitwiseOR(F.shiftright(w, 1))

    spread = words.select(*keys, "_c", "y", "z", *[wide(n).alias(n) for n in names])
    bits = {0: lambda w: w.bitwiseAND(F.lit(_OWN)), -1: lambda w: F.shiftleft(w.bitwiseAND(F.lit(1)), LINE), 1: lambda w: F.shiftright(w.bitwiseAND(F.lit(2 << LINE)), LINE)}
    parts = F.array(*[F.struct((F.col("_c") + d).alias("c"), *[take(F.col(n)).cast("long").alias(n) for n in names]) for d, take in bits.items()])
    lines = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(k).alias("k")) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    rows = spread.select(*keys, "y", "z", F.explode(parts).alias("_p")).select(*keys, "y", "z", F.col("_p.c").alias("_c"), *[F.col(f"_p.{n}").alias(n) for n in names])
    rows = rows.where(_any(names)).withColumn("_o", F.explode(lines)).withColumns({"y": F.col("y") + F.col("_o.j"), "z": F.col("z") + F.col("_o.k")})
    return rows.groupBy(*keys, "_c", "y", "z").agg(*[F.bit_or(n).alias(n) for n in names])


def with_words(df: DataFrame, words: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Boolean columns ``names``: whether the bit of each voxel is set; the join is by line, not by voxel."""
    bit = F.pmod(F.col("x"), F.lit(LINE)).cast("int") + 1
    rows = df.withColumn("_c", F.floor(F.col("x") / LINE)).join(words, [*keys, "_c", "y", "z"], "left")
    return rows.select(*df.columns, *[F.coalesce(F.bit_get(F.col(n), bit) == 1, F.lit(False)).alias(n) for n in names])


def word_voxels(words: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """keys, x, y, z of every set bit."""
    held = F.filter(F.sequence(F.lit(0), F.lit(LINE - 1)), lambda i: F.bit_get(F.col(name), i + 1) == 1)
    rows = words.select(*keys, "_c", F.explode(held).alias("_x"), "y", "z")
    return rows.select(*keys, (F.col("_c") * LINE + F.col("_x")).cast(words.schema["y"].dataType).alias("x"), "y", "z")


# ---- city-block distance: dilation and erosion ---------------------------------------------


def l1_within(seeds: DataFrame, keys: Sequence[str], n: int | str) -> DataFrame:
    """Every position within city-block distance ``n`` of a seed, with its distance ``l1``.

    One axis at a time, each seed of the surface spends part of its remaining budget; the best budget per
    position survives a partial aggregate.  Only reached positions exist, so no dense box is
    built.  ``n`` is a number or an integer column that is constant within a key.
    """
    keys = list(keys)
    budget = (F.col(n) if isinstance(n, str) else F.lit(int(n))).cast("int")
    seeds = seeds.select(*keys, *AXES, budget.alias("_n"))
    # A path from a seed to a position outside the set leaves through the surface, so seeds with six set neighbours
    # keep their own distance of zero and spend nothing.
    marked = _split_surface(seeds, keys).withColumn("_left", F.col("_n"))
    state, core = marked.where("NOT _inner").drop("_inner"), marked.where("_inner").drop("_inner")
    for a in AXES:
        state = state.withColumn("_d", F.explode(F.sequence(-F.col("_left"), F.col("_left"))))
        state = state.select(
            *keys,
            *[(F.col(b) + F.col("_d")).alias(b) if b == a else F.col(b) for b in AXES],
            "_n",
            (F.col("_left") - F.abs("_d")).alias("_left"),
        )
        state = state.unionByName(core) if a == AXES[-1] else state
        state = state.groupBy(*keys, *AXES).agg(F.max("_n").alias("_n"), F.max("_left").alias("_left"))
    return state.select(*keys, *AXES, (F.col("_n") - F.col("_left")).cast("int").alias("l1"))


def dilate(mask: DataFrame, keys: Sequence[str], n: int | str) -> DataFrame:
    """``n`` steps of six-neighbour dilation (equal to a city-block ball)."""
    return l1_within(mask, keys, n).drop("l1")


def outer_border(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Positions outside the set that touch it across a face (may lie outside the volume)."""
    keys = list(keys)
    own = mask.select(*keys, *AXES, F.lit(True).alias("_in"))
    near = shifted(mask.select(*keys, *AXES), offsets(6)).withColumn("_in", F.lit(False))
    seen = own.unionByName(near).groupBy(*keys, *AXES).agg(F.bool_or("_in").alias("_in"))
    return seen.where(~F.col("_in")).drop("_in")


def erode(mask: DataFrame, keys: Sequence[str], n: int = 1) -> DataFrame:
    """``n`` steps of six-neighbour erosion; everything outside the volume is background.

    The nearest background voxel always touches the set, so its border is enough.
    """
    if n <= 0:
        return mask
    if n == 1:
        return word_voxels(eroded_words(line_words(mask, keys, {"_w": F.lit(True)}), keys, ["_w"], 6), keys, "_w")
    near = l1_within(outer_border(mask, keys), keys, n)
    return mask.select(*keys, *AXES).join(near.drop("l1"), [*keys, *AXES], "left_anti")


def _split_surface(seeds: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct positions of ``seeds`` with their largest ``_n`` and whether all six face neighbours are in the set."""
    off = F.col("_off")
    side = F.when(off["dx"] == 1, 1).when(off["dx"] == -1, 2).when(off["dy"] == 1, 4).when(off["dy"] == -1, 8).when(off["dz"] == 1, 16).otherwise(32)
    own = seeds.select(*keys, *AXES, "_n", F.lit(0).alias("_side"))
    near = shifted(seeds.select(*keys, *AXES), offsets(6), extra="_off").select(*keys, *AXES, F.lit(None).cast("int").alias("_n"), side.alias("_side"))
    seen = own.unionByName(near).groupBy(*keys, *AXES).agg(F.max("_n").alias("_n"), F.bit_or("_side").alias("_side"))
    return seen.where("_n IS NOT NULL").select(*keys, *AXES, "_n", (F.col("_side") == 63).alias("_inner"))


def neighbour_counts(mask: DataFrame, keys: Sequence[str], kind: int) -> DataFrame:
    """Number of set neighbours of each set voxel: one shuffle, no join."""
    keys = list(keys)
    own = mask.select(*keys, *AXES, F.lit(True).alias("_in"), F.lit(0).alias("_k"))
    near = shifted(mask.select(*keys, *AXES), offsets(kind)).withColumns({"_in": F.lit(False), "_k": F.lit(1)})
    seen = own.unionByName(near).groupBy(*keys, *AXES).agg(F.bool_or("_in").alias("_in"), F.sum("_k").alias("neighbours"))
    return seen.where("_in").drop("_in")


def inner_border(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Voxels removed by one erosion with a full 3x3x3 cube."""
    return neighbour_counts(mask, keys, 26).where("neighbours < 26").drop("neighbours")


def box_erode(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    return word_voxels(eroded_words(line_words(mask, keys, {"_w": F.lit(True)}), keys, ["_w"], 26), keys, "_w")


def box_dilate(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    return word_voxels(box_dilated_words(line_words(mask, keys, {"_w": F.lit(True)}), keys, ["_w"]), keys, "_w")


def surface_area(mask: DataFrame, keys: Sequence[str], grid: Grid) -> DataFrame:
    """Exposed face area in mm2 and voxel count per key, and the sphericity that follows."""
    keys = list(keys)
    own = mask.select(*keys, *AXES, F.lit(True).alias("_in"), F.lit("").alias("_ax"))
    faces = [(i, j, k) for i, j, k in offsets(6)]
    near = shifted(mask.select(*keys, *AXES), faces, extra="_off").select(
        *keys,
        *AXES,
        F.lit(False).alias("_in"),
        F.when(F.col("_off.dx") != 0, "x").when(F.col("_off.dy") != 0, "y").otherwise("z").alias("_ax"),
    )
    seen = own.unionByName(near).groupBy(*keys, *AXES).agg(
        F.bool_or("_in").alias("_in"), *[F.count_if(F.col("_ax") == a).alias(f"_f{a}") for a in AXES]
    )
    vx, vy, vz = grid.spacing
    size = {"x": vy * vz, "y": vx * vz, "z": vx * vy}
    area = sum(((F.lit(2) - F.col(f"_f{a}")) * size[a] for a in AXES), F.lit(0.0))
    out = seen.where("_in").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_voxels"), F.sum(area).alias("area_mm2"))
    volume = F.col("n_voxels") * grid.voxel_volume()
    return out.withColumns(
        {"volume_mm3": volume, "sphericity": sphericity(volume, F.col("area_mm2"))}
    )


def sphericity(volume: Column, area: Column) -> Column:
    return F.when((area > 0) & (volume > 0), F.lit(np.pi ** (1.0 / 3.0)) * F.pow(6.0 * volume, F.lit(2.0 / 3.0)) / area)


# ---- Euclidean distance --------------------------------------------------------------------

CHUNK = 32
NOWHERE = 1e30  # squared distance on a line without sources


def _key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(k, df.schema[k].dataType) for k in keys]


def lower_envelope(values: np.ndarray, at: np.ndarray, wanted: np.ndarray, scale: float) -> np.ndarray:
    """min over i of values[i] + (scale * (wanted - at[i]))**2 for every wanted row, for all columns side by side.

    Each column keeps the stack of parabolas that are lowest somewhere, and where each begins; a parabola enters and
    leaves the stack once, then one sweep reads it off. Work grows with sources plus wanted rows, not with their product.
    """
    order = np.argsort(at, kind="stable")
    x, f = at[order].astype(float) * scale, values[order].reshape(len(at), -1)
    keep = np.append(np.diff(x) > 0, True)  # of equal places only the lowest counts
    if not keep.all():
        group = np.concatenate(([0], np.cumsum(keep[:-1])))
        least = np.full((group[-1] + 1, f.shape[1]), np.inf)
        np.minimum.at(least, group, f)
        x, f = x[keep], least
    n, width = f.shape
    stack, start = np.zeros((n, width), np.int64), np.full((n + 1, width), np.inf)
    start[0], top, col = -np.inf, np.zeros(width, np.int64), np.arange(width)
    for q in range(1, n):
        todo = col
        while len(todo):
            v = stack[top[todo], todo]
            cross = ((f[q, todo] + x[q] ** 2) - (f[v, todo] + x[v] ** 2)) / (2 * (x[q] - x[v]))
            hidden = cross <= start[top[todo], todo]
            done = todo[~hidden]
            top[done] += 1
            stack[top[done], done], start[top[done], done] = q, cross[~hidden]
            todo = todo[hidden]
            top[todo] -= 1
    used = np.arange(n + 1)[:, None] <= top
    start[~used] = np.inf
    goal = np.argsort(wanted, kind="stable")
    out, now = np.empty((len(wanted), width)), np.zeros(width, np.int64)
    for i in goal:
        p = wanted[i] * scale
        while (step := (now < top) & (start[np.minimum(now + 1, n), col] <= p)).any():
            now += step
        v = stack[now, col]
        out[i] = f[v, col] + (p - x[v]) ** 2
    return out.reshape(len(wanted), *values.shape[1:])


def nearest_on_line(places: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Distance of each wanted place to the nearest of ``places``."""
    s = np.sort(places)
    i = np.searchsorted(s, wanted)
    return np.minimum(np.abs(wanted - s[np.maximum(i - 1, 0)]), np.abs(s[np.minimum(i, len(s) - 1)] - wanted))


def euclidean_distance(
    targets: DataFrame,
    sources: DataFrame,
    keys: Sequence[str],
    spacing: tuple[float, float, float],
    out: str = "dist",
) -> DataFrame:
    """Distance in mm from each target voxel to its nearest source voxel; NULL without sources.

    Exact and separable.  Lines along x are collected, then lines along y are combined for
    chunks of 32 by 32 x and z values side by side, then lines along z for chunks of 32 by 32 columns,
    so no task holds more than one chunk by one axis length, however large the volume is.
    """
    keys = list(keys)
    sx, sy, sz = spacing
    targets = targets.select(*keys, *AXES).distinct()
    box = targets.groupBy(*keys).agg(*[f(a).alias(f"_{n}{a}") for a in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))])
    lines = sources.groupBy(*keys, "y", "z").agg(F.collect_set("x").alias("xs")).join(box, keys)
    first, last = (F.floor(F.col(c) / CHUNK).cast("int") for c in ("_lox", "_hix"))
    lines = lines.withColumns({"_cx": F.explode(F.sequence(first, last)), "_cz": F.floor(F.col("z") / CHUNK).cast("int")})

    key_fields = _key_fields(targets, keys)
    plane = T.StructType(
        [
            *key_fields,
            T.StructField("_cx", T.IntegerType()),
            T.StructField("_cy", T.IntegerType()),
            *[T.StructField(c, T.IntegerType()) for c in ("z", "_x0", "_y0", "_nx")],
            T.StructField("g", T.ArrayType(T.DoubleType())),
        ]
    )

    def along_y(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        cx, lo, hi = int(first["_cx"]), int(first["_loy"]), int(first["_hiy"])
        xs = np.arange(max(cx * CHUNK, int(first["_lox"])), min((cx + 1) * CHUNK - 1, int(first["_hix"])) + 1)
        ys = np.arange(lo, hi + 1)
        levels, level = np.unique(pdf["z"], return_inverse=True)
        places, place = np.unique(pdf["y"], return_inverse=True)
        on_line = np.full((len(places), len(levels), len(xs)), NOWHERE)
        on_line[place, level] = np.stack([(sx * nearest_on_line(np.asarray(s), xs)) ** 2 for s in pdf["xs"]])
        g, rows = lower_envelope(on_line, places, ys, sy), []
        for c in range(lo // CHUNK, hi // CHUNK + 1):
            part = g[ys // CHUNK == c]
            rows += [[first[k] for k in keys] + [cx, c, int(z), int(xs[0]), max(c * CHUNK, lo), len(xs), part[:, i].ravel()] for i, z in enumerate(levels)]
        return pd.DataFrame(rows, columns=plane.fieldNames())

    planes = spread(lines, *keys, "_cx", "_cz").groupBy(*keys, "_cx", "_cz").applyInPandas(along_y, plane)
    tiles = targets.withColumns({f"_c{a}": F.floor(F.col(a) / CHUNK).cast("int") for a in ("x", "y")})
    result = T.StructType([*key_fields, *[T.StructField(a, T.IntegerType()) for a in AXES], T.StructField(out, T.DoubleType())])

    def along_z(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if right.empty:
            return pd.DataFrame(columns=result.fieldNames())
        res = right[[*keys, *AXES]].copy()
        if left.empty:
            res[out] = None
            return res
        g = np.stack(left["g"].to_numpy())
        z0 = left["z"].to_numpy()
        x0, y0, nx = (int(left[c].iloc[0]) for c in ("_x0", "_y0", "_nx"))
        cell = (right["y"].to_numpy() - y0) * nx + right["x"].to_numpy() - x0
        z = right["z"].to_numpy()
        used, column = np.unique(cell, return_inverse=True)
        levels, level = np.unique(z, return_inverse=True)
        res[out] = np.sqrt(lower_envelope(g[:, used], z0, levels, sz)[level, column])
        return res

    by = [*keys, "_cx", "_cy"]
    return spread(planes, *by).groupBy(*by).cogroup(spread(tiles, *by).groupBy(*by)).applyInPandas(along_z, result)


def signed_distance(
    targets: DataFrame, mask: DataFrame, keys: Sequence[str], grid: Grid, scale: float = 1.0, out: str = "signed_dist"
) -> DataFrame:
    """Unit-spacing distance to the set, positive outside and negative inside."""
    keys = list(keys)
    asked = targets.select(*keys, *AXES, F.lit(True).alias("_asked"), F.lit(False).alias("_set"))
    held = mask.select(*keys, *AXES, F.lit(False).alias("_asked"), F.lit(True).alias("_set"))
    both = cut_lineage(asked.unionByName(held).groupBy(*keys, *AXES).agg(F.bool_or("_asked").alias("_asked"), F.bool_or("_set").alias("_set")))
    own = both.where("_set").select(*keys, *AXES)
    outside, inside = both.where("_asked AND NOT _set"), both.where("_asked AND _set")
    border = outer_border(own, keys).where(grid.inside())
    far = euclidean_distance(outside, own, keys, (1.0, 1.0, 1.0), out)
    near = euclidean_distance(inside, border, keys, (1.0, 1.0, 1.0), out).withColumn(out, -F.col(out))
    return far.unionByName(near).withColumn(out, F.col(out) * scale)


# ---- connected components ------------------------------------------------------------------


def _merge_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest reachable index per node: hook the larger root on the smaller, then shortcut."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        open_ = a != b
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def connected_components(
    voxels: DataFrame, keys: Sequence[str], grid: Grid, connectivity: int = 18, block: int = 32, out: str = "cid"
) -> DataFrame:
    """Label each voxel with the smallest flat index of its component.

    Blocks of fixed size are labelled independently in one shuffle.  Only voxels on block
    faces are then compared across blocks, and the resulting small graph of block components
    is merged by minimum labels with pointer jumping, each round cut off by a checkpoint.
    """
    keys = list(keys)
    forward = [o for o in offsets(connectivity) if o > (0, 0, 0)]
    cells = voxels.select(*keys, *AXES, grid.flat_index().alias("flat_idx"))
    cells = cells.withColumns({f"_b{a}": F.floor(F.col(a) / block).cast("int") for a in AXES})
    schema = T.StructType(
        [
            *_key_fields(voxels, keys),
            *[T.StructField(a, T.IntegerType()) for a in AXES],
            T.StructField("flat_idx", T.LongType()),
            T.StructField(out, T.LongType()),
        ]
    )

    def label_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("flat_idx", ignore_index=True)
        pos = (pdf[list(AXES)].to_numpy() % block) + 1
        index = np.full((block + 2,) * 3, -1)
        index[tuple(pos.T)] = np.arange(len(pdf))
        us, vs = [], []
        for o in forward:
            other = index[tuple((pos + o).T)]
            hit = other >= 0
            us.append(np.flatnonzero(hit))
            vs.append(other[hit])
        root = _merge_labels(len(pdf), np.concatenate(us), np.concatenate(vs))
        pdf[out] = pdf["flat_idx"].to_numpy()[root]
        return pdf[schema.fieldNames()]

    by = [*keys, "_bx", "_by", "_bz"]
    local = spread(cells, *by).groupBy(*by).applyInPandas(label_block, schema)
    local = cut_lineage(local)

    on_face = F.lit(False)
    for a in AXES:
        r = F.col(a) % block
        on_face = on_face | (r == 0) | (r == block - 1)
    face = local.where(on_face).select(*keys, *AXES, F.col(out).alias("u"))
    moved = face.withColumns({f"_b{a}": F.floor(F.col(a) / block) for a in AXES})
    moved = shifted(moved, forward)
    crosses = F.lit(False)
    for a in AXES:
        crosses = crosses | (F.floor(F.col(a) / block) != F.col(f"_b{a}"))
    moved = moved.where(crosses).drop("_bx", "_by", "_bz")
    links = moved.join(face.withColumnRenamed("u", "v"), [*keys, *AXES]).select(*keys, "u", "v").distinct()
    merged = merge_graph(links, keys, out)
    if merged is None:
        return local
    merged = merged.withColumnRenamed("node", out)
    return local.join(merged, [*keys, out], "left").withColumn(out, F.coalesce("label", out)).drop("label")


def merge_graph(links: DataFrame, keys: Sequence[str], out: str = "cid") -> DataFrame | None:
    """Smallest node of each connected part of an edge table (u, v): columns keys, node, label."""
    keys = list(keys)
    links = cut_lineage(links)
    if links.isEmpty():
        return None
    both = links.unionByName(links.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    labels = both.groupBy(*keys, F.col("u").alias("node")).agg(F.min("v").alias("label"))
    labels = cut_lineage(labels.withColumn("label", F.least("label", "node")))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "v"), [*keys, "v"]).groupBy(*keys, F.col("u").alias("node"))
        lower = seen.agg(F.min("label").alias("near"))
        step = labels.join(lower, [*keys, "node"]).withColumn("new", F.least("label", "near"))
        jump = labels.select(*keys, F.col("node").alias("new"), F.col("label").alias("up"))
        step = step.join(jump, [*keys, "new"], "left")
        step = step.select(*keys, "node", F.least("new", F.coalesce("up", "new")).alias("next"), "label")
        step = cut_lineage(step)
        changed = not step.where("next <> label").isEmpty()
        labels = step.select(*keys, "node", F.col("next").alias("label"))
        if not changed:
            return labels


# ---- smoothing -----------------------------------------------------------------------------


def gaussian_kernel(sigma: float, radius: int) -> np.ndarray:
    t = np.arange(-radius, radius + 1)
    k = np.exp(-0.5 * (t / sigma) ** 2)
    return k / k.sum()


def gaussian_smooth(
    voxels: DataFrame, keys: Sequence[str], spacing: tuple[float, float, float], value: str, fwhm_mm: float = 2.5, block: int = 16
) -> DataFrame:
    """Spatial Gaussian of a scalar or series column, weights renormalised over present voxels.

    Each block receives copies of the voxels within the kernel radius of its border, so the
    three axis passes need a single shuffle.
    """
    keys = list(keys)
    sigma = [fwhm_mm / 2.3548 / v for v in spacing]
    radius = [int(np.ceil(3 * s)) for s in sigma]
    kernels = [gaussian_kernel(s, r) for s, r in zip(sigma, radius)]
    is_series = isinstance(voxels.schema[value].dataType, T.ArrayType)
    copies = voxels.select(*keys, *AXES, value)
    for a, r in zip(AXES, radius):
        lo, hi = (F.floor((F.col(a) + d) / block).cast("int") for d in (-r, r))
        copies = copies.withColumn(f"_b{a}", F.explode(F.sequence(lo, hi)))
    schema = T.StructType([*_key_fields(voxels, keys), *[T.StructField(a, T.IntegerType()) for a in AXES], voxels.schema[value]])

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        base = np.array([int(pdf[f"_b{a}"].iloc[0]) * block for a in AXES])
        rel = pdf[list(AXES)].to_numpy() - base
        own = ((rel >= 0) & (rel < block)).all(axis=1)
        if not own.any():
            return pd.DataFrame(columns=schema.fieldNames())
        data = np.stack(pdf[value].to_numpy()) if is_series else pdf[value].to_numpy()[:, None]
        size = [block + 2 * r for r in radius]
        at = tuple((rel + radius).T)
        total, weight = np.zeros((*size, data.shape[1])), np.zeros((*size, 1))
        total[at], weight[at] = data, 1.0
        for axis, (k, r) in enumerate(zip(kernels, radius)):
            n = total.shape[axis] - 2 * r
            take = lambda a, i: a.take(range(i, i + n), axis=axis)
            total = sum(w * take(total, i) for i, w in enumerate(k))
            weight = sum(w * take(weight, i) for i, w in enumerate(k))
        here = tuple(rel[own].T)
        res = pdf.loc[own, [*keys, *AXES]].copy()
        smoothed = total[here] / weight[here]
        res[value] = list(smoothed) if is_series else smoothed[:, 0]
        return res

    return copies.groupBy(*keys, "_bx", "_by", "_bz").applyInPandas(smooth, schema)
