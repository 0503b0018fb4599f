"""Balanced, stratified and spatially blocked samples with seeded hashes.

A pool table has ``keys``, ``flat_idx``, x, y, z and the class ``target`` (1 or 0).  Keys whose
pools are too small give no rows.  Results depend only on the seed and the indices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .columns import attach, with_stats
from .grid import AXES, Grid, cell_key, common_cells, expand_cubes, in_cell_core, mm_to_steps
from .ranking import choose, seeded_key

IDX = "flat_idx"

# Fallback candidates of the adaptive split, tried in this order after the requested ones.
BLOCK_MM = [18.0, 15.0, 12.0, 10.0, 8.0]
BUFFER_MM = [4.0, 3.0, 2.0, 1.0, 0.0]
HOLDOUT_FRACTIONS = [0.02, 0.05, 0.08, 0.10]
HALF_WIDTHS = [1, 0]


def _seed_text(seed: int | Column) -> Column:
    return seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))


def thin(pools: DataFrame, keys: Sequence[str], step: int, seed: int | Column, max_keep: int | None = None) -> DataFrame:
    """One seeded voxel per class and cell of ``step`` voxels, of which ``max_keep`` per key and class stay."""
    rest = [c for c in pools.columns if c not in (*keys, "target")]
    pick = F.min(F.struct(seeded_key(seed, F.col(IDX)).alias("_h"), *rest))
    out = pools.withColumn("_cell", cell_key([step] * 3)).groupBy(*keys, "target", "_cell").agg(pick.alias("_p"))
    out = out.select(*keys, "target", *[F.col(f"_p.{c}").alias(c) for c in rest])
    return out if max_keep is None else choose(out, [*keys, "target"], IDX, max_keep, seed)


def _class_counts() -> list[Column]:
    return [F.count_if(F.col("target") == 1).alias("_n_pos"), F.count_if(F.col("target") == 0).alias("_n_neg")]


def _size(n_per_class: int | None) -> Column:
    smaller = F.least("_n_pos", "_n_neg")
    return smaller if n_per_class is None else F.least(smaller, F.lit(int(n_per_class)))


def stratified_negatives(
    negatives: DataFrame, keys: Sequence[str], n: str, seed: int | Column, gm: str = "gm", wm: str = "wm", gm_fraction: float = 1.0 / 3.0
) -> DataFrame:
    """``n`` negatives per key, a third from grey and the rest from white matter.

    A shortage is filled from white matter first, then grey; keys that still fall short drop out.
    """
    kind = F.when(F.col(gm) & ~F.col(wm), "gm").when(F.col(wm) & ~F.col(gm), "wm")
    df = negatives.withColumn("_kind", kind).where("_kind IS NOT NULL")
    df = with_stats(df, keys, [F.count_if(F.col("_kind") == k).alias(f"_n_{k}") for k in ("gm", "wm")])
    want = F.bround(F.col(n) * F.lit(gm_fraction)).cast("long")
    take_gm, take_wm = F.least(want, F.col("_n_gm")), F.least(F.col(n) - want, F.col("_n_wm"))
    missing = F.col(n) - take_gm - take_wm
    from_wm = F.col("_n_wm") - take_wm >= missing
    from_gm = F.col("_n_gm") - take_gm >= missing
    quota_wm = F.when(from_wm, take_wm + missing).when(from_gm, take_wm)
    quota_gm = F.when(from_wm, take_gm).when(from_gm, take_gm + missing)
    df = df.withColumn("_quota", F.when(F.col("_kind") == "gm", quota_gm).otherwise(quota_wm)).where("_quota IS NOT NULL")
    return choose(df, [*keys, "_kind"], IDX, F.col("_quota"), seed).drop("_kind", "_n_gm", "_n_wm", "_quota")


def balanced(
    pools: DataFrame, keys: Sequence[str], n_per_class: int | None, seed: int | Column, gm_fraction: float | None = None
) -> DataFrame:
    """Equally many positives and negatives per key; with ``gm_fraction`` negatives are stratified."""
    rows = with_stats(pools, keys, _class_counts()).withColumn("_n", _size(n_per_class)).where("_n > 0")
    if gm_fraction is None:
        picked = choose(rows, [*keys, "target"], IDX, F.col("_n"), seed)
    else:
        picked = choose(rows.where("target = 1"), keys, IDX, F.col("_n"), seed).unionByName(
            stratified_negatives(rows.where("target = 0"), keys, "_n", seed, gm_fraction=gm_fraction)
        )
    return picked.drop("_n_pos", "_n_neg", "_n")


def _finish(
    roles: DataFrame, keys: Sequence[str], n_per_class: int | None, seed: int | Column, gm_fraction: float | None
) -> DataFrame:
    """Balance the training and validation pools of the keys in which all four pools exist."""
    role, y = F.col("role"), F.col("target")
    counts = [F.count_if((role == r) & (y == c)).alias(f"_{r}{c}") for r in ("train", "val") for c in (1, 0)]
    feasible = cut_lineage(roles.groupBy(*keys).agg(*counts).where("_train1 > 0 AND _train0 > 0 AND _val1 > 0 AND _val0 > 0"))
    rows = roles.join(feasible, list(keys)).where("role IS NOT NULL")
    names = [c.strip("`") for c in roles.columns]
    if gm_fraction is None:
        n_train = F.least("_train1", "_train0")
        n_train = n_train if n_per_class is None else F.least(n_train, F.lit(int(n_per_class)))
        quota = F.when(role == "train", n_train).otherwise(F.least("_val1", "_val0"))
        largest = feasible.agg(F.max(F.greatest("_train1", "_train0", "_val1", "_val0"))).first()[0] or 0
        return choose(rows.withColumn("_q", quota), [*keys, "role", "target"], IDX, F.col("_q"), seed, largest).select(*names)
    train = balanced(rows.where(role == "train").select(*names), keys, n_per_class, seed, gm_fraction)
    val = balanced(rows.where(role == "val").select(*names), keys, None, seed)
    return train.select(*names).unionByName(val.select(*names))


def voxel_random(pools: DataFrame, keys: Sequence[str], n_per_class: int | None, seed: int | Column, gm_fraction: float | None = None) -> DataFrame:
    """Training sample only."""
    return balanced(pools, keys, n_per_class, seed, gm_fraction).withColumn("role", F.lit("train"))


def validation_cells(cells: DataFrame, keys: Sequence[str], seed: int | Column, fraction: float) -> DataFrame:
    """Seeded validation cells among the cells shared by both classes (at least two needed)."""
    n = F.least(F.greatest(F.lit(1), F.bround(F.col("_c") * F.lit(fraction)).cast("long")), F.col("_c") - 1)
    cells = cut_lineage(with_stats(cells, keys, [F.count(F.lit(1)).alias("_c")]).where("_c >= 2").withColumn("_k", n))
    largest = cells.agg(F.max("_c")).first()[0] or 0
    return choose(cells, keys, "cell", F.col("_k"), seed, largest).select(*keys, "cell", F.lit(True).alias("is_val"))


def grid_block(
    pools: DataFrame,
    keys: Sequence[str],
    spacing: Sequence[float | str],
    block_mm: float | str,
    buffer_mm: float | str | None = None,
    seed: int | Column = 42,
    fraction: float = 0.10,
    n_per_class: int | None = 20000,
    gm_fraction: float | None = None,
) -> DataFrame:
    """Whole cells go to validation, without the buffer at their faces; sizes may be per-key columns."""
    keys = list(keys)
    block = F.col(block_mm) if isinstance(block_mm, str) else F.lit(float(block_mm))
    buffer = block * 0.25 if buffer_mm is None else (F.col(buffer_mm) if isinstance(buffer_mm, str) else F.lit(float(buffer_mm)))
    sizes = mm_to_steps(block, buffer, spacing)
    rows = pools.withColumn("cell", cell_key(sizes[:3])).withColumn("_core", in_cell_core(sizes[:3], sizes[3:]))
    rows = cut_lineage(rows.withColumn("_seed", _seed_text(seed)))
    seeded = [*keys, "_seed"]
    chosen = validation_cells(common_cells(rows, seeded, klass="target"), seeded, F.col("_seed"), fraction).drop("_seed")
    rows = rows.join(chosen, [*keys, "cell"], "left")
    role = F.when(F.col("is_val").isNull(), "train").when(F.col("_core"), "val")
    roles = cut_lineage(rows.withColumn("role", role).drop("is_val", "_core", "cell", "_seed"))
    return _finish(roles, keys, n_per_class, seed, gm_fraction)


def patch_roles(
    pools: DataFrame, keys: Sequence[str], grid: Grid, fraction: float, half_width: int, seed: int | Column
) -> DataFrame:
    """Voxels inside seeded cubes are held out."""
    rows = with_stats(pools, keys, _class_counts())
    n_pos = F.least(F.greatest(F.lit(1), F.bround(F.col("_n_pos") * F.lit(fraction)).cast("long")), F.col("_n_pos"))
    quota = F.when(F.col("target") == 1, n_pos).otherwise(F.least(n_pos, F.col("_n_neg")))
    centres = choose(rows.withColumn("_q", quota), [*keys, "target"], IDX, F.col("_q"), seed)
    held = expand_cubes(centres, keys, half_width, grid).withColumn("_held", F.lit(True))
    rows = pools.join(held, [*keys, *AXES], "left")
    return rows.withColumn("role", F.when(F.col("_held"), "val").otherwise("train")).drop("_held")


def patch_holdout(
    pools: DataFrame,
    keys: Sequence[str],
    grid: Grid,
    fraction: float = 0.10,
    half_width: int = 2,
    seed: int | Column = 42,
    n_per_class: int | None = 20000,
    retries: int = 6,
    gm_fraction: float | None = None,
) -> DataFrame:
    """Cube holdout; keys without all four pools are tried again with more and larger cubes."""
    keys, open_, result = list(keys), pools, None
    base = _seed_text(seed)
    for t in range(retries):
        attempt = F.concat(base, F.lit(f":{t}"))
        share = min(0.5, fraction * (1 + 0.35 * t))
        roles = cut_lineage(patch_roles(open_, keys, grid, share, half_width + t, attempt))
        split = cut_lineage(_finish(roles, keys, n_per_class, attempt, gm_fraction).withColumn("attempt", F.lit(t)))
        result = split if result is None else result.unionByName(split)
        open_ = roles.join(split.select(*keys).distinct(), keys, "left_anti").drop("role")
        if open_.isEmpty():
            break
    return result


def _candidates(first: float, rest: Sequence[float]) -> list[float]:
    return list(dict.fromkeys([first, *rest]))


def grid_ladder(
    pools: DataFrame,
    keys: Sequence[str],
    spacing: Sequence[float],
    block_mm: float,
    buffer_mm: float,
    seed: int | Column = 42,
    fraction: float = 0.10,
    copies: str | None = None,
) -> DataFrame:
    """First feasible block and buffer size per key, all candidates judged in one grouped pass.

    Cells depend on the block only, so voxels are repeated per block (at most six times) and
    every buffer is a conditional count of the same pass.  ``copies`` is the key that numbers copies
    of the same voxels from 0 on, if there is one: the cells of the first are counted for all of them.
    """
    keys = list(keys)
    drawn = pools.select(*keys, _seed_text(seed).alias("_seed")).distinct()
    own = [k for k in keys if k != copies]
    if copies is not None:
        pools = pools.where(F.col(copies) == 0)
    blocks, buffers = _candidates(block_mm, BLOCK_MM), _candidates(buffer_mm, BUFFER_MM)
    rungs = F.array(*[F.struct(F.lit(i).alias("b"), F.lit(float(v)).alias("block_mm")) for i, v in enumerate(blocks)])
    rows = pools.select(*own, *AXES, "target", *([] if copies else [_seed_text(seed).alias("_seed")]), F.inline(rungs))
    steps = mm_to_steps("block_mm", 0.0, spacing)[:3]
    rows = rows.withColumn("cell", cell_key(steps))
    counts = _class_counts()
    for j, v in enumerate(buffers):
        sizes = mm_to_steps("block_mm", float(v), spacing)
        core = in_cell_core(sizes[:3], sizes[3:])
        counts += [F.count_if(core & (F.col("target") == c)).alias(f"_v{c}_{j}") for c in (1, 0)]
    by = [*keys, "_seed", "b", "block_mm"]
    cells = rows.groupBy(*[c for c in by if c in rows.columns], "cell").agg(*counts)
    cells = cut_lineage(cells if copies is None else drawn.join(cells, own) if own else drawn.crossJoin(cells))
    chosen = validation_cells(cells.where("_n_pos > 0 AND _n_neg > 0").select(*by, "cell"), by, F.col("_seed"), fraction)
    cells = cells.join(chosen, [*by, "cell"], "left")
    train = F.col("is_val").isNull()
    sums = [F.sum(F.when(train, F.col(c))).alias(c) for c in ("_n_pos", "_n_neg")]
    sums += [F.sum(F.when(~train, F.col(f"_v{c}_{j}"))).alias(f"_v{c}_{j}") for j in range(len(buffers)) for c in (1, 0)]
    judged = cells.groupBy(*by).agg(*sums).where("_n_pos > 0 AND _n_neg > 0")
    options = F.array(
        *[
            F.struct(F.lit(j).alias("u"), F.lit(float(v)).alias("buffer_mm"), ((F.col(f"_v1_{j}") > 0) & (F.col(f"_v0_{j}") > 0)).alias("ok"))
            for j, v in enumerate(buffers)
        ]
    )
    judged = judged.select(*by, F.inline(options)).where("ok")
    best = judged.groupBy(*keys).agg(F.min(F.struct("b", "u", "block_mm", "buffer_mm")).alias("m"))
    return best.select(*keys, "m.block_mm", "m.buffer_mm")


def adaptive_split(
    pools: DataFrame,
    keys: Sequence[str],
    grid: Grid,
    spacing: Sequence[float],
    block_mm: float = 18.0,
    buffer_mm: float = 4.0,
    seed: int | Column = 42,
    fraction: float = 0.10,
    half_width: int = 2,
    n_per_class: int | None = 20000,
    gm_fraction: float | None = None,
    min_step_vox: int = 0,
    copies: str | None = None,
) -> DataFrame:
    """Blocked split with the first feasible rung per key, else cube holdout by its own ladder.

    Adds ``mode``, ``block_mm`` and ``buffer_mm``.  A key that cannot be split keeps one row without role
    or voxel whose mode says why: ``empty_class`` or ``infeasible``.  ``min_step_vox`` thins the pools first.
    ``copies`` as in ``grid_ladder``.
    """
    keys = list(keys)
    if min_step_vox > 1:
        pools, copies = thin(pools, keys, min_step_vox, seed), None
    whole = cut_lineage(with_stats(pools, keys, _class_counts()))
    split = _adaptive_rows(whole.where("_n_pos > 0 AND _n_neg > 0").drop("_n_pos", "_n_neg"), keys, grid, spacing, block_mm, buffer_mm, seed, fraction, half_width, n_per_class, gm_fraction, copies)
    split = cut_lineage(split)
    reason = F.when(F.max(F.least("_n_pos", "_n_neg")) > 0, "infeasible").otherwise("empty_class")
    failed = whole.groupBy(*keys).agg(reason.alias("mode")).join(split.select(*keys).distinct(), keys, "left_anti")
    return split.unionByName(failed, allowMissingColumns=True)


def _adaptive_rows(
    pools: DataFrame, keys: list[str], grid: Grid, spacing: Sequence[float], block_mm: float, buffer_mm: float, seed: int | Column, fraction: float, half_width: int,
    n_per_class: int | None, gm_fraction: float | None, copies: str | None = None,
) -> DataFrame:
    """Rows of the keys that some rung can split."""
    rungs = cut_lineage(grid_ladder(pools, keys, spacing, block_mm, buffer_mm, seed, fraction, copies))
    blocked = grid_block(pools.join(rungs, keys), keys, spacing, "block_mm", "buffer_mm", seed, fraction, n_per_class, gm_fraction)
    result = blocked.withColumn("mode", F.lit("grid_block"))
    open_ = pools.join(rungs, keys, "left_anti")
    if open_.isEmpty():
        return result
    empty = F.lit(None).cast("double")
    for share in _candidates(fraction, HOLDOUT_FRACTIONS):
        for width in _candidates(half_width, HALF_WIDTHS):
            split = patch_holdout(open_, keys, grid, share, int(width), seed, n_per_class, gm_fraction=gm_fraction).drop("attempt")
            split = split.withColumns({"block_mm": empty, "buffer_mm": empty, "mode": F.lit("patch_holdout")})
            result = result.unionByName(split)
            open_ = cut_lineage(open_.join(split.select(*keys).distinct(), keys, "left_anti"))
            if open_.isEmpty():
                return result
    return result


def with_folds(pools: DataFrame, folds: int, seed: int = 42) -> DataFrame:
    """Independent draws: one copy of the pools per fold with ``fold_seed`` = seed + fold."""
    out = pools.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return out.withColumn("fold_seed", F.col("fold") + seed)


def split_audit(split: DataFrame, keys: Sequence[str]) -> DataFrame:
    return split.groupBy(*keys, "role", "target").agg(F.count(F.lit(1)).alias("n"), F.min(IDX).alias("first_idx"), F.max(IDX).alias("last_idx"))


def leave_one_out_counts(df: DataFrame, group: str, label: str) -> DataFrame:
    """Training and test sizes for each held-out group: totals minus the group's own counts."""
    own = df.where(F.col(label) != -1).groupBy(group).agg(
        F.count_if(F.col(label) == 1).alias("own_good"), F.count_if(F.col(label) == 0).alias("own_bad")
    )
    own = cut_lineage(df.groupBy(group).agg(F.count(F.lit(1)).alias("n_test")).join(own, group, "left").fillna(0, ["own_good", "own_bad"]))
    total = own.agg(F.sum("own_good").alias("g"), F.sum("own_bad").alias("b")).select(F.struct("g", "b")).scalar()
    out = own.withColumn("_t", total)
    out = out.withColumns({"n_train_good": F.col("_t.g") - F.col("own_good"), "n_train_bad": F.col("_t.b") - F.col("own_bad")})
    return out.withColumn("n_train", F.col("n_train_good") + F.col("n_train_bad")).drop("_t")


def without_group(rows: DataFrame, group: str, of: DataFrame | None = None, out: str = "held") -> DataFrame:
    """Each row once for each other group (of ``of``), named in ``out``; the list of groups travels, no rows are compared."""
    names = (rows if of is None else of).select(group).where(F.col(group).isNotNull())
    listed = cut_lineage(names.agg(F.array_sort(F.collect_set(group)).alias("_names")))
    others = F.filter("_names", lambda g: g != F.col(group))
    return attach(rows, listed, []).withColumn(out, F.explode(others)).drop("_names")


def leave_one_out_training(df: DataFrame, group: str, label: str, held: object | None = None) -> DataFrame:
    """Labelled rows of all other groups; without ``held`` one copy per held-out group, in column ``held``.

    The copies are the result itself: groups times labelled rows.
    """
    labelled = df.where(F.col(label) != -1)
    if held is not None:
        return labelled.where(F.col(group) != F.lit(held))
    return without_group(labelled, group, df)
