"""Registered queries: dilation, erosion, distances, components, smoothing."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import grid as G, spatial as S
from ..session import cut_lineage
from .registry import query

GRID = G.Grid(fx.NX, fx.NY, fx.NZ, fx.VX, fx.VY, fx.VZ)
SPACING = (fx.VX, fx.VY, fx.VZ)
KEYS = ["patient"]
CORE = "seg_a IN (1,3) AND brain"
TUMOUR = "seg_a IN (1,2,3) AND brain"
SUPRA = "p >= 0.62 AND brain"

_PATIENTS = "SELECT DISTINCT patient FROM vox"
# every cell of the padded box, for operators that look outside the stored voxels
_BOX = (
    "SELECT patient, bx.x AS x, bx.y AS y, bx.z AS z FROM patients, "
    "(SELECT a.i AS x, b.i AS y, c.i AS z FROM (SELECT unnest(generate_series(-3, 22)) AS i) a, "
    "(SELECT unnest(generate_series(-3, 22)) AS i) b, (SELECT unnest(generate_series(-3, 12)) AS i) c) bx"
)


def _core(spark, sf):
    return fx.vox_mask(spark, sf).where(CORE).select("patient", *G.AXES)


def _near_sql(seed: str, n: int) -> str:
    return (
        f"SELECT b.patient, b.x, b.y, b.z, MIN(abs(b.x-s.x)+abs(b.y-s.y)+abs(b.z-s.z)) AS l1 FROM box b JOIN ({seed}) s "
        f"ON b.patient = s.patient AND abs(b.x-s.x)+abs(b.y-s.y)+abs(b.z-s.z) <= {n} GROUP BY 1,2,3,4"
    )


_CORE_SQL = f"SELECT patient, x, y, z FROM vm WHERE {CORE}"
_EXTRA = {"patients": _PATIENTS, "box": _BOX}


@query(
    "m1_binary_dilation",
    "patient:i x:i y:i z:i l1:i",
    fx.with_views(_near_sql(_CORE_SQL, 3), "vm", extra=_EXTRA),
)
def dilation(spark, sf):
    """Positions within three steps of the tumour core."""
    return S.l1_within(_core(spark, sf), KEYS, 3)


_ERODE = (
    "SELECT m.patient, m.x, m.y, m.z FROM m WHERE NOT EXISTS (SELECT 1 FROM box b LEFT JOIN m q ON q.patient=b.patient AND q.x=b.x "
    "AND q.y=b.y AND q.z=b.z WHERE q.x IS NULL AND b.patient=m.patient AND abs(b.x-m.x)+abs(b.y-m.y)+abs(b.z-m.z) <= {n})"
)
_M = {**_EXTRA, "m": f"SELECT patient, x, y, z FROM vm WHERE {TUMOUR}"}


@query("m2_binary_erosion", "patient:i x:i y:i z:i", fx.with_views(_ERODE.format(n=2), "vm", extra=_M))
def erosion(spark, sf):
    """Tumour voxels whose whole two-step neighbourhood is tumour."""
    return S.erode(fx.vox_mask(spark, sf).where(TUMOUR), KEYS, 2)


@query("m2_binary_erosion_once", "patient:i x:i y:i z:i", fx.with_views(_ERODE.format(n=1), "vm", extra=_M))
def erosion_once(spark, sf):
    return S.erode(fx.vox_mask(spark, sf).where(TUMOUR), KEYS, 1)


@query(
    "m3_inner_border",
    "patient:i x:i y:i z:i",
    fx.with_views(
        "SELECT m.patient, m.x, m.y, m.z FROM m JOIN m q ON q.patient=m.patient AND abs(q.x-m.x)<=1 AND abs(q.y-m.y)<=1 "
        "AND abs(q.z-m.z)<=1 GROUP BY 1,2,3,4 HAVING COUNT(*) < 27",
        "vm",
        extra=_M,
    ),
)
def inner_border(spark, sf):
    """Tumour voxels lost by one erosion with a full cube."""
    return S.inner_border(fx.vox_mask(spark, sf).where(TUMOUR), KEYS)


def _components_sql(reach: int, where: str = SUPRA) -> dict[str, str]:
    return {
        "s": f"SELECT patient, x, y, z, flat_idx FROM vm WHERE {where}",
        "edge": "SELECT a.patient, a.flat_idx AS u, b.flat_idx AS v FROM s a JOIN s b ON a.patient=b.patient AND abs(a.x-b.x)<=1 "
        f"AND abs(a.y-b.y)<=1 AND abs(a.z-b.z)<=1 AND abs(a.x-b.x)+abs(a.y-b.y)+abs(a.z-b.z) <= {reach}",
        "walk": "SELECT patient, u AS root, v AS node FROM edge UNION "
        "SELECT w.patient, w.root, e.v FROM walk w JOIN edge e ON e.patient=w.patient AND e.u=w.node",
        "comp": "SELECT patient, node AS flat_idx, MIN(root) AS cid FROM walk GROUP BY 1,2",
    }


def recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "m4_components_18",
    "patient:i flat_idx:i cid:i",
    recursive(fx.with_views("SELECT patient, flat_idx, cid FROM comp", "vm", extra=_components_sql(2))),
)
def components_18(spark, sf):
    """Components of the suprathreshold voxels, merged across blocks of 16."""
    return S.connected_components(fx.vox_mask(spark, sf).where(SUPRA), KEYS, GRID, 18, block=16)


@query(
    "m4_components_26",
    "patient:i flat_idx:i cid:i",
    recursive(fx.with_views("SELECT patient, flat_idx, cid FROM comp", "vm", extra=_components_sql(3))),
)
def components_26(spark, sf):
    return S.connected_components(fx.vox_mask(spark, sf).where(SUPRA), KEYS, GRID, 26)


@query(
    "m5_euclidean_distance",
    "patient:i x:i y:i z:i dist:d6",
    fx.with_views(
        "SELECT t.patient, t.x, t.y, t.z, sqrt(MIN(4.0*(t.x-s.x)*(t.x-s.x)+4.0*(t.y-s.y)*(t.y-s.y)+6.25*(t.z-s.z)*(t.z-s.z))) AS dist "
        f"FROM (SELECT * FROM vm WHERE brain) t LEFT JOIN ({_CORE_SQL}) s ON s.patient=t.patient GROUP BY 1,2,3,4",
        "vm",
    ),
)
def euclidean(spark, sf):
    """Distance in mm of every brain voxel to the tumour core."""
    vm = fx.vox_mask(spark, sf)
    return S.euclidean_distance(vm.where("brain"), vm.where(CORE), KEYS, SPACING)


@query(
    "m6_signed_distance",
    "patient:i x:i y:i z:i signed_dist:d6",
    fx.with_views(
        "SELECT t.patient, t.x, t.y, t.z, CASE WHEN t.tum THEN -0.25 * sqrt(MIN(CASE WHEN s.x IS NULL THEN d END)) "
        "ELSE 0.25 * sqrt(MIN(CASE WHEN s.x IS NOT NULL THEN d END)) END AS signed_dist FROM (SELECT t.patient, t.x, t.y, t.z, t.tum, "
        "b.x AS bx, b.y AS by_, b.z AS bz, (t.x-b.x)*(t.x-b.x)+(t.y-b.y)*(t.y-b.y)+(t.z-b.z)*(t.z-b.z) AS d FROM tgt t JOIN "
        "(SELECT * FROM box WHERE x BETWEEN 0 AND 19 AND y BETWEEN 0 AND 19 AND z BETWEEN 0 AND 9) b ON b.patient=t.patient) t "
        "LEFT JOIN m s ON s.patient=t.patient AND s.x=t.bx AND s.y=t.by_ AND s.z=t.bz GROUP BY t.patient, t.x, t.y, t.z, t.tum",
        "vm",
        extra={
            **_M,
            "tgt": f"SELECT patient, x, y, z, ({TUMOUR}) AS tum FROM vm WHERE brain",
        },
    ),
)
def signed(spark, sf):
    """Quarter-scaled signed distance to the tumour surface."""
    vm = cut_lineage(fx.vox_mask(spark, sf).select("patient", *"xyz", "brain", "seg_a"))
    return S.signed_distance(vm.where("brain"), vm.where(TUMOUR), KEYS, GRID, scale=0.25)


_SURFACE = (
    "SELECT patient, COUNT(*) AS n_voxels, SUM((2-fx)*5.0+(2-fy)*5.0+(2-fz)*4.0) AS area_mm2 FROM (SELECT a.patient, a.x, a.y, a.z, "
    "COUNT(CASE WHEN b.x<>a.x THEN 1 END) AS fx, COUNT(CASE WHEN b.y<>a.y THEN 1 END) AS fy, COUNT(CASE WHEN b.z<>a.z THEN 1 END) AS fz "
    "FROM m a LEFT JOIN m b ON a.patient=b.patient AND abs(a.x-b.x)+abs(a.y-b.y)+abs(a.z-b.z)=1 GROUP BY 1,2,3,4) GROUP BY 1"
)


@query("m7_surface_area", "patient:i n_voxels:i area_mm2:d6", fx.with_views(_SURFACE, "vm", extra=_M))
def surface(spark, sf):
    """Exposed face area of the tumour."""
    return S.surface_area(fx.vox_mask(spark, sf).where(TUMOUR), KEYS, GRID)


@query(
    "m8_sphericity",
    "patient:i volume_mm3:d6 sphericity:d6",
    fx.with_views(
        f"SELECT patient, n_voxels*10.0 AS volume_mm3, {math.pi ** (1 / 3)!r}::DOUBLE * pow(60.0::DOUBLE*n_voxels, 2.0::DOUBLE/3.0::DOUBLE)/area_mm2 AS sphericity FROM ({_SURFACE})",
        "vm",
        extra=_M,
    ),
)
def sphericity(spark, sf):
    return S.surface_area(fx.vox_mask(spark, sf).where(TUMOUR), KEYS, GRID)


def _kernel_sql() -> str:
    rows = []
    for d in range(-2, 3):
        w = [math.exp(-0.5 * (d / (2.5 / 2.3548 / v)) ** 2) for v in SPACING]
        rows.append(f"({d}, {w[0]!r}::DOUBLE, {w[2]!r}::DOUBLE)")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) k(d, wxy, wz)"


@query(
    "m9_gaussian_smoothing",
    "patient:i x:i y:i z:i p:d6",
    fx.with_views(
        "SELECT a.patient, a.x, a.y, a.z, SUM(kx.wxy*ky.wxy*kz.wz*b.p)/SUM(kx.wxy*ky.wxy*kz.wz) AS p FROM vm a JOIN vm b "
        "ON a.patient=b.patient AND b.x BETWEEN a.x-2 AND a.x+2 AND b.y BETWEEN a.y-2 AND a.y+2 AND b.z BETWEEN a.z-2 AND a.z+2 "
        "JOIN k kx ON kx.d=b.x-a.x JOIN k ky ON ky.d=b.y-a.y JOIN k kz ON kz.d=b.z-a.z GROUP BY 1,2,3,4",
        "vm",
        extra={"k": _kernel_sql()},
    ),
)
def smoothing(spark, sf):
    """2.5 mm FWHM Gaussian of the probability map over the stored voxels."""
    return S.gaussian_smooth(fx.vox_mask(spark, sf), KEYS, SPACING, "p", block=8)
