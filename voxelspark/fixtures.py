"""Deterministic views over the test tables, spelled once for Spark and the SQL oracle.

See FIXTURES.md.  ``*_SQL`` texts run on DuckDB; the functions build the same view in Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

NX, NY, NZ = 20, 20, 10
VX, VY, VZ = 2.0, 2.0, 2.5
ORDERS_PER_PATIENT = 3750
SERIES_PER_PATIENT = 125

_VOX_KEYS = {
    "patient": f"CAST(FLOOR(l_orderkey / {ORDERS_PER_PATIENT}) AS INT)",
    "x": "CAST(l_partkey % 20 AS INT)",
    "y": "CAST(l_suppkey % 20 AS INT)",
    "z": "CAST(l_orderkey % 10 AS INT)",
}
_VOX_AGGS = {
    "p_nec": "CAST(SUM(CAST(ROUND(l_discount*100) AS BIGINT)) AS DOUBLE) / (10.0 * COUNT(*))",
    "p_enh": "CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE) / (50.0 * COUNT(*))",
    "p_mix": "CAST(SUM(CAST(ROUND(l_tax*100) AS BIGINT)) AS DOUBLE) / (8.0 * COUNT(*))",
    "n": "COUNT(*)",
}
_CENTRE = "(x-{c})*(x-{c})+(y-8)*(y-8)+(z-5)*(z-5)"


def _seg(c: int) -> str:
    r = _CENTRE.format(c=c)
    return f"CASE WHEN {r}<=2 THEN 1 WHEN {r}<=6 THEN 3 WHEN {r}<=16 THEN 2 ELSE 0 END"


_MASK_COLS = {
    "brain": "((x-9.5)*(x-9.5)+(y-9.5)*(y-9.5))/90.25 + (z-4.5)*(z-4.5)/20.25 <= 1.1",
    "seg_a": _seg(7),
    "seg_b": _seg(8),
    "parc": "CASE (x+y+z) % 5 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 41 WHEN 3 THEN 4 ELSE 42 END",
}
_SCORED_COLS = {
    "id": "o_orderkey",
    "fold": "CAST(o_orderkey % 4 AS INT)",
    "y": "CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 1 ELSE 0 END",
    "s_rf": "CAST(0.7 AS DOUBLE)*(o_totalprice/CAST(500000 AS DOUBLE)) + CAST(0.3 AS DOUBLE)*"
    "CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 1 ELSE 0 END",
    "s_svm": "(o_custkey % 97)/CAST(96 AS DOUBLE)",
    "s_lr": "CAST((o_orderkey*31 + 200*CASE WHEN o_orderpriority='1-URGENT' THEN 1 ELSE 0 END) % 1009 AS DOUBLE)"
    "/CAST(1008 AS DOUBLE)",
}
_MOTION_COLS = {
    "patient": "CAST(o_orderkey % 5 AS INT)",
    "t": "CAST(FLOOR(o_orderkey/5) AS INT)",
    "tx": "(o_orderkey%7)/CAST(10 AS DOUBLE)",
    "ty": "(o_orderkey%11)/CAST(10 AS DOUBLE)",
    "tz": "(o_orderkey%13)/CAST(10 AS DOUBLE)",
    "rx": "(o_orderkey%17)/CAST(1000 AS DOUBLE)",
    "ry": "(o_orderkey%19)/CAST(1000 AS DOUBLE)",
    "rz": "(o_orderkey%23)/CAST(1000 AS DOUBLE)",
}
_FOLLOWUP_KEYS = {**_VOX_KEYS, "visit": "CAST(YEAR(l_shipdate) AS INT)"}
_FOLLOWUP_AGGS = {"v": "CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE)/COUNT(*)"}
_EVENT_KEYS = {
    "patient": "CAST(user_id % 3 AS INT)",
    "voxel": "user_id",
    "t": "CAST(DAY(ts)-1 AS INT)",
}
_EVENT_AGGS = {"value": "CAST(SUM(CAST(ROUND(value*100) AS BIGINT)) AS DOUBLE)/(100.0*COUNT(*))"}
_PAIR_KEYS = {"unit": "c_nationkey"}
_PAIR_AGGS = {
    "a": "ROUND(AVG(CASE WHEN o_orderstatus='F' THEN o_totalprice END), 3)",
    "b": "ROUND(AVG(CASE WHEN o_orderstatus='O' THEN o_totalprice END), 3)",
}
_FILE_COLS = {
    "name": "CONCAT('MR', LPAD(CAST(CAST(FLOOR(p_partkey/53) AS INT) AS VARCHAR(9)),5,'0'),'_',"
    "CAST(p_partkey AS VARCHAR(12)), CASE WHEN p_size=1 THEN '.json' ELSE '.dcm' END)",
}
_SERIES_COLS = {
    "patient": f"CAST(FLOOR(vec_id/{SERIES_PER_PATIENT}) AS INT)",
    "x": f"CAST(FLOOR((vec_id%{SERIES_PER_PATIENT})/25) AS INT)",
    "y": "CAST(FLOOR((vec_id%25)/5) AS INT)",
    "z": "CAST(vec_id%5 AS INT)",
    "flat_idx": f"vec_id%{SERIES_PER_PATIENT}",
    "label": "label",
    "wm": "label IN (0,1)",
}


def _select(cols: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in cols.items())


def _grouped(keys: dict[str, str], aggs: dict[str, str], table: str) -> str:
    by = ", ".join(str(i + 1) for i in range(len(keys)))
    return f"SELECT {_select(keys)}, {_select(aggs)} FROM {table} GROUP BY {by}"


VOX_SQL = (
    f"SELECT *, CAST(x*{NY * NZ} + y*{NZ} + z AS BIGINT) AS flat_idx FROM (" + _grouped(_VOX_KEYS, _VOX_AGGS, "lineitem") + ")"
)
SQL = {
    "vox": VOX_SQL,
    "vm": f"SELECT *, (p_nec+p_enh+p_mix)/3 AS p, {_select(_MASK_COLS)} FROM vox",
    "scored": f"SELECT {_select(_SCORED_COLS)} FROM orders",
    "motion": f"SELECT {_select(_MOTION_COLS)} FROM orders",
    "followup": _grouped(_FOLLOWUP_KEYS, _FOLLOWUP_AGGS, "lineitem"),
    "events_long": _grouped(_EVENT_KEYS, _EVENT_AGGS, "events"),
    "pairs": _grouped(_PAIR_KEYS, _PAIR_AGGS, "orders JOIN customer ON o_custkey=c_custkey"),
    "files": f"SELECT {_select(_FILE_COLS)} FROM part",
    "series": f"SELECT {_select(_SERIES_COLS)}, "
    "list_transform(embedding, lambda v: CAST(100 AS DOUBLE) + CAST(10 AS DOUBLE)*CAST(v AS DOUBLE)) AS ts FROM embeddings",
    "slong": "SELECT patient, flat_idx, x, y, z, label, wm, CAST(i-1 AS INT) AS t, ts[i] AS v "
    "FROM (SELECT *, unnest(generate_series(1, len(ts))) AS i FROM series)",
}
_NEEDS = {"vm": ["vox"], "slong": ["series"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _group(df: DataFrame, keys: dict[str, str], aggs: dict[str, str]) -> DataFrame:
    return df.groupBy(*[F.expr(e).alias(n) for n, e in keys.items()]).agg(*[F.expr(e).alias(n) for n, e in aggs.items()])


def _project(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e).alias(n) for n, e in cols.items()])


def vox(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _group(table(spark, sf_dir, "lineitem"), _VOX_KEYS, _VOX_AGGS)
    return df.withColumn("flat_idx", F.expr(f"CAST(x*{NY * NZ} + y*{NZ} + z AS BIGINT)"))


def vox_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vox(spark, sf_dir).withColumn("p", F.expr("(p_nec+p_enh+p_mix)/3"))
    return df.withColumns({n: F.expr(e) for n, e in _MASK_COLS.items()})


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "orders"), _SCORED_COLS)


def motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "orders"), _MOTION_COLS)


def followup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _group(table(spark, sf_dir, "lineitem"), _FOLLOWUP_KEYS, _FOLLOWUP_AGGS)


def events_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _group(table(spark, sf_dir, "events"), _EVENT_KEYS, _EVENT_AGGS)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return _group(orders.join(customer, F.expr("o_custkey = c_custkey")), _PAIR_KEYS, _PAIR_AGGS)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "part"), _FILE_COLS)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.transform("embedding", lambda v: F.lit(100.0) + F.lit(10.0) * v.cast("double")).alias("ts")
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(*[F.expr(e).alias(n) for n, e in _SERIES_COLS.items()], ts)


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the fixture views (and ``extra`` ones) it needs."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in _NEEDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({SQL[n]})" for n in order]
    ctes += [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
