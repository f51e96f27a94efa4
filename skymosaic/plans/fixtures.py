"""Relations of the annotation model derived from the driver's tables, as portable SQL.

`sql(name)` gives the text for DuckDB; `frame(spark, sf_dir, name)` runs the same text in Spark. Only integer arithmetic and
rational rotations are used, so both engines hold the same bits.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DEFINITIONS = {
    "sources": """
        SELECT CAST(s_suppkey AS BIGINT) source_id, concat('src_', CAST(s_suppkey AS STRING), '.tif') source_tif,
               CAST(2304+100*(s_suppkey%5) AS BIGINT) w, CAST(2304+100*(s_suppkey%4) AS BIGINT) h
        FROM supplier""",
    "tiles": """
        SELECT source_id, source_tif, CAST(source_id*64+gy.j*8+gx.i AS BIGINT) tile_id, CAST(gx.i*384 AS BIGINT) x_off, CAST(gy.j*384 AS BIGINT) y_off,
               CAST(least(768, w-gx.i*384) AS BIGINT) tw, CAST(least(768, h-gy.j*384) AS BIGINT) th, w, h
        FROM sources CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7)) gx(i) CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7)) gy(j)
        WHERE gx.i*384 < w AND gy.j*384 < h""",
    "annotations": """
        SELECT *, cx-c*hl+s*hs x0, cy-s*hl-c*hs y0, cx+c*hl+s*hs x1, cy+s*hl-c*hs y1,
                  cx+c*hl-s*hs x2, cy+s*hl+c*hs y2, cx-c*hl-s*hs x3, cy-s*hl+c*hs y3
        FROM (
          SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING),
                                CAST(l_suppkey AS STRING), CAST(CAST(l_quantity AS INT) AS STRING)) ann_id,
                 l_suppkey source_id, l_orderkey, l_partkey, l_linenumber, l_discount,
                 CAST(CASE WHEN l_partkey%8=7 THEN 9 ELSE l_partkey%8 END AS INT) class_raw,
                 CAST((l_orderkey*7919+l_partkey*104729+l_linenumber*31)%w AS DOUBLE) cx,
                 CAST((l_orderkey*6101+l_partkey*15485863+l_linenumber*17)%h AS DOUBLE) cy,
                 5.0e0+l_quantity*0.5e0 hl, 2.0e0+CAST(l_partkey%7 AS DOUBLE) hs,
                 CASE l_partkey%4 WHEN 0 THEN 1.0e0 WHEN 1 THEN 0.6e0 WHEN 2 THEN 0.28e0 ELSE 0.96e0 END c,
                 CASE l_partkey%4 WHEN 0 THEN 0.0e0 WHEN 1 THEN 0.8e0 WHEN 2 THEN 0.96e0 ELSE 0.28e0 END s
          FROM lineitem JOIN sources ON l_suppkey = source_id) z""",
    # islands on a raster of degrees, every third with a lake; no two meet
    "islands": """
        SELECT k, west, south, west+0.11e0+CAST(k%7 AS DOUBLE)*0.01e0 east, south+0.12e0+CAST(k%5 AS DOUBLE)*0.01e0 north, k%3 = 0 lake,
               west+0.03e0 lw, south+0.04e0 ls, west+0.08e0 le, south+0.09e0 ln
        FROM (SELECT k, 43.013e0+CAST(k%40 AS DOUBLE)*0.25e0 west, -25.517e0+CAST((k-k%40)/40 AS BIGINT)*0.3e0 south FROM (SELECT CAST(s_suppkey AS BIGINT) k FROM supplier) a) b""",
    "truth": "SELECT * FROM annotations WHERE class_raw <> 9",
    "predictions": """
        SELECT ann_id pred_id, source_id, concat('prompt_', CAST(l_linenumber%3 AS STRING)) label, 0.25e0+7e0*l_discount conf,
               x0+dx x0, y0+dy y0, x1+dx x1, y1+dy y1, x2+dx x2, y2+dy y2, x3+dx x3, y3+dy y3
        FROM (SELECT *, CAST((l_partkey%5)-2 AS DOUBLE) dx, CAST((l_linenumber%3)-1 AS DOUBLE) dy FROM truth WHERE l_orderkey%5 <> 0) a
        UNION ALL
        SELECT concat('twin-', ann_id), source_id, concat('prompt_', CAST(l_linenumber%3 AS STRING)), 0.2e0+7e0*l_discount,
               x0+1e0, y0, x1+1e0, y1, x2+1e0, y2, x3+1e0, y3
        FROM truth WHERE l_orderkey%11 = 1
        UNION ALL
        SELECT concat('fp-', ann_id), source_id, concat('prompt_', CAST(l_linenumber%3 AS STRING)), 0.25e0+7e0*l_discount,
               x0+400e0, y0, x1+400e0, y1, x2+400e0, y2, x3+400e0, y3
        FROM truth WHERE l_orderkey%7 = 0""",
}
TABLES = ("supplier", "lineitem")


def _needs(text: str) -> list[str]:
    return [n for n in DEFINITIONS if re.search(rf"(FROM|JOIN) {n}\b", text)]


def with_needed(query: str, spark: bool = False) -> str:
    """`query` behind the definitions that it reads; `query` itself has no WITH."""
    order: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for n in _needs(text):
            if n not in seen:
                seen.add(n)
                visit(DEFINITIONS[n])
                order.append(n)

    visit(query)
    if not order:
        return query if spark else query.replace("STRING", "VARCHAR")
    recursive = "RECURSIVE " if any(re.search(rf"FROM {n} ", DEFINITIONS[n]) for n in order) else ""
    text = f"WITH {recursive}" + ",\n".join(f"{n} AS ({DEFINITIONS[n]})" for n in order) + "\n" + query
    return text if spark else text.replace("STRING", "VARCHAR")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The relation as a DataFrame; annotations and predictions also get `points`, their corners."""
    text = with_needed(f"SELECT * FROM {name}", spark=True)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"(FROM|JOIN) {t}\b", text)}
    for t in used:
        text = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    df = spark.sql(text, **used)
    if "x3" in df.columns:
        points = ", ".join(f"named_struct('x', x{k}, 'y', y{k})" for k in range(4))
        df = df.selectExpr("*", f"array({points}) AS points")
    return df
