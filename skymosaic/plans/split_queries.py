"""Queries of train, validation and test splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import splits
from .evaluation_queries import SPLIT, split_counts
from .fixtures import DEFINITIONS, frame
from .geometry_queries import pairs
from .registry import query

_PENALTY = "CASE WHEN tr+va+te = 0 THEN 0e0 ELSE pow(tr/(tr+va+te)-0.7e0, 2)*(tr+va+te)+pow(va/(tr+va+te)-0.15e0, 2)*(tr+va+te)+pow(te/(tr+va+te)-0.15e0, 2)*(tr+va+te)+1e6*(CASE WHEN va = 0 THEN 1 ELSE 0 END+CASE WHEN te = 0 THEN 1 ELSE 0 END) END"
_FEASIBLE = "tr+va+te > 0 AND abs(tr/nullif(tr+va+te, 0)-0.7e0) <= 0.1e0 AND abs(va/nullif(tr+va+te, 0)-0.15e0) <= 0.1e0 AND abs(te/nullif(tr+va+te, 0)-0.15e0) <= 0.1e0"
_SPLITS3 = "coalesce(sum({n}) FILTER (WHERE split = 'train'), 0)*1e0 tr, coalesce(sum({n}) FILTER (WHERE split = 'val'), 0)*1e0 va, coalesce(sum({n}) FILTER (WHERE split = 'test'), 0)*1e0 te"
_CUT = "CASE WHEN y_off+th <= b1 THEN 'train' WHEN y_off >= b1 AND y_off+th <= b2 THEN 'val' WHEN y_off >= b2 THEN 'test' ELSE 'buffer' END"

DEFINITIONS["cuts"] = "SELECT DISTINCT source_id, y_off FROM tiles"
DEFINITIONS["cut_pairs"] = "SELECT a.source_id, a.y_off b1, b.y_off b2 FROM cuts a JOIN cuts b ON a.source_id = b.source_id AND b.y_off > a.y_off"
DEFINITIONS["cut_ratios"] = f"SELECT source_id, b1, b2, {_SPLITS3.format(n='1')} FROM (SELECT p.source_id, b1, b2, {_CUT} split FROM cut_pairs p JOIN tiles t ON p.source_id = t.source_id) a GROUP BY 1, 2, 3"
DEFINITIONS["cut_scores"] = f"""
    SELECT source_id, b1, b2, sum({_PENALTY}) score FROM
    (SELECT source_id, b1, b2, class_id, {_SPLITS3.format(n='1')} FROM
     (SELECT p.source_id, b1, b2, class_id, {_CUT} split FROM cut_pairs p JOIN (SELECT l.source_id, class_id, y_off, th FROM tile_labels l JOIN tiles t ON l.tile_id = t.tile_id) l ON p.source_id = l.source_id) a
     WHERE split <> 'buffer' GROUP BY 1, 2, 3, 4) b GROUP BY 1, 2, 3"""


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("tile_id", "class_id")


@query(f"""
    SELECT r.source_id, r.b1, r.b2, CAST(tr AS BIGINT) train, CAST(va AS BIGINT) val, CAST(te AS BIGINT) test, {_FEASIBLE} feasible, round(coalesce(score, 0e0), 4) score
    FROM cut_ratios r LEFT JOIN cut_scores s ON r.source_id = s.source_id AND r.b1 = s.b1 AND r.b2 = s.b2""")
def split_boundary_search(spark, sf_dir):
    out = splits.boundary_search(frame(spark, sf_dir, "tiles").select("source_id", "tile_id", "y_off", "th"), _labels(spark, sf_dir))
    return out.withColumn("score", F.round("score", 4))


@query(f"""
    SELECT c.source_id, coalesce(b.b1, r[least(round_even(len(r)*0.7e0, 0), len(r)-1)::INT+1]) b1, coalesce(b.b2, r[least(round_even(len(r)*0.85e0, 0), len(r)-1)::INT+1]) b2, b.score FROM
    (SELECT source_id, list(y_off ORDER BY y_off) r FROM cuts GROUP BY 1) c LEFT JOIN
    (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score, b1, b2) rn FROM
     (SELECT r.source_id, r.b1, r.b2, round(coalesce(score, 0e0), 6) score FROM cut_ratios r LEFT JOIN cut_scores s ON r.source_id = s.source_id AND r.b1 = s.b1 AND r.b2 = s.b2 WHERE {_FEASIBLE}) f) b
    ON c.source_id = b.source_id AND rn = 1""")
def split_best_boundaries(spark, sf_dir):
    tiles = frame(spark, sf_dir, "tiles").select("source_id", "tile_id", "y_off", "th")
    return splits.best_boundaries(splits.boundary_search(tiles, _labels(spark, sf_dir)), tiles)


_SIX = "SELECT i.a assignment, s.source_id, CASE CAST(trunc(i.a/pow(3, 5-s.source_id)) AS BIGINT)%3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END split FROM (SELECT unnest(range(729)) a) i CROSS JOIN (SELECT source_id FROM sources WHERE source_id < 6) s"
DEFINITIONS["six"] = _SIX
DEFINITIONS["six_tiles"] = f"SELECT assignment, count(DISTINCT split) kinds, {_SPLITS3.format(n='n')} FROM (SELECT assignment, split, n FROM six x JOIN (SELECT source_id, count(*) n FROM tiles GROUP BY 1) t ON x.source_id = t.source_id) a GROUP BY 1"
DEFINITIONS["six_scores"] = f"SELECT assignment, sum({_PENALTY}) score FROM (SELECT assignment, class_id, {_SPLITS3.format(n='n')} FROM six x JOIN (SELECT source_id, class_id, count(*) n FROM tile_labels GROUP BY 1, 2) l ON x.source_id = l.source_id GROUP BY 1, 2) a GROUP BY 1"


@query(f"SELECT t.assignment, kinds = 3 AND {_FEASIBLE} feasible, CASE WHEN kinds = 3 AND {_FEASIBLE} THEN round(score, 4) END score FROM six_tiles t JOIN six_scores s ON t.assignment = s.assignment")
def split_exhaustive(spark, sf_dir):
    """All 729 assignments of the first six sources."""
    tiles = frame(spark, sf_dir, "tiles").filter("source_id < 6")
    scored = splits.exhaustive(splits.source_counts(tiles, pairs(spark, sf_dir).filter("source_id < 6").select("tile_id", "class_id")))
    return scored.select("assignment", "feasible", F.round("score", 4).alias("score"))


@query()
def split_hill_climb(spark, sf_dir):
    """All sources in splits by the climb from random starts; the search runs on one row a source."""
    tiles = frame(spark, sf_dir, "tiles").select("source_id", "tile_id", "y_off", "th")
    per = splits.source_counts(tiles, pairs(spark, sf_dir).select("tile_id", "class_id")).orderBy("source_id").collect()
    found = splits.hill_climb([r.n_tiles for r in per], [r.counts for r in per], spark)
    rows = [(r.source_id, splits.SPLITS[d], found[1]) for r, d in zip(per, found[0])] if found else []
    return spark.createDataFrame(rows, "source_id long, split string, score double")


@query("""
    SELECT class_id, CAST(tr AS BIGINT) train, CAST(va AS BIGINT) val, CAST(te AS BIGINT) test, CAST(tr+va+te AS BIGINT) total, round(va/(tr+va+te), 6) val_share, round(te/(tr+va+te), 6) test_share,
           abs(va/(tr+va+te)-0.15e0) < 0.05e0 AND abs(te/(tr+va+te)-0.15e0) < 0.05e0 balanced FROM (SELECT class_id, """ + _SPLITS3.format(n="n") + " FROM split_counts GROUP BY 1) a")
def split_balance_report(spark, sf_dir):
    return splits.balance(split_counts(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("val_share", "test_share")})


@query("""
    SELECT class_id, split, n, round(share, 6) share, round(sum(share) OVER (PARTITION BY class_id ORDER BY CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END ROWS UNBOUNDED PRECEDING), 6) upto
    FROM (SELECT class_id, split, n, n/CAST(sum(n) OVER (PARTITION BY class_id) AS DOUBLE)*100 share FROM split_counts) a""")
def split_running_shares(spark, sf_dir):
    return splits.running_shares(split_counts(spark, sf_dir)).select("class_id", "split", "n", F.round("share", 6).alias("share"), F.round("upto", 6).alias("upto"))


# Background: tiles that no label of class 0 falls on.
DEFINITIONS["tile_state"] = f"SELECT t.tile_id, {SPLIT.replace('source_id', 't.source_id')} split, count(l.ann_id) n_labels FROM tiles t LEFT JOIN (SELECT * FROM tile_labels WHERE class_id = 0) l ON t.tile_id = l.tile_id GROUP BY 1, 2"
DEFINITIONS["downsampled"] = """
    SELECT tile_id, s.split, n_labels, n_labels = 0 AND rn > CASE WHEN annotated = 0 THEN background ELSE least(floor(annotated*(0.1e0/(1e0-0.1e0))), background) END archived FROM
    (SELECT *, row_number() OVER (PARTITION BY split, n_labels = 0 ORDER BY md5(concat('42-', CAST(tile_id AS STRING)))) rn FROM tile_state) s JOIN
    (SELECT split, count(*) FILTER (WHERE n_labels > 0) annotated, count(*) FILTER (WHERE n_labels = 0) background FROM tile_state GROUP BY 1) c ON s.split = c.split"""


def _downsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = pairs(spark, sf_dir).filter("class_id = 0").groupBy("tile_id").agg(F.count("*").alias("n_labels"))
    tiles = frame(spark, sf_dir, "tiles").select("tile_id", F.expr(SPLIT).alias("split")).join(n, "tile_id", "left").na.fill(0)
    return splits.downsample_background(tiles)


@query("SELECT tile_id, split, n_labels, archived FROM downsampled")
def downsample_background(spark, sf_dir):
    return _downsampled(spark, sf_dir).select("tile_id", "split", "n_labels", "archived")


@query("SELECT tile_id, 'train' split, CASE WHEN archived THEN 'archive' ELSE split END came_from, false archived FROM downsampled")
def reset_consolidate(spark, sf_dir):
    return splits.consolidate(_downsampled(spark, sf_dir)).select("tile_id", "split", "came_from", "archived")
