"""Registration of queries, and SQL text that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from .fixtures import DEFINITIONS, with_needed

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function under its name; `sql` may read the relations of `fixtures` and those below."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_needed(sql)
        return f

    return add


# Polygons in the oracle's SQL: lists of {x, y} worked on by list lambdas, in the order of arithmetic of functions.geometry.


def quad(x: str = "x{}", y: str = "y{}") -> str:
    return "[" + ", ".join(f"{{'x': {x.format(k)}, 'y': {y.format(k)}}}" for k in range(4)) + "]"


def signed_area(points: str) -> str:
    terms = "list_transform(range(1, len(pp)+1), lambda i: pp[i].x*pp[i%len(pp)+1].y - pp[i%len(pp)+1].x*pp[i].y)"
    return f"list_transform([{points}], lambda pp: CASE WHEN len(pp) < 3 THEN 0e0 ELSE list_reduce({terms}, lambda a, b: a + b) / 2 END)[1]"


def area(points: str) -> str:
    return f"abs({signed_area(points)})"


def clip(points: str, value: Callable[[str], str], bound: str, op: str) -> str:
    p, q = "pp[i]", "pp[i%len(pp)+1]"
    t = f"(({bound} - {value(p)}) / ({value(q)} - {value(p)}))"
    cross = f"{{'x': {p}.x + ({q}.x - {p}.x) * {t}, 'y': {p}.y + ({q}.y - {p}.y) * {t}}}"
    a, b = f"{value(p)} {op} {bound}", f"{value(q)} {op} {bound}"
    edge = f"CASE WHEN {a} AND {b} THEN [{q}] WHEN {a} THEN [{cross}] WHEN {b} THEN [{cross}, {q}] ELSE pp[1:0] END"
    return f"list_transform([{points}], lambda pp: CASE WHEN len(pp) = 0 THEN pp ELSE flatten(list_transform(range(1, len(pp)+1), lambda i: {edge})) END)[1]"


def clipped(inner: str, points: str, steps: list[tuple[Callable[[str], str], str, str]]) -> str:
    """`inner` with p0 (the points) to pN (after N cuts)."""
    out = f"SELECT *, {points} p0 FROM ({inner}) q"
    for k, (value, bound, op) in enumerate(steps):
        out = f"SELECT *, {clip(f'p{k}', value, bound, op)} p{k + 1} FROM ({out}) q{k}"
    return out


BOX = "least(x0,x1,x2,x3) bx0, least(y0,y1,y2,y3) by0, greatest(x0,x1,x2,x3) bx1, greatest(y0,y1,y2,y3) by1"
_x, _y = (lambda p: f"{p}.x"), (lambda p: f"{p}.y")

_pairs = f"""
    SELECT tile_id, t.source_id, ann_id, points, CAST(CASE class_raw WHEN 6 THEN 4 ELSE class_raw END AS INT) class_id,
           CAST(x_off AS DOUBLE) tx0, CAST(y_off AS DOUBLE) ty0, CAST(x_off+tw AS DOUBLE) tx1, CAST(y_off+th AS DOUBLE) ty1,
           bx0 >= x_off AND bx1 <= x_off+tw AND by0 >= y_off AND by1 <= y_off+th whole
    FROM tiles t JOIN (SELECT ann_id, source_id, class_raw, {quad()} points, {BOX} FROM annotations WHERE class_raw <> 9) a ON t.source_id = a.source_id
     AND x_off <= bx1 AND bx0 <= x_off+tw AND y_off <= by1 AND by0 <= y_off+th"""
_cut = clipped(_pairs, "CASE WHEN whole THEN points[1:0] ELSE points END", [(_x, "tx0", ">="), (_x, "tx1", "<="), (_y, "ty0", ">="), (_y, "ty1", "<=")])
#: Pairs of tiles and annotations with the visible share, and those that are kept as labels (the oracle's side only).
DEFINITIONS["tile_pairs"] = f"SELECT tile_id, source_id, ann_id, class_id, CASE WHEN whole THEN 1e0 ELSE {area('p4')}/{area('points')} END visible FROM ({_cut}) c"
DEFINITIONS["tile_labels"] = "SELECT * FROM tile_pairs WHERE visible >= 0.25e0"

_side = lambda k: lambda p: f"(((w[{(k + 1) % 4 + 1}].x - w[{k + 1}].x) * ({p}.y - w[{k + 1}].y) - (w[{(k + 1) % 4 + 1}].y - w[{k + 1}].y) * ({p}.x - w[{k + 1}].x)) * turn)"
_meet = f"""
    SELECT t.source_id, t.ann_id truth_id, pred_id, label, conf, tp, w, CASE WHEN {signed_area('w')} < 0 THEN -1e0 ELSE 1e0 END turn
    FROM (SELECT source_id, ann_id, {quad()} tp, {BOX} FROM truth) t
    JOIN (SELECT source_id, pred_id, label, conf, {quad()} w, {BOX} FROM predictions) p ON t.source_id = p.source_id
     AND t.bx0 <= p.bx1 AND p.bx0 <= t.bx1 AND t.by0 <= p.by1 AND p.by0 <= t.by1"""
_common = f"SELECT source_id, truth_id, pred_id, label, conf, {area('p4')} i, {area('tp')} + {area('w')} s FROM ({clipped(_meet, 'tp', [(_side(k), '0e0', '>=') for k in range(4)])}) c"
DEFINITIONS["candidates"] = f"SELECT source_id, truth_id, pred_id, label, conf, CASE WHEN s - i > 0 THEN least(1e0, i / (s - i)) ELSE 0e0 END iou FROM ({_common}) d"


def greedy(keys: str, name: str, source: str = "candidates", least: str = "0.5e0") -> None:
    """Defines the matches of each group of `keys` by recursion over its truths in order."""
    on = " AND ".join(f"o.{k} = r.{k}" for k in keys.split(", "))
    of = ", ".join(f"o.{k}" for k in keys.split(", "))
    DEFINITIONS[f"{name}_turns"] = f"""
        SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY truth_id) k FROM
        (SELECT {keys}, truth_id, list({{'iou': iou, 'pid': pred_id}} ORDER BY iou DESC, pred_id) cands FROM {source} WHERE iou >= {least} GROUP BY {keys}, truth_id) g"""
    DEFINITIONS[f"{name}_steps"] = f"""
        SELECT {keys}, CAST(0 AS BIGINT) k, CAST(NULL AS STRING) truth_id, CAST(NULL AS STRUCT(iou DOUBLE, pid STRING)) pick, CAST([] AS STRING[]) used FROM {name}_turns WHERE k = 1
        UNION ALL
        SELECT {of}, o.k, o.truth_id, list_filter(o.cands, lambda v: NOT list_contains(r.used, v.pid))[1],
               list_append(r.used, list_filter(o.cands, lambda v: NOT list_contains(r.used, v.pid))[1].pid)
        FROM {name}_steps r JOIN {name}_turns o ON {on} AND o.k = r.k + 1"""
    DEFINITIONS[name] = f"SELECT {keys}, truth_id, pick.pid pred_id, pick.iou iou FROM {name}_steps WHERE pick IS NOT NULL"


greedy("source_id", "matched")
greedy("source_id, label", "matched_by_label")
#: Truths whose corners are written crosswise, for the matching of invalid polygons.
DEFINITIONS["candidates_valid"] = "SELECT c.source_id, c.truth_id, c.pred_id, c.iou FROM candidates c JOIN (SELECT ann_id FROM truth WHERE l_partkey%10 <> 3) v ON c.truth_id = v.ann_id"
greedy("source_id", "matched_valid", "candidates_valid")

#: The same truths repaired: a rectangle written crosswise encloses two triangles, which meet in its middle.
_mid = "{'x': (t.x0+t.x2)/2, 'y': (t.y0+t.y2)/2}"
_corner = lambda k: f"{{'x': t.x{k}, 'y': t.y{k}}}"
_triangles = " UNION ALL ".join(f"SELECT *, [{_corner(i)}, {_corner(j)}, {_mid}] tp FROM truth t WHERE l_partkey%10 = 3" for i, j in ((0, 3), (1, 2)))
_meet_triangle = f"""
    SELECT t.source_id, t.ann_id truth_id, pred_id, tp, w, full_area, CASE WHEN {signed_area('w')} < 0 THEN -1e0 ELSE 1e0 END turn
    FROM (SELECT source_id, ann_id, tp, {area(quad())}/2 full_area, {BOX} FROM ({_triangles}) z) t
    JOIN (SELECT source_id, pred_id, {quad()} w, {BOX} FROM predictions) p ON t.source_id = p.source_id
     AND t.bx0 <= p.bx1 AND p.bx0 <= t.bx1 AND t.by0 <= p.by1 AND p.by0 <= t.by1"""
_common_triangle = f"SELECT source_id, truth_id, pred_id, {area('p4')} i, full_area + {area('w')} s FROM ({clipped(_meet_triangle, 'tp', [(_side(k), '0e0', '>=') for k in range(4)])}) c"
DEFINITIONS["candidates_repaired"] = f"""
    SELECT source_id, truth_id, pred_id, iou FROM candidates_valid UNION ALL
    SELECT source_id, truth_id, pred_id, CASE WHEN max(s) - sum(i) > 0 THEN least(1e0, sum(i) / (max(s) - sum(i))) ELSE 0e0 END FROM ({_common_triangle}) d GROUP BY 1, 2, 3"""
greedy("source_id", "matched_repaired", "candidates_repaired", "0.3e0")

#: Candidates of one class, and predictions in falling confidence choosing truths at ten thresholds.
DEFINITIONS["ious"] = "SELECT (50+5*k)/100e0 t FROM (SELECT unnest(range(10)) k) g"
DEFINITIONS["same_class"] = "SELECT c.source_id, c.label, c.conf, c.truth_id, c.pred_id, c.iou FROM candidates c JOIN truth t ON c.truth_id = t.ann_id AND c.source_id = t.source_id WHERE c.label = concat('prompt_', CAST(t.l_linenumber%3 AS STRING)) AND c.iou >= 0.5e0"
DEFINITIONS["confident_turns"] = """
        SELECT *, row_number() OVER (PARTITION BY source_id, label, t ORDER BY conf DESC, pred_id) k FROM
        (SELECT source_id, label, t, conf, pred_id, list({'iou': iou, 'tid': truth_id} ORDER BY iou DESC, truth_id) cands FROM same_class JOIN ious ON iou >= t GROUP BY ALL) g"""
DEFINITIONS["confident_steps"] = """
        SELECT source_id, label, t, CAST(0 AS BIGINT) k, CAST(NULL AS STRING) pred_id, CAST(NULL AS STRUCT(iou DOUBLE, tid STRING)) pick, CAST([] AS STRING[]) used FROM confident_turns WHERE k = 1
        UNION ALL
        SELECT o.source_id, o.label, o.t, o.k, o.pred_id, list_filter(o.cands, lambda v: NOT list_contains(r.used, v.tid))[1],
               list_append(r.used, list_filter(o.cands, lambda v: NOT list_contains(r.used, v.tid))[1].tid)
        FROM confident_steps r JOIN confident_turns o ON o.source_id = r.source_id AND o.label = r.label AND o.t = r.t AND o.k = r.k + 1"""
DEFINITIONS["confident"] = "SELECT source_id, label, t, pred_id FROM confident_steps WHERE pick IS NOT NULL"
DEFINITIONS["ap_steps"] = """
        SELECT label, t, sum(n) OVER w n, sum(h) OVER w h FROM (
          SELECT p.label, g.t, p.conf, count(*) n, count(m.pred_id) h FROM predictions p CROSS JOIN ious g
          LEFT JOIN confident m ON m.source_id = p.source_id AND m.label = p.label AND m.t = g.t AND m.pred_id = p.pred_id GROUP BY 1, 2, 3) a WINDOW w AS (PARTITION BY label, t ORDER BY conf DESC)"""
DEFINITIONS["ap"] = """
        SELECT label, t, sum(coalesce(best, 0e0))/101 ap FROM (
          SELECT s.label, g.t, r.k, (SELECT max(h/CAST(n AS DOUBLE)) FROM ap_steps a WHERE a.label = s.label AND a.t = g.t AND 100*a.h >= r.k*s.total) best
          FROM (SELECT concat('prompt_', CAST(l_linenumber%3 AS STRING)) label, count(*) total FROM truth GROUP BY 1) s CROSS JOIN ious g CROSS JOIN (SELECT unnest(range(101)) k) r) b GROUP BY 1, 2"""
