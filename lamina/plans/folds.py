"""SQL for operators that decide one thing after the other, as recursive queries.

A fold carries its state in lists: one row a group and step. Matchings are found by
trying every one-to-one choice of a block, which is small since pairs overlap.
"""

from __future__ import annotations

from lamina.plans import fixture as S


def boxes_fold(source: str, threshold: float) -> str:
    """CTEs up to ``kept(volume, z, ord, y0, x0, y1, x1)``: first-come suppression of ``source``."""
    box = "{'ord': c.ord, 'y0': c.y0, 'x0': c.x0, 'y1': c.y1, 'x1': c.x1}"
    inter = "(greatest(0, least(b.y1, c.y1) - greatest(b.y0, c.y0)) * greatest(0, least(b.x1, c.x1) - greatest(b.x0, c.x0)))::DOUBLE"
    union = f"((b.y1 - b.y0) * (b.x1 - b.x0) + (c.y1 - c.y0) * (c.x1 - c.x0) - {inter} + 1e-9)"
    return f"""
turn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY volume, z ORDER BY ord) AS k FROM {source}),
fold AS (
  SELECT volume, z, k, [{box}] AS held FROM turn c WHERE k = 1
  UNION ALL
  SELECT f.volume, f.z, c.k, CASE WHEN len(list_filter(held, lambda b: {inter} / {union} >= {threshold})) > 0 THEN held ELSE list_append(held, {box}) END
  FROM fold f JOIN turn c ON c.volume = f.volume AND c.z = f.z AND c.k = f.k + 1),
kept AS (SELECT volume, z, unnest(held, recursive := true) FROM fold WHERE (volume, z, k) IN (SELECT (volume, z, max(k)) FROM turn GROUP BY volume, z))"""


def mask_boxes(name: str, later: int, earlier: tuple[int, ...], min_area: int, base: int) -> str:
    """CTEs up to ``name``: boxes of the regions of places on z + later that are on none of z + e."""
    tests = " ".join(f"AND NOT EXISTS (SELECT 1 FROM mask e WHERE e.volume = m.volume AND e.z = m.z - {later} + {e} AND e.y = m.y AND e.x = m.x)" for e in earlier)
    n = name
    return f"""
{n}_at AS MATERIALIZED (SELECT m.volume, m.z - {later} AS z, y, x, 1 AS id FROM mask m JOIN depth USING (volume) WHERE m.z - {later} BETWEEN 0 AND last {tests}),
{S.runs_sql(f"{n}_run", f"{n}_at")},
{n}_num AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY volume, z, y, x0) AS r FROM {n}_run),
{n}_touch AS MATERIALIZED (SELECT a.r AS p, b.r AS q FROM {n}_num a JOIN {n}_num b ON a.volume = b.volume AND a.z = b.z AND b.y = a.y + 1 AND a.x0 < b.x1 AND b.x0 < a.x1),
{n}_step AS (SELECT p, q FROM {n}_touch UNION ALL SELECT q, p FROM {n}_touch),
{n}_reach AS (SELECT r AS node, r AS seen FROM {n}_num UNION SELECT w.node, s.q FROM {n}_reach w JOIN {n}_step s ON s.p = w.seen),
{n}_comp AS (SELECT volume, z, y, x0, x1, dense_rank() OVER (PARTITION BY volume, z ORDER BY root) AS c FROM {n}_num JOIN (SELECT node, min(seen) AS root FROM {n}_reach GROUP BY node) ON node = r),
{n} AS (SELECT volume, z, c + {base} AS ord, min(y) AS y0, min(x0) AS x0, max(y) + 1 AS y1, max(x1) AS x1 FROM {n}_comp GROUP BY volume, z, c HAVING sum(x1 - x0) >= {min_area})"""


MASK = """
mask AS MATERIALIZED (SELECT DISTINCT volume, z, y, x FROM pred),
depth AS (SELECT volume, max(z) - 3 AS last FROM pred GROUP BY volume)"""


def missing(min_area: int, threshold: float) -> list[str]:
    step = 1 << 32
    parts = [mask_boxes("third", 2, (1,), min_area, 0), mask_boxes("fourth", 3, (1,), min_area, step), mask_boxes("late", 3, (2, 1), min_area, 2 * step)]
    return [MASK, *parts, "every AS (SELECT * FROM third UNION ALL SELECT * FROM fourth UNION ALL SELECT * FROM late)", boxes_fold("every", threshold)]


def matching(thresholds: list[float]) -> str:
    """CTEs up to ``best(volume, b, th, n, total, chosen)``: the matching of greatest total IoU of each block."""
    listed = ", ".join(map(str, thresholds))
    return f"""
th AS (SELECT unnest([{listed}])::DOUBLE AS th),
ok AS MATERIALIZED (SELECT volume, gt_id, pred_id, iou::FLOAT::DOUBLE AS w FROM pair WHERE iou::FLOAT::DOUBLE >= {min(thresholds)}::DOUBLE),
adj AS MATERIALIZED (SELECT DISTINCT a.volume, a.gt_id AS p, b.gt_id AS q FROM ok a JOIN ok b ON a.volume = b.volume AND a.pred_id = b.pred_id),
near AS (SELECT DISTINCT volume, gt_id AS node, gt_id AS seen FROM ok UNION SELECT n.volume, n.node, a.q FROM near n JOIN adj a ON a.volume = n.volume AND a.p = n.seen),
block AS (SELECT volume, node AS gt_id, min(seen) AS b FROM near GROUP BY ALL),
turn AS MATERIALIZED (SELECT volume, b, gt_id, row_number() OVER (PARTITION BY volume, b ORDER BY gt_id) AS k FROM block),
choice AS MATERIALIZED (SELECT t.volume, t.b, t.k, o.gt_id, o.pred_id, o.w FROM turn t JOIN ok o USING (volume, gt_id) UNION ALL SELECT volume, b, k, gt_id, NULL, 0 FROM turn),
search AS (
  SELECT DISTINCT volume, b, th, 0::BIGINT AS k, []::BIGINT[] AS used, []::BIGINT[] AS chosen, 0::DOUBLE AS total, 0::BIGINT AS n FROM turn, th
  UNION ALL
  SELECT s.volume, s.b, s.th, c.k, CASE WHEN c.pred_id IS NULL THEN used ELSE list_append(used, c.pred_id) END, CASE WHEN c.pred_id IS NULL THEN chosen ELSE list_append(chosen, c.gt_id) END,
         total + c.w, n + CASE WHEN c.pred_id IS NULL THEN 0 ELSE 1 END
  FROM search s JOIN choice c ON c.volume = s.volume AND c.b = s.b AND c.k = s.k + 1 WHERE c.pred_id IS NULL OR (c.w >= s.th AND NOT list_contains(used, c.pred_id))),
whole AS (SELECT * FROM search WHERE (volume, b, k) IN (SELECT (volume, b, max(k)) FROM turn GROUP BY volume, b)),
best AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY volume, b, th ORDER BY total DESC) AS place FROM whole) WHERE place = 1)"""


GREEDY = """
cand AS MATERIALIZED (
  SELECT e.*, row_number() OVER (PARTITION BY e.volume, e.z ORDER BY IoU DESC, c_src, c_tgt) AS k FROM edge2 e
  JOIN fwd f ON f.volume = e.volume AND f.z = e.z AND f.c = c_src JOIN bwd g ON g.volume = e.volume AND g.z = e.z + 2 AND g.c = c_tgt
  WHERE IoU >= 0.3 AND d_centroid <= 8 AND area_ratio >= 0.3),
walked AS (
  SELECT volume, z, k, [c_src] AS src, [c_tgt] AS tgt, true AS good FROM cand WHERE k = 1
  UNION ALL
  SELECT w.volume, w.z, c.k, CASE WHEN list_contains(src, c_src) OR list_contains(tgt, c_tgt) THEN src ELSE list_append(src, c_src) END,
         CASE WHEN list_contains(src, c_src) OR list_contains(tgt, c_tgt) THEN tgt ELSE list_append(tgt, c_tgt) END, NOT (list_contains(src, c_src) OR list_contains(tgt, c_tgt))
  FROM walked w JOIN cand c ON c.volume = w.volume AND c.z = w.z AND c.k = w.k + 1),
bridge AS MATERIALIZED (
  SELECT c.volume, a.track AS p, b.track AS q FROM cand c JOIN walked w ON w.volume = c.volume AND w.z = c.z AND w.k = c.k AND w.good
  JOIN track a ON a.volume = c.volume AND a.gid = c.gid_src JOIN track b ON b.volume = c.volume AND b.gid = c.gid_tgt WHERE a.track <> b.track),
both_ways AS (SELECT volume, p, q FROM bridge UNION ALL SELECT volume, q, p FROM bridge),
merged AS (SELECT DISTINCT volume, p AS node, p AS seen FROM both_ways UNION SELECT m.volume, m.node, b.q FROM merged m JOIN both_ways b ON b.volume = m.volume AND b.p = m.seen),
final AS (SELECT volume, node AS track, min(seen) AS upto FROM merged GROUP BY ALL)"""

FILLED = """
big AS MATERIALIZED (SELECT volume, z, y, x0, x1, id FROM comp WHERE (volume, z, c) IN (SELECT (volume, z, c) FROM comp GROUP BY volume, z, c HAVING sum(x1 - x0) >= 5)),
span AS (SELECT volume, z, id, min(y) - 1 AS ya, max(y) + 1 AS yb, min(x0) - 1 AS xa, max(x1) + 1 AS xb FROM big GROUP BY ALL),
scan AS (SELECT volume, z, id, unnest(range(ya, yb + 1)) AS y, xa, xb, ya FROM span),
stop AS (
  SELECT volume, z, id, y, xa AS s, xa AS e FROM scan UNION ALL SELECT volume, z, id, y, xb, xb FROM scan UNION ALL SELECT volume, z, id, y, x0, x1 FROM big),
free AS (
  SELECT volume, z, id, y, e AS x0, lead(s) OVER (PARTITION BY volume, z, id, y ORDER BY s, e) AS x1 FROM stop),
gap AS MATERIALIZED (SELECT *, row_number() OVER () AS r FROM free WHERE x1 > x0),
close AS MATERIALIZED (SELECT a.r AS p, b.r AS q FROM gap a JOIN gap b ON a.volume = b.volume AND a.z = b.z AND a.id = b.id AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1),
open AS (
  SELECT r FROM gap JOIN span USING (volume, z, id) WHERE y = ya
  UNION
  SELECT q FROM open JOIN close ON p = r),
filled AS (
  SELECT volume, z, y, x, max(id) AS id FROM (
    SELECT volume, z, y, id, unnest(range(x0, x1)) AS x FROM big
    UNION ALL
    SELECT volume, z, y, id, unnest(range(x0, x1)) AS x FROM gap WHERE r NOT IN (SELECT r FROM open)) GROUP BY ALL)"""

GROWN = """
bound AS (SELECT volume, id, min(y) AS ya, max(y) AS yb, min(x) AS xa, max(x) AS xb FROM pred GROUP BY ALL),
seat AS (SELECT DISTINCT volume, id, z FROM pred),
sure AS MATERIALIZED (
  SELECT p.volume, p.z, p.y, p.x, s.id FROM prob p JOIN seat s ON s.volume = p.volume AND s.z = p.z JOIN bound b ON b.volume = p.volume AND b.id = s.id
  WHERE p.p > 0.5 AND p.y BETWEEN ya AND yb AND p.x BETWEEN xa AND xb),
side AS (SELECT * FROM (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) AS s(dy, dx)),
grown AS (
  SELECT s.volume, s.z, s.y, s.x, s.id FROM sure s JOIN pred p USING (volume, z, y, x, id)
  UNION
  SELECT s.volume, s.z, s.y, s.x, s.id FROM grown g, side d JOIN sure s ON s.volume = g.volume AND s.z = g.z AND s.id = g.id AND s.y = g.y + d.dy AND s.x = g.x + d.dx),
refined AS (SELECT volume, z, y, x, max(id) AS id FROM (SELECT volume, z, y, x, id FROM pred UNION ALL SELECT volume, z, y, x, id FROM grown) GROUP BY ALL)"""
