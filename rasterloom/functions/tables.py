"""Table functions for SQL: spans and pixels of triangles, lines and quads, to be joined laterally with any table.

After register(spark), a query calls them for its rows, and what it does with each span, pixel or leaf is its own SQL:

    SELECT t.tri_id, p.x, p.y, p.z
    FROM triangles t, LATERAL triangle_spans(t.ax, t.ay, t.az, t.bx, t.by, t.bz, t.cx, t.cy, t.cz, 0, 64) s,
         LATERAL span_pixels(s.x1, s.x2, s.z1, s.z2, 0, 64) p
    WHERE s.x2 - s.x1 > 2

They are SQL themselves, so Catalyst plans them with the query and no row leaves the JVM. Their arguments may be null, which
gives no row.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

def _edge(p: str, q: str, a: str) -> str:
    """The value of an edge from p to q at row y."""
    return f"{p}.{a} + ({q}.{a} - {p}.{a}) / nullif({q}.y - {p}.y, 0.0D) * (y - {p}.y)"


def _whole(first: str, last: str) -> str:
    """All whole numbers from first to last, none if last is smaller."""
    return f"if({last} >= {first}, sequence({first}, {last}), array())"


_FIRST, _LAST = "cast(greatest(ceil({}), {}) AS INT)", "cast(least(ceil({}), {}) AS INT) - 1"

FUNCTIONS = {
    # rows from ceil(top) to below the bottom, within [ymin, ymax); x1 <= x2
    "triangle_spans": f"""(ax DOUBLE, ay DOUBLE, az DOUBLE, bx DOUBLE, by DOUBLE, bz DOUBLE, cx DOUBLE, cy DOUBLE, cz DOUBLE, ymin INT, ymax INT)
RETURNS TABLE (y INT, x1 DOUBLE, x2 DOUBLE, z1 DOUBLE, z2 DOUBLE)
RETURN SELECT y, if(e.xa >= e.xb, e.xb, e.xa), if(e.xa >= e.xb, e.xa, e.xb), if(e.xa >= e.xb, e.zb, e.za), if(e.xa >= e.xb, e.za, e.zb) FROM (
  SELECT y, struct(if(y < m.y, {_edge('t', 'm', 'x')}, {_edge('m', 'b', 'x')}) AS xa, {_edge('t', 'b', 'x')} AS xb, if(y < m.y, {_edge('t', 'm', 'z')}, {_edge('m', 'b', 'z')}) AS za, {_edge('t', 'b', 'z')} AS zb) AS e FROM (
    SELECT p[0] AS t, p[1] AS m, p[2] AS b, y FROM (
      SELECT array_sort(array(struct(ay AS y, 0 AS k, ax AS x, az AS z), struct(by AS y, 1 AS k, bx AS x, bz AS z), struct(cy AS y, 2 AS k, cx AS x, cz AS z))) AS p, ymin AS lo, ymax AS hi
    ), LATERAL explode({_whole(_FIRST.format('p[0].y', 'lo'), _LAST.format('p[2].y', 'hi'))}) AS r(y)))""",
    # pixels of a span, from ceil(x1) to below x2, within [xmin, xmax)
    "span_pixels": f"""(x1 DOUBLE, x2 DOUBLE, z1 DOUBLE, z2 DOUBLE, xmin INT, xmax INT)
RETURNS TABLE (x INT, z DOUBLE)
RETURN SELECT x, z1 + (z2 - z1) / (x2 - x1) * (x - x1) FROM explode({_whole(_FIRST.format('x1', 'xmin'), _LAST.format('x2', 'xmax'))}) AS r(x)""",
    # steps of a line of max(|dx|, |dy|) whole steps, rounded half away from zero
    "line_pixels": """(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)
RETURNS TABLE (step INT, x INT, y INT)
RETURN SELECT step, cast(round(x1 + step * coalesce((x2 - x1) / nullif(n, 0), 0)) AS INT), cast(round(y1 + step * coalesce((y2 - y1) / nullif(n, 0), 0)) AS INT)
FROM (SELECT cast(greatest(abs(x2 - x1), abs(y2 - y1)) AS INT) AS n), LATERAL explode(sequence(0, n)) AS r(step)""",
    # pixels of a quad, clipped to the image
    "quad_pixels": f"""(size BIGINT, qx BIGINT, qy BIGINT, width INT, height INT)
RETURNS TABLE (x INT, y INT)
RETURN SELECT cast(x AS INT), cast(y AS INT) FROM explode({_whole('qx * size', 'least(qx * size + size, width) - 1')}) AS a(x), explode({_whole('qy * size', 'least(qy * size + size, height) - 1')}) AS b(y)""",
    # the four quads within one, upper left, upper right, lower left, lower right; none of a pixel
    "quad_children": """(size BIGINT, qx BIGINT, qy BIGINT)
RETURNS TABLE (child INT, child_size BIGINT, child_qx BIGINT, child_qy BIGINT)
RETURN SELECT k, size div 2, 2 * qx + k % 2, 2 * qy + k div 2 FROM explode(if(size > 1, sequence(0, 3), array())) AS r(k)""",
}


def register(spark: SparkSession) -> None:
    """Make the functions known to the session, in place of earlier ones of their names."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} {body}")
