"""SQL of the level-wise search for DuckDB, unrolled to a fixed length.

The last level carries a guard: a node that could still be extended raises an
error, so that a search cut short can't pass unseen.
"""

from __future__ import annotations


def pos_sql(raw: str) -> str:
    return f"""raw0 AS ({raw}),
raw AS (SELECT sid, tid, item, CAST(sum(util) AS BIGINT) AS util FROM raw0 WHERE util > 0 GROUP BY 1, 2, 3),
pos AS (SELECT *, su - pre - util AS rem FROM (
  SELECT sid, tid, item, util, CAST(row_number() OVER w - 1 AS INT) AS k,
    CAST(coalesce(sum(util) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pre,
    CAST(sum(util) OVER (PARTITION BY sid) AS BIGINT) AS su
  FROM raw WINDOW w AS (PARTITION BY sid ORDER BY tid, item))),
swu AS (SELECT item, CAST(sum(su) AS BIGINT) AS swu FROM (SELECT DISTINCT sid, item, su FROM pos) GROUP BY 1)"""


def mine_sql(lmax: int, theta: str = "(SELECT CAST({xi} AS DOUBLE) * sum(util) FROM pos)", xi: float | None = None, suffix: str = "", pos: str = "pos", swu: str = "swu") -> str:
    """CTEs t{s}(theta), f{L}, n{L} and nodes{s}(pat, len, u, bound, support)."""
    s = suffix
    out = [f"t{s} AS (SELECT {theta.format(xi=xi)} AS theta)"]
    for level in range(1, lmax + 1):
        if level == 1:
            out.append(f"f{s}1 AS MATERIALIZED (SELECT CAST(item AS VARCHAR) AS pat, sid, tid, k, util AS iu, rem FROM {pos} JOIN {swu} USING (item), t{s} WHERE swu >= theta)")
        else:
            p = level - 1
            out.append(
                f"g{s}{level} AS MATERIALIZED (SELECT pat, sid, tid, k, iu FROM f{s}{p} SEMI JOIN (SELECT pat FROM n{s}{p}, t{s} WHERE bound >= theta * {level}) USING (pat)),\n"
                f"x{s}{level} AS (SELECT sid, tid, k, item, util, rem FROM {pos} JOIN {swu} USING (item), t{s} WHERE swu >= theta * {level}),\n"
                f"f{s}{level} AS MATERIALIZED (SELECT g.pat || (CASE WHEN x.tid = g.tid THEN ',' ELSE ')(' END) || CAST(x.item AS VARCHAR) AS pat, x.sid, x.tid, x.k, max(g.iu) + any_value(x.util) AS iu, any_value(x.rem) AS rem"
                f" FROM g{s}{level} g JOIN x{s}{level} x ON g.sid = x.sid AND x.k > g.k GROUP BY g.pat, (x.tid = g.tid), x.item, x.sid, x.tid, x.k)"
            )
        out.append(
            f"n{s}{level} AS MATERIALIZED (SELECT pat, CAST({level} AS INT) AS len, CAST(sum(iu) AS BIGINT) AS u, CAST(sum(reach) AS BIGINT) AS bound, count(*) AS support"
            f" FROM (SELECT pat, sid, max(iu) AS iu, max(iu + rem) AS reach FROM f{s}{level} GROUP BY 1, 2) GROUP BY 1)"
        )
    guard = f"(SELECT CASE WHEN count(*) > 0 THEN error('level {lmax} is not the last') ELSE 0 END FROM n{s}{lmax}, t{s} WHERE bound >= theta * {lmax + 1})"
    union = " UNION ALL ".join(f"SELECT pat, len, u, bound, support FROM n{s}{level}" for level in range(1, lmax + 1))
    out.append(f"nodes{s} AS (SELECT * FROM ({union}) WHERE coalesce({guard}, 0) = 0)")
    return ",\n".join(out)


def hausp_sql(suffix: str = "") -> str:
    return f"SELECT '<(' || pat || ')>' AS pattern, len, u AS utility, CAST(u AS DOUBLE) / len AS avg_utility, support FROM nodes{suffix}, t{suffix} WHERE u >= theta * len"
