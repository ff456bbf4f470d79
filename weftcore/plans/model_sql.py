"""DuckDB SQL of model fits and importance trees, as chains of common table expressions.

Every chain starts from tables that the caller defines and ends in named
tables.  Steps are written out one by one and materialised.
"""

from __future__ import annotations

from weftcore.functions.hashing import uniform_sql


def lloyd(points: str, cells: str, start: str, steps: int) -> str:
    """Tables ``c0 .. c<steps>`` (c, j, m) of centres and ``model_cost``.

    ``points`` (pid, w), ``cells`` (pid, j, x; zeros may be missing), ``start``
    (c, j, m).  Ties go to the smaller c; a centre without points stays."""
    parts = [f"xn AS MATERIALIZED (SELECT p.pid, p.w, coalesce(sum(q.x * q.x), 0) AS xx FROM {points} p LEFT JOIN {cells} q USING (pid) GROUP BY p.pid, p.w)",
             f"c0 AS MATERIALIZED (SELECT c, j, m FROM {start})", f"ks AS MATERIALIZED (SELECT DISTINCT c FROM {start})"]

    def distances(t: int) -> list[str]:
        return [f"n{t} AS MATERIALIZED (SELECT ks.c, coalesce(sum(m * m), 0) AS cc FROM ks LEFT JOIN c{t} USING (c) GROUP BY ks.c)",
                f"dot{t} AS MATERIALIZED (SELECT q.pid, k.c, sum(q.x * k.m) AS xc FROM {cells} q JOIN c{t} k USING (j) GROUP BY q.pid, k.c)",
                f"near{t} AS MATERIALIZED (SELECT xn.pid, xn.w, arg_min(n.c, (xn.xx - 2 * coalesce(d.xc, 0) + n.cc, n.c)) AS c, "
                f"greatest(min(xn.xx - 2 * coalesce(d.xc, 0) + n.cc), 0) AS d2 "
                f"FROM xn CROSS JOIN n{t} n LEFT JOIN dot{t} d ON d.pid = xn.pid AND d.c = n.c GROUP BY xn.pid, xn.w)"]

    for t in range(steps):
        parts += distances(t)
        parts += [f"wt{t} AS MATERIALIZED (SELECT c, sum(w) AS w FROM near{t} GROUP BY c)",
                  f"c{t + 1} AS MATERIALIZED (SELECT a.c, q.j, sum(a.w * q.x) / any_value(wt.w) AS m FROM near{t} a JOIN {cells} q USING (pid) JOIN wt{t} wt USING (c) GROUP BY a.c, q.j "
                  f"UNION ALL SELECT c, j, m FROM c{t} WHERE c NOT IN (SELECT c FROM wt{t}))"]
    parts += distances(steps)
    parts.append(f"model_cost AS (SELECT sum(w * d2) AS cost FROM near{steps})")
    return ",\n".join(parts)


def projectors(gram: str, k: int, squarings: int = 14) -> str:
    """Tables ``proj<c>`` (i, j, v): the projector on the c-th eigenvector of the
    symmetric matrix ``gram`` (i, j, v), c from 0, and ``val<c>`` (e): its
    eigenvalue.  A matrix squared again and again, its trace kept at one, is
    the projector on its largest eigenvector; the next one is found in the
    matrix without it."""
    parts = [f"g0 AS MATERIALIZED (SELECT i, j, v FROM {gram})"]
    for c in range(k):
        parts.append(f"p{c}_0 AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM g{c} WHERE i = j) AS v FROM g{c})")
        for t in range(squarings):
            parts.append(f"s{c}_{t} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM p{c}_{t} a JOIN p{c}_{t} b ON a.j = b.i GROUP BY a.i, b.j)")
            parts.append(f"p{c}_{t + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM s{c}_{t} WHERE i = j) AS v FROM s{c}_{t})")
        parts.append(f"proj{c} AS MATERIALIZED (SELECT i, j, v FROM p{c}_{squarings})")
        parts.append(f"val{c} AS MATERIALIZED (SELECT sum(g.v * p.v) AS e FROM g{c} g JOIN proj{c} p USING (i, j))")
        parts.append(f"g{c + 1} AS MATERIALIZED (SELECT g.i, g.j, g.v - val{c}.e * p.v AS v FROM g{c} g JOIN proj{c} p USING (i, j), val{c})")
    return ",\n".join(parts)


def tree(points: str, importance, leaves: int, fan: int, s: int, seed: int, rounds: int = 8) -> str:
    """Table ``tree_sample`` (pid, weight): the merge-and-reduce tree of a
    priority sampler over ``points`` (pid), unit weights, leaves pid mod
    ``leaves``; ``importance(table, name)`` gives CTEs that end in a table
    ``name`` (level, node, pid, v) from ``table`` (level, node, pid, w)."""
    T = fan * s
    parts = [f"t_leaf AS MATERIALIZED (SELECT -1 AS level, pid % {leaves} AS node, pid, CAST(1 AS DOUBLE) AS w FROM {points})"]

    def step(src: str, dst: str, salt: int, final: bool = False) -> None:
        at = seed + 1_000_003 * salt
        big = f"n > {s}" if final else f"n >= {T}"
        parts.append(f"{dst}_n AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY level, node) AS n FROM {src})")
        parts.append(f"{dst}_big AS MATERIALIZED (SELECT level, node, pid, w FROM {dst}_n WHERE {big})")
        parts.append(importance(f"{dst}_big", f"{dst}_v"))
        parts.append(f"{dst}_r AS MATERIALIZED (SELECT b.*, v.v, v.v / {uniform_sql('b.pid', at)} AS r FROM {dst}_big b JOIN {dst}_v v USING (level, node, pid))")
        parts.append(f"{dst}_top AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY level, node ORDER BY r DESC, pid) AS rn FROM {dst}_r)")
        parts.append(f"{dst}_tau AS MATERIALIZED (SELECT *, max(CASE WHEN rn = {s + 1} THEN r END) OVER (PARTITION BY level, node) AS tau FROM {dst}_top)")
        parts.append(f"{dst} AS MATERIALIZED (SELECT level + 1 AS level, node // {fan} AS node, pid, CASE WHEN tau IS NULL OR v >= tau THEN w ELSE w * tau / v END AS w "
                     f"FROM {dst}_tau WHERE rn <= {s} UNION ALL SELECT {'level, node' if src != 't_leaf' else f'0, node // {fan}'}, pid, w FROM {dst}_n WHERE NOT ({big}))")

    step("t_leaf", "t0", 0)
    for r in range(1, rounds + 1):
        step(f"t{r - 1}", f"t{r}", r)
    parts.append(f"t_all AS MATERIALIZED (SELECT 0 AS level, 0 AS node, pid, w FROM t{rounds})")
    step("t_all", "t_end", 10_000, final=True)
    parts.append("tree_sample AS (SELECT pid, w AS weight FROM t_end)")
    return ",\n".join(parts)


def light(cells: str):
    """Importance of the light sampler from ``cells`` (pid, j, x), dense."""
    def ctes(src: str, out: str) -> str:
        return f"""{out}_w AS MATERIALIZED (SELECT level, node, sum(w) AS W FROM {src} GROUP BY level, node),
{out}_mu AS MATERIALIZED (SELECT s.level, s.node, q.j, sum(s.w * q.x) / any_value(g.W) AS m FROM {src} s JOIN {cells} q USING (pid) JOIN {out}_w g ON g.level = s.level AND g.node = s.node GROUP BY s.level, s.node, q.j),
{out}_d AS MATERIALIZED (SELECT s.level, s.node, s.pid, any_value(s.w) AS w, sum((q.x - mu.m) * (q.x - mu.m)) AS d2 FROM {src} s JOIN {cells} q USING (pid) JOIN {out}_mu mu ON mu.level = s.level AND mu.node = s.node AND mu.j = q.j GROUP BY s.level, s.node, s.pid),
{out}_c AS MATERIALIZED (SELECT level, node, sum(w * d2) AS C FROM {out}_d GROUP BY level, node),
{out} AS MATERIALIZED (SELECT d.level, d.node, d.pid, CASE WHEN c.C > 0 THEN d.w * (0.5 / g.W + 0.5 * d.d2 / c.C) ELSE d.w / g.W END AS v
  FROM {out}_d d JOIN {out}_w g ON g.level = d.level AND g.node = d.node JOIN {out}_c c ON c.level = d.level AND c.node = d.node)"""
    return ctes


def sensitivity(near: str, k: str):
    """Importance of the sensitivity sampler from ``near`` (pid, b, d2) and the
    number of rough centres ``k`` (an expression)."""
    def ctes(src: str, out: str) -> str:
        return f"""{out}_x AS MATERIALIZED (SELECT s.level, s.node, s.pid, s.w, n.b, n.d2 FROM {src} s JOIN {near} n USING (pid)),
{out}_g AS MATERIALIZED (SELECT level, node, sum(w) AS W, sum(w * d2) AS S, 16.0 * (ln({k}) + 2.0) AS a FROM {out}_x GROUP BY level, node),
{out}_b AS MATERIALIZED (SELECT level, node, b, sum(w) AS wb, sum(w * d2) AS cb FROM {out}_x GROUP BY level, node, b),
{out} AS MATERIALIZED (SELECT x.level, x.node, x.pid, CASE WHEN g.S > 0 THEN x.w * (g.a * x.d2 / (g.S / g.W) + 2 * g.a * q.cb / (q.wb * (g.S / g.W)) + 4.0 * g.W / q.wb) ELSE x.w END AS v
  FROM {out}_x x JOIN {out}_g g ON g.level = x.level AND g.node = x.node JOIN {out}_b q ON q.level = x.level AND q.node = x.node AND q.b = x.b)"""
    return ctes
