"""DuckDB SQL equal to each registered query (views: the driver tables).

Model fits are stated in full: Lloyd steps from given centres, eigenvectors by
repeated squaring, importance trees level by level (:mod:`.model_sql`).
"""

from __future__ import annotations

from weftcore.functions.hashing import uniform_sql
from weftcore.plans import model_sql as sql
from weftcore.plans.registered import (CHUNK_FAN, CHUNK_LEAVES, CHUNK_MAX, CHUNK_MIN, CHUNK_S,
                                       KMEANS_K, KMEANS_SAMPLE, KMEANS_STEPS,
                                       LINEITEM_FEATURES_SQL, LINEITEM_PID_SQL, PROG_BATCHES,
                                       PROJ_AXES, SEED, SPARSE_K, SPARSE_SAMPLE, SPARSE_STEPS, STREAM_FILES, STREAM_LEAVES, STREAM_S, STREAM_KMEANS_DECAY,
                                       STREAM_KMEANS_WEIGHT, TERM_BUCKETS,
                                       TREE_LIGHT_FAN, TREE_LIGHT_LEAVES, TREE_LIGHT_S,
                                       TREE_SENS_LEAVES, TREE_SENS_S,
                                       TREE_SYS_FAN, TREE_SYS_LEAVES, TREE_SYS_S)


def _u(pid: str) -> str:
    return uniform_sql(pid, SEED)


def _li_points() -> str:
    f = LINEITEM_FEATURES_SQL
    return (f"SELECT {LINEITEM_PID_SQL} AS pid, CAST({f[0]} AS DOUBLE) AS a, "
            f"CAST({f[1]} AS DOUBLE) AS b, CAST({f[2]} AS DOUBLE) AS c, "
            f"CAST({f[3]} AS DOUBLE) AS d FROM lineitem")


def _priority(points_cte: str, v_expr: str, s: int) -> str:
    """Priority sample of s rows from a CTE with (pid, v); unit input weights."""
    return f"""
WITH {points_cte},
r AS (SELECT pid, v, v / {_u('pid')} AS r FROM v),
top AS (SELECT pid, v, r, row_number() OVER (ORDER BY r DESC, pid) AS rn FROM r),
tau AS (SELECT max(CASE WHEN rn = {s + 1} THEN r END) AS tau FROM top)
SELECT pid, round(CASE WHEN tau IS NULL OR v >= tau THEN 1.0 ELSE tau / v END, 6) AS weight
FROM top, tau WHERE rn <= {s}"""


EMB = "e AS (SELECT vec_id AS pid, label, CAST(embedding AS DOUBLE[]) AS f FROM embeddings)"
POS = "pos AS (SELECT pid, label, UNNEST(range(len(f))) AS j, UNNEST(f) AS x FROM e)"
LABEL_DIST = f"""{EMB}, {POS},
lab AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS c
        FROM (SELECT DISTINCT label FROM e)),
cent AS (SELECT lab.c, pos.j, avg(pos.x) AS m FROM pos JOIN lab USING (label) GROUP BY lab.c, pos.j),
dist AS (SELECT pos.pid, cent.c, sum((pos.x - cent.m) * (pos.x - cent.m)) AS d2
         FROM pos JOIN cent USING (j) GROUP BY pos.pid, cent.c)"""


def _tree_forest_sql() -> str:
    T, s, fan, L = TREE_SYS_FAN * TREE_SYS_S, TREE_SYS_S, TREE_SYS_FAN, TREE_SYS_LEAVES
    keep = f"(n < {T} OR n <= {s} OR (rn - 1) % (n // {s}) = 0)"
    parts = [
        f"p AS (SELECT o_orderkey AS pid, o_orderkey % {L} AS leaf FROM orders)",
        "l AS (SELECT pid, leaf, count(*) OVER (PARTITION BY leaf) AS n, "
        "row_number() OVER (PARTITION BY leaf ORDER BY pid) AS rn FROM p)",
        f"t0 AS (SELECT 0 AS level, leaf // {fan} AS node, pid FROM l WHERE {keep})",
    ]
    rounds = 8
    for i in range(1, rounds + 1):
        parts.append(
            f"r{i} AS (SELECT level, node, pid, count(*) OVER (PARTITION BY level, node) AS n, "
            f"row_number() OVER (PARTITION BY level, node ORDER BY pid) AS rn FROM t{i - 1})")
        parts.append(
            f"t{i} AS (SELECT CASE WHEN n >= {T} THEN level + 1 ELSE level END AS level, "
            f"CASE WHEN n >= {T} THEN node // {fan} ELSE node END AS node, pid "
            f"FROM r{i} WHERE {keep})")
    return ("WITH " + ",\n".join(parts) +
            f"\nSELECT CAST(level AS BIGINT) AS level, CAST(node AS BIGINT) AS node, pid, 1.0::DOUBLE AS weight FROM t{rounds}")


def _chunked_tree_sql() -> str:
    s, lo, hi, fan = CHUNK_S, CHUNK_MIN, CHUNK_MAX, CHUNK_FAN
    parts = [f"t0 AS (SELECT 0 AS level, o_orderkey % {CHUNK_LEAVES} AS node, o_orderkey AS pid, "
             f"{_u('o_orderkey')} AS u, CAST(1 AS DOUBLE) AS w FROM orders)"]
    rounds = 10
    for i in range(1, rounds + 1):
        parts.append(
            f"a{i} AS (SELECT *, count(*) OVER (PARTITION BY level, node) AS n, "
            f"(row_number() OVER (PARTITION BY level, node ORDER BY pid) - 1) // {hi} AS chunk FROM t{i - 1})")
        parts.append(
            f"b{i} AS (SELECT *, count(*) OVER (PARTITION BY level, node, chunk) AS cn, "
            f"sum(w) OVER (PARTITION BY level, node, chunk) AS cw, "
            f"row_number() OVER (PARTITION BY level, node, chunk ORDER BY u, pid) AS r FROM a{i})")
        parts.append(
            f"t{i} AS (SELECT CASE WHEN n >= {lo} THEN level + 1 ELSE level END AS level, "
            f"CASE WHEN n >= {lo} THEN node // {fan} ELSE node END AS node, pid, u, "
            f"CASE WHEN n >= {lo} AND cn >= {lo} THEN cw / {s}.0 ELSE w END AS w FROM b{i} "
            f"WHERE n < {lo} OR cn < {lo} OR r <= {s})")
    return ("WITH " + ",\n".join(parts) +
            f"\nSELECT CAST(level AS BIGINT) AS level, CAST(node AS BIGINT) AS node, pid, round(w, 6) AS weight FROM t{rounds}")


def _projection_sql() -> str:
    cols = ["a", "b", "c", "d"]

    def lin(vec, names):
        return " + ".join(f"{n} * ({float(x)})" for n, x in zip(names, vec))

    p = ", ".join(f"{lin(ax, cols)} AS p{k}" for k, ax in enumerate(PROJ_AXES))
    pn = [f"p{k}" for k in range(len(PROJ_AXES))]
    rec = ", ".join(f"{lin([ax[i] for ax in PROJ_AXES], pn)} AS r{i}" for i in range(4))
    proj = " + ".join(f"r{i} * r{i}" for i in range(4))
    res = " + ".join(f"({c} - r{i}) * ({c} - r{i})" for i, c in enumerate(cols))
    tot = " + ".join(f"{c} * {c}" for c in cols)
    return f"""
WITH p AS ({_li_points()}),
q AS (SELECT a, b, c, d, {p} FROM p),
r AS (SELECT a, b, c, d, {rec} FROM q)
SELECT round(sqrt(sum({proj})), 6) AS projection_norm,
       round(sqrt(sum({res})), 6) AS residual_norm,
       round(sqrt(sum({tot})), 6) AS frobenius_norm FROM r"""


def _gram_sql() -> str:
    cols = ["a", "b", "c", "d"]
    sel = [f"SELECT CAST({i} AS BIGINT) AS i, CAST({j} AS BIGINT) AS j, "
           f"round(sum({x} * {y}), 4) AS value FROM p"
           for i, x in enumerate(cols) for j, y in enumerate(cols)]
    return f"WITH p AS ({_li_points()})\n" + "\nUNION ALL ".join(sel)


def _axis_products() -> str:
    return ", ".join(" + ".join(f"{n} * ({float(x)})" for n, x in zip("abcd", ax)) + f" AS p{k}" for k, ax in enumerate(PROJ_AXES))


def _light_v() -> str:
    """CTEs that end in ``v``: the light importance of every embedding."""
    return f"""{EMB}, {POS},
mu AS (SELECT j, avg(x) AS m FROM pos GROUP BY j),
dd AS (SELECT pid, sum((x - m) * (x - m)) AS d2 FROM pos JOIN mu USING (j) GROUP BY pid),
tot AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(d2) AS c FROM dd),
v AS MATERIALIZED (SELECT pid, CASE WHEN c > 0 THEN 0.5 / n + 0.5 * d2 / c ELSE 1.0 / n END AS v FROM dd, tot)"""


def _sample(v: str, s: int) -> str:
    """CTEs that end in ``sample`` (pid, weight): s rows by priority v / u, unit input weights."""
    return f"""prio AS (SELECT pid, v, v / {_u('pid')} AS r FROM {v}),
ranked AS MATERIALIZED (SELECT pid, v, r, row_number() OVER (ORDER BY r DESC, pid) AS rn FROM prio),
tau AS (SELECT max(CASE WHEN rn = {s + 1} THEN r END) AS tau FROM ranked),
sample AS MATERIALIZED (SELECT pid, CASE WHEN tau IS NULL OR v >= tau THEN 1.0 ELSE tau / v END AS weight FROM ranked, tau WHERE rn <= {s})"""


def _first(points: str, cells: str, k: int) -> str:
    """(c, j, m): the vectors of the k smallest pids."""
    return f"SELECT o.c, q.j, q.x AS m FROM (SELECT pid, row_number() OVER (ORDER BY pid) - 1 AS c FROM {points}) o JOIN {cells} q USING (pid) WHERE o.c < {k}"


def _model_rows(steps: int) -> str:
    return f"SELECT CAST(c AS BIGINT) AS c, CAST(j AS BIGINT) AS j, round(m, 6) AS value, round(cost, 4) AS cost, true AS fit_close FROM c{steps}, model_cost"


def _weighted_gram(points: str, w: str) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, sum({w} * {x} * {y}) AS v FROM {points}" for i, x in enumerate("abcd") for j, y in enumerate("abcd"))


def _axes_rows(k: int) -> str:
    return "\nUNION ALL ".join(f"SELECT CAST({c} AS BIGINT) AS c, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(v, 6) AS value, round(e, 3) AS eigenvalue FROM proj{c}, val{c}" for c in range(k))


def _stream_nodes_sql(rounds: int = 8) -> str:
    """Sizes of the streamed forest's nodes: only numbers of rows, batch by batch."""
    s, T = STREAM_S, 2 * STREAM_S
    parts = [f"ev AS (SELECT event_id, event_id * {STREAM_FILES} // (SELECT count(*) FROM events) AS b FROM events)",
             "f0 AS (SELECT 0 AS level, 0 AS node, 0 AS n WHERE false)"]
    for b in range(STREAM_FILES):
        parts.append(f"l{b} AS (SELECT event_id % {STREAM_LEAVES} AS leaf, count(*) AS n FROM ev WHERE b = {b} GROUP BY 1)")
        parts.append(f"r{b}_0 AS (SELECT level, node, sum(n) AS n FROM (SELECT 0 AS level, leaf // 2 AS node, CASE WHEN n >= {T} THEN {s} ELSE n END AS n FROM l{b} "
                     f"UNION ALL SELECT level, node, n FROM f{b}) GROUP BY 1, 2)")
        for r in range(rounds):
            parts.append(f"r{b}_{r + 1} AS MATERIALIZED (SELECT CASE WHEN n >= {T} THEN level + 1 ELSE level END AS level, CASE WHEN n >= {T} THEN node // 2 ELSE node END AS node, "
                         f"sum(CASE WHEN n >= {T} THEN {s} ELSE n END) AS n FROM r{b}_{r} GROUP BY 1, 2)")
        parts.append(f"f{b + 1} AS MATERIALIZED (SELECT level, node, n FROM r{b}_{rounds})")
    each = "\nUNION ALL ".join(f"SELECT {b} AS b, level, count(*) AS nodes, sum(n) AS rows, min(n) AS smallest, max(n) AS largest FROM f{b + 1} GROUP BY level" for b in range(STREAM_FILES))
    parts.append(f"sizes AS (SELECT b, count(*) AS num_points, sum(count(*)) OVER (ORDER BY b) AS cum_points FROM ev GROUP BY b), every AS ({each})")
    big = lambda *names: ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)
    return "WITH " + ",\n".join(parts) + f"\nSELECT CAST(b AS BIGINT) AS batch_id, {big('num_points', 'cum_points', 'level', 'nodes', 'rows', 'smallest', 'largest')}, false AS over_time FROM every JOIN sizes USING (b)"


DOC_CELLS = f"""t AS (SELECT doc_id, UNNEST(string_split(text, ' ')) AS t FROM documents),
cells AS (SELECT doc_id AS pid, (('0x' || substr(md5(t), 1, 8))::BIGINT) % {TERM_BUCKETS} AS j,
                 CAST(count(*) AS DOUBLE) AS v FROM t WHERE t <> '' GROUP BY doc_id, j)"""

ORACLES: dict[str, str] = {
    "dense_text_roundtrip": """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS f FROM embeddings),
u AS (SELECT vec_id, UNNEST(range(len(f))) AS j, UNNEST(f) AS x FROM e)
SELECT vec_id, CAST(j AS BIGINT) AS j, round(x, 6) AS value FROM u""",

    "sparse_text_roundtrip": f"""
WITH {DOC_CELLS}
SELECT pid AS doc_id, CAST({TERM_BUCKETS} AS BIGINT) AS size, CAST(j AS BIGINT) AS idx, round(v, 6) AS value FROM cells""",

    "vector_mean_stats": """
WITH m AS (SELECT label, list_avg(CAST(embedding AS DOUBLE[])) AS m FROM embeddings)
SELECT CAST(label AS BIGINT) AS label, count(*) AS cnt, round(avg(m), 6) AS mean,
       round(stddev_pop(m), 6) AS stddev_pop, round(max(m), 6) AS max, round(min(m), 6) AS min
FROM m GROUP BY label""",

    "uniform_coreset": f"""
WITH p AS (SELECT vec_id AS pid, {_u('vec_id')} AS u FROM embeddings),
n AS (SELECT count(*) AS n FROM embeddings)
SELECT pid, round(CASE WHEN n <= 50 THEN 1.0 ELSE CAST(n AS DOUBLE) / 50.0 END, 6) AS weight
FROM p, n ORDER BY u, pid LIMIT 50""",

    "tree_uniform_coreset": f"""
SELECT pid, round((SELECT count(*) FROM orders) / 50.0, 6)::DOUBLE AS weight
FROM (SELECT o_orderkey AS pid, {_u('o_orderkey')} AS u FROM orders) ORDER BY u, pid LIMIT 50""",

    "weighted_uniform_coreset": f"""
WITH r AS (SELECT o_orderkey AS pid, o_totalprice / 1000.0 AS w, (o_totalprice / 1000.0) / {_u('o_orderkey')} AS r FROM orders),
top AS (SELECT pid, w, r, row_number() OVER (ORDER BY r DESC, pid) AS rn FROM r),
tau AS (SELECT max(CASE WHEN rn = 51 THEN r END) AS tau FROM top)
SELECT pid, round(CASE WHEN tau IS NULL OR w >= tau THEN w ELSE tau END, 6) AS weight FROM top, tau WHERE rn <= 50""",

    "take_ids": f"""
WITH s AS (SELECT o_custkey FROM (SELECT o_orderkey, o_custkey, {_u('o_orderkey')} AS u FROM orders) ORDER BY u, o_orderkey LIMIT 20)
SELECT m.pid FROM s JOIN (SELECT o_custkey, max(o_orderkey) AS pid FROM orders GROUP BY o_custkey) m USING (o_custkey)""",

    "take_multi_sample": f"""
WITH p AS (SELECT o_orderkey AS pid FROM orders UNION ALL SELECT c_custkey + 1000000000 AS pid FROM customer),
n AS (SELECT count(*) AS n FROM p)
SELECT pid, round(n / 30.0, 6)::DOUBLE AS weight FROM (SELECT pid, {_u('pid')} AS u FROM p), n ORDER BY u, pid LIMIT 30""",

    "tree_forest_systematic": _tree_forest_sql(),

    "tree_forest_chunked": _chunked_tree_sql(),

    "leaf_samples": f"""
WITH p AS (SELECT {LINEITEM_PID_SQL} AS pid FROM lineitem),
l AS (SELECT pid, pid % 64 AS leaf, {_u('pid')} AS u FROM p),
c AS (SELECT leaf, count(*) AS n FROM l GROUP BY leaf),
r AS (SELECT l.pid, l.leaf, c.n, row_number() OVER (PARTITION BY l.leaf ORDER BY l.u, l.pid) AS rn
      FROM l JOIN c USING (leaf))
SELECT CAST(0 AS BIGINT) AS level, CAST(leaf // 2 AS BIGINT) AS node, pid,
       round(CASE WHEN n >= 40 AND n > 20 THEN CAST(n AS DOUBLE) / 20.0 ELSE 1.0 END, 6) AS weight
FROM r WHERE n < 40 OR rn <= 20""",

    "light_coreset": _priority(
        f"""{EMB}, {POS},
mu AS (SELECT j, avg(x) AS m FROM pos GROUP BY j),
d AS (SELECT pid, sum((x - m) * (x - m)) AS d2 FROM pos JOIN mu USING (j) GROUP BY pid),
tot AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(d2) AS c FROM d),
v AS (SELECT pid, CASE WHEN c > 0 THEN 0.5 / n + 0.5 * d2 / c ELSE 1.0 / n END AS v FROM d, tot)""",
        "v", 50),

    "tree_light_coreset": f"""
WITH {EMB}, {POS},
{sql.tree('e', sql.light('pos'), TREE_LIGHT_LEAVES, TREE_LIGHT_FAN, TREE_LIGHT_S, SEED)}
SELECT pid, round(weight, 6) AS weight FROM tree_sample""",

    "tree_sensitivity_coreset": f"""
WITH {LABEL_DIST},
near AS MATERIALIZED (SELECT pid, arg_min(c, d2) AS b, min(d2) AS d2 FROM dist GROUP BY pid),
{sql.tree('e', sql.sensitivity('near', '(SELECT count(*) FROM lab)'), TREE_SENS_LEAVES, 2, TREE_SENS_S, SEED)}
SELECT pid, round(weight, 6) AS weight FROM tree_sample""",

    "sensitivity_coreset": _priority(
        f"""{LABEL_DIST},
near AS (SELECT pid, arg_min(c, d2) AS b, min(d2) AS d2 FROM dist GROUP BY pid),
g AS (SELECT CAST(count(*) AS DOUBLE) AS w, sum(d2) AS s, 16.0 * (ln((SELECT count(*) FROM lab)) + 2.0) AS a FROM near),
gb AS (SELECT b, CAST(count(*) AS DOUBLE) AS wb, sum(d2) AS cb FROM near GROUP BY b),
v AS (SELECT pid, a * d2 / (s / w) + 2 * a * cb / (wb * (s / w)) + 4.0 * w / wb AS v FROM near JOIN gb USING (b), g)""",
        "v", 100),

    "norm_coreset": _priority(
        f"""p AS ({_li_points()}),
v AS (SELECT pid, a * a + b * b + c * c + d * d AS v FROM p)""", "v", 100),

    "leverage_coreset": _priority(
        f"""p AS ({_li_points()}),
q AS (SELECT pid, {_axis_products()} FROM p),
l AS (SELECT sum(p0 * p0) AS l0, sum(p1 * p1) AS l1 FROM q),
v AS (SELECT pid, p0 * p0 / l0 + p1 * p1 / l1 AS v FROM q, l)""", "v", 100),

    "sparse_leverage_coreset": _priority(
        f"""{DOC_CELLS},
q AS (SELECT pid, sum(v) AS p0, sum(v * (j % 3)) AS p1 FROM cells GROUP BY pid),
l AS (SELECT sum(p0 * p0) AS l0, sum(p1 * p1) AS l1 FROM q),
v AS (SELECT pid, p0 * p0 / l0 + p1 * p1 / l1 AS v FROM q, l)""", "v", 50),

    "cluster_mean_coreset": f"""
WITH {LABEL_DIST},
asg AS (SELECT pid, arg_min(c, d2) AS cluster FROM dist GROUP BY pid),
agg AS (SELECT a.cluster, p.j, count(*) AS n, avg(p.x) AS m FROM pos p JOIN asg a USING (pid)
        GROUP BY a.cluster, p.j)
SELECT CAST(cluster AS BIGINT) AS cluster, n, round(CAST(n AS DOUBLE), 6) AS weight,
       CAST(j AS BIGINT) AS j, round(m, 6) AS value FROM agg""",

    "kmeans_cost_label_centres": f"""
WITH {LABEL_DIST},
best AS (SELECT pid, min(d2) AS d2 FROM dist GROUP BY pid)
SELECT round(sum(d2), 6) AS cost, (SELECT count(*) FROM lab) AS k,
       CAST((SELECT max(len(f)) FROM e) AS BIGINT) AS dim FROM best""",

    "progressive_cost": f"""
WITH {EMB},
n AS (SELECT count(*) AS n FROM e),
num AS (SELECT pid, label, f, row_number() OVER (ORDER BY pid) - 1 AS idx FROM e),
b AS (SELECT num.*, CAST(floor(idx * {PROG_BATCHES} / n) AS BIGINT) AS batch FROM num, n),
pos AS (SELECT pid, label, idx, batch, UNNEST(range(len(f))) AS j, UNNEST(f) AS x FROM b),
bs AS (SELECT DISTINCT batch AS batch_id FROM b),
cent AS (SELECT bs.batch_id, p.label, p.j, avg(p.x) AS m FROM bs JOIN pos p ON p.batch <= bs.batch_id
         GROUP BY bs.batch_id, p.label, p.j),
sizes AS (SELECT batch AS batch_id, count(*) AS num_points FROM b GROUP BY batch),
cum AS (SELECT batch_id, num_points,
               sum(num_points) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_points,
               row_number() OVER (ORDER BY batch_id) AS batch_no FROM sizes),
dist AS (SELECT c.batch_id, p.pid, c.label, sum((p.x - c.m) * (p.x - c.m)) AS d2
         FROM cum JOIN pos p ON p.idx < cum.cum_points
         JOIN cent c ON c.batch_id = cum.batch_id AND c.j = p.j
         GROUP BY c.batch_id, p.pid, c.label),
cost AS (SELECT batch_id, sum(d2) AS cost
         FROM (SELECT batch_id, pid, min(d2) AS d2 FROM dist GROUP BY batch_id, pid) GROUP BY batch_id),
cm AS (SELECT batch_id, label, avg(m) AS cmean FROM cent GROUP BY batch_id, label),
st AS (SELECT batch_id, count(*) AS k, avg(cmean) AS a, stddev_pop(cmean) AS sd,
              max(cmean) AS mx, min(cmean) AS mn FROM cm GROUP BY batch_id)
SELECT CAST(cum.batch_id AS BIGINT) AS batch_id, CAST(cum.num_points AS BIGINT) AS num_points,
       CAST(cum.cum_points AS BIGINT) AS cum_points, (SELECT n FROM n) AS total_points,
       CAST(cum.batch_no AS BIGINT) AS batch_no, round(cost.cost, 6) AS cost, st.k AS k,
       CAST((SELECT max(len(f)) FROM e) AS BIGINT) AS dim, round(st.a, 6) AS mean_of_means,
       round(st.sd, 6) AS stddev_of_means, round(st.mx, 6) AS max_of_means,
       round(st.mn, 6) AS min_of_means
FROM cum JOIN cost USING (batch_id) JOIN st USING (batch_id)""",

    "projection_norm": _projection_sql(),

    "gram_matrix": _gram_sql(),

    "streaming_tree_uniform": f"""
SELECT pid, round((SELECT count(*) FROM events) / 50.0, 6)::DOUBLE AS weight
FROM (SELECT event_id AS pid, {_u('event_id')} AS u FROM events) ORDER BY u, pid LIMIT 50""",

    "streaming_results_running": _stream_nodes_sql(),

    "sliding_points": """
WITH w AS (SELECT date_trunc('day', ts) - to_days(CAST(k AS INTEGER)) AS ws, value
           FROM events, range(2) t(k))
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(ws + INTERVAL 2 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
       count(*) AS rows, round(sum(value), 6) AS value_sum FROM w GROUP BY ws""",

    "inner_join_bag": """
SELECT o_orderkey, o_custkey, c_name, round(o_totalprice, 2) AS o_totalprice
FROM orders JOIN customer ON o_custkey = c_custkey""",

    "broadcast_join": """
SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, n_name
FROM customer JOIN nation ON c_nationkey = n_nationkey""",

    "sample_back_join": f"""
WITH s AS (SELECT o_orderkey, {_u('o_orderkey')} AS u FROM orders ORDER BY u, o_orderkey LIMIT 20),
p AS (SELECT o_orderkey, row_number() OVER (ORDER BY u, o_orderkey) - 1 AS pos FROM s)
SELECT CAST(pos AS BIGINT) AS pos, o.o_orderkey, o.o_custkey, round(o.o_totalprice, 2) AS o_totalprice
FROM p JOIN orders o USING (o_orderkey)""",

    "reduce_by_key": """
SELECT l_orderkey, round(sum(l_quantity), 2) AS qty, count(*) AS lines FROM lineitem GROUP BY l_orderkey""",

    "count_distinct_nodes": """
SELECT count(DISTINCT l_orderkey // 2) AS num_nodes FROM lineitem""",

    "distinct_rows": """
SELECT DISTINCT l_returnflag, l_linestatus, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem""",

    "count_by_value": """
SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS cnt FROM lineitem GROUP BY 1""",

    "sort_first": f"""
SELECT pid, l_extendedprice FROM (
  SELECT {LINEITEM_PID_SQL} AS pid, round(l_extendedprice, 2) AS l_extendedprice, l_extendedprice AS x
  FROM lineitem) ORDER BY x DESC, pid LIMIT 1""",

    "chunk_groups": """
WITH c AS (SELECT (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1) // 3 AS chunk
           FROM lineitem)
SELECT CAST(chunk AS BIGINT) AS chunk, count(*) AS cnt FROM c GROUP BY chunk""",

    "bag_union": f"""
WITH p AS (SELECT {LINEITEM_PID_SQL} AS pid, l_returnflag, l_quantity FROM lineitem)
SELECT pid FROM p WHERE l_returnflag = 'R' UNION ALL SELECT pid FROM p WHERE l_quantity > 45""",

    "scalable_row_index": f"""
SELECT {LINEITEM_PID_SQL} AS idx, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       round(l_extendedprice, 2) AS l_extendedprice FROM lineitem""",

    "document_term_vectors": f"""
WITH t AS (SELECT doc_id, UNNEST(string_split(text, ' ')) AS t FROM documents),
c AS (SELECT doc_id, (('0x' || substr(md5(t), 1, 8))::BIGINT) % {TERM_BUCKETS} AS i, count(*) AS c
      FROM t WHERE t <> '' GROUP BY doc_id, i)
SELECT doc_id, CAST({TERM_BUCKETS} AS BIGINT) AS size, count(*) AS nnz, CAST(sum(c) AS BIGINT) AS total,
       round(sum(CAST(c AS DOUBLE) * c), 2) AS sq_norm FROM c GROUP BY doc_id""",

    "sparse_light_coreset": _priority(
        f"""{DOC_CELLS},
n AS (SELECT CAST(count(DISTINCT pid) AS DOUBLE) AS n FROM cells),
mu AS (SELECT j, sum(v) / (SELECT n FROM n) AS m FROM cells GROUP BY j),
mn AS (SELECT sum(m * m) AS mn FROM mu),
xm AS (SELECT c.pid, sum(c.v * mu.m) AS xm FROM cells c JOIN mu USING (j) GROUP BY c.pid),
xn AS (SELECT pid, sum(v * v) AS xn FROM cells GROUP BY pid),
d AS (SELECT xn.pid, greatest(xn.xn - 2.0 * xm.xm + mn.mn, 0.0) AS d2 FROM xn JOIN xm USING (pid), mn),
tot AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(d2) AS c FROM d),
v AS (SELECT pid, CASE WHEN c > 0 THEN 0.5 / n + 0.5 * d2 / c ELSE 1.0 / n END AS v FROM d, tot)""",
        "v", 50),

    "sparse_norm_coreset": _priority(
        f"""{DOC_CELLS},
v AS (SELECT pid, sum(v * v) AS v FROM cells GROUP BY pid)""", "v", 50),

    "sparse_cluster_coreset": f"""
WITH {DOC_CELLS}
SELECT CAST(j AS BIGINT) AS j, round(sum(v), 4) AS total, (SELECT CAST(count(DISTINCT pid) AS DOUBLE) FROM cells) AS weight, true AS small
FROM cells GROUP BY j""",

    "weighted_kmeans": f"""
WITH {_light_v()}, {_sample("v", KMEANS_SAMPLE)},
pts AS MATERIALIZED (SELECT pid, weight AS w FROM sample), cells AS MATERIALIZED (SELECT pid, j, x FROM pos WHERE pid IN (SELECT pid FROM pts)),
init AS MATERIALIZED ({_first("pts", "cells", KMEANS_K)}),
{sql.lloyd('pts', 'cells', 'init', KMEANS_STEPS)}
{_model_rows(KMEANS_STEPS)}""",

    "bulk_kmeans": f"""
WITH {EMB}, {POS},
pts AS MATERIALIZED (SELECT pid, CAST(1 AS DOUBLE) AS w FROM e), cells AS MATERIALIZED (SELECT pid, j, x FROM pos),
init AS MATERIALIZED ({_first("pts", "cells", KMEANS_K)}),
{sql.lloyd('pts', 'cells', 'init', KMEANS_STEPS)}
{_model_rows(KMEANS_STEPS)}""",

    "sparse_kmeans_coreset": f"""
WITH {DOC_CELLS}, d AS MATERIALIZED (SELECT pid, j, v AS x FROM cells), p AS MATERIALIZED (SELECT DISTINCT pid FROM cells),
xx AS MATERIALIZED (SELECT pid, sum(x * x) AS xx FROM d GROUP BY pid),
rough AS MATERIALIZED ({_first("p", "d", SPARSE_K)}),
rc AS MATERIALIZED (SELECT c, sum(m * m) AS cc FROM rough GROUP BY c),
xc AS MATERIALIZED (SELECT d.pid, r.c, sum(d.x * r.m) AS xc FROM d JOIN rough r USING (j) GROUP BY d.pid, r.c),
dd AS MATERIALIZED (SELECT xx.pid, rc.c, xx.xx - 2 * coalesce(xc.xc, 0) + rc.cc AS d2 FROM xx CROSS JOIN rc LEFT JOIN xc ON xc.pid = xx.pid AND xc.c = rc.c),
near AS MATERIALIZED (SELECT pid, arg_min(c, (d2, c)) AS b, greatest(min(d2), 0) AS d2 FROM dd GROUP BY pid),
whole AS MATERIALIZED (SELECT 0 AS level, 0 AS node, pid, CAST(1 AS DOUBLE) AS w FROM p),
{sql.sensitivity('near', SPARSE_K)('whole', 'sv')},
{_sample("sv", SPARSE_SAMPLE)},
pts AS MATERIALIZED (SELECT pid, weight AS w FROM sample), pc AS MATERIALIZED (SELECT pid, j, x FROM d WHERE pid IN (SELECT pid FROM pts)),
init AS MATERIALIZED ({_first("pts", "pc", SPARSE_K)}),
{sql.lloyd('pts', 'pc', 'init', SPARSE_STEPS)}
{_model_rows(SPARSE_STEPS)}""",

    "svd_axes": f"""
WITH p AS MATERIALIZED ({_li_points()}),
gram AS MATERIALIZED ({_weighted_gram("p", "1.0")}),
{sql.projectors('gram', 2)}
{_axes_rows(2)}""",

    "weighted_svd": f"""
WITH p AS MATERIALIZED ({_li_points()}), v AS MATERIALIZED (SELECT pid, a * a + b * b + c * c + d * d AS v FROM p), {_sample("v", 200)},
ps AS MATERIALIZED (SELECT p.*, weight AS w FROM p JOIN sample USING (pid)),
gram AS MATERIALIZED ({_weighted_gram("ps", "w")}),
{sql.projectors('gram', 2)}
{_axes_rows(2)}""",

    "sparse_svd_coreset": f"""
WITH {DOC_CELLS}, v AS MATERIALIZED (SELECT pid, sum(v * v) AS v FROM cells GROUP BY pid), {_sample("v", 100)},
x AS MATERIALIZED (SELECT pid, j, v * sqrt(weight) AS x FROM cells JOIN sample USING (pid)),
half AS MATERIALIZED (SELECT a.pid AS i, b.pid AS j, sum(a.x * b.x) AS v FROM x a JOIN x b ON a.j = b.j GROUP BY a.pid, b.pid),
gram AS MATERIALIZED (SELECT s.pid AS i, t.pid AS j, coalesce(half.v, 0) AS v FROM sample s CROSS JOIN sample t LEFT JOIN half ON half.i = s.pid AND half.j = t.pid),
{sql.projectors('gram', 2)},
js AS (SELECT UNNEST(range({TERM_BUCKETS})) AS j),
""" + ",\n".join(f"""u{c} AS MATERIALIZED (SELECT q.i AS pid, q.v / sqrt(top.v) AS u FROM proj{c} q JOIN (SELECT i, v FROM proj{c} WHERE i = j ORDER BY v DESC, i LIMIT 1) top ON q.j = top.i),
ax{c} AS MATERIALIZED (SELECT x.j, sum(x.x * u.u) AS v FROM x JOIN u{c} u USING (pid) GROUP BY x.j)""" for c in range(2)) + "\n" + "\nUNION ALL ".join(
        f"SELECT CAST({c} AS BIGINT) AS c, CAST(js.j AS BIGINT) AS j, round(coalesce(ax{c}.v * ax{c}.v / e, 0), 6) AS value, round(e, 3) AS eigenvalue FROM js LEFT JOIN ax{c} ON ax{c}.j = js.j, val{c}" for c in range(2)),

    "sparse_svd_cost": f"""
WITH {DOC_CELLS},
ax AS (SELECT j, CAST(1 AS DOUBLE) AS a, CAST(j % 3 AS DOUBLE) AS b FROM (SELECT UNNEST(range({TERM_BUCKETS})) AS j)),
g AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM ax),
p AS (SELECT pid, sum(v * a) AS pa, sum(v * b) AS pb, sum(v * v) AS xx FROM cells JOIN ax USING (j) GROUP BY pid),
q AS (SELECT xx, pa * pa + pb * pb AS pp, pa * pa * aa + 2 * pa * pb * ab + pb * pb * bb AS pg FROM p, g)
SELECT round(sqrt(sum(pg)), 3) AS projection_norm, round(sqrt(sum(greatest(xx - 2 * pp + pg, 0.0))), 3) AS residual_norm,
       round(sqrt(sum(xx)), 3) AS frobenius_norm FROM q""",

    "label_mean_transpose": f"""
WITH {EMB}, {POS}
SELECT CAST(j AS BIGINT) AS i, CAST(label AS BIGINT) AS j, round(avg(x), 6) AS value FROM pos GROUP BY j, label""",

    "label_mean_product": f"""
WITH {LABEL_DIST}
SELECT pos.pid, cent.c AS c, round(sum(pos.x * cent.m), 6) AS value FROM pos JOIN cent USING (j) GROUP BY pos.pid, cent.c""",

    "streaming_kmeans_step": f"""
WITH {LABEL_DIST},
near AS (SELECT pid, arg_min(c, d2) AS c FROM dist GROUP BY pid),
m AS (SELECT near.c, pos.j, count(*) AS m, avg(pos.x) AS xbar FROM near JOIN pos USING (pid) GROUP BY near.c, pos.j),
n AS (SELECT CAST({STREAM_KMEANS_WEIGHT * STREAM_KMEANS_DECAY} AS DOUBLE) AS na)
SELECT cent.c, round(na + coalesce(m.m, 0), 6) AS weight, CAST(cent.j AS BIGINT) AS j,
       round((cent.m * na + coalesce(m.xbar * m.m, 0.0)) / (na + coalesce(m.m, 0)), 6) AS value
FROM cent LEFT JOIN m ON m.c = cent.c AND m.j = cent.j, n""",

    "observed_rows": "SELECT count(*) AS rows, max(l_quantity) AS max_quantity FROM lineitem",
}
ORACLES["evaluate_job"] = f"""
SELECT ranges, batch_id, num_points, cum_points, total_points, round(cost, 4) AS cost, k, dim
FROM ({ORACLES["progressive_cost"]}), (SELECT CAST(UNNEST([0, 5]) AS BIGINT) AS ranges)"""
