"""SQL building blocks for the DuckDB oracles (independent brute-force forms).

The oracles deliberately compute things the slow, obvious way (self-joins
for neighbours, one comparison per grid level) so they check the
distributed algorithms rather than restate them.
"""

from vigil.sources.catalog import (COLLECTIVE_HI, COLLECTIVE_LO, COLLECTIVE_PERIOD, COLLECTIVE_VALUE,
                                   INTERVAL, LINE_PLANT_SHIFT, PLANT_EVERY, PLANT_SHIFT)

FLAG = f"(CASE WHEN event_id % {PLANT_EVERY} = 0 THEN 1 ELSE 0 END)"

# events as one long series / one series per user, planted label
EVENTS = (f"SELECT CAST(0 AS BIGINT) AS series_id, event_id AS rid, ts, "
          f"value + {PLANT_SHIFT} * {FLAG} AS value, {FLAG} AS is_anomaly FROM events")
EVENTS_BY_USER = (f"SELECT user_id AS series_id, event_id AS rid, ts, "
                  f"value + {PLANT_SHIFT} * {FLAG} AS value, {FLAG} AS is_anomaly FROM events")
EVENTS_WEAK = ("SELECT CAST(0 AS BIGINT) AS series_id, event_id AS rid, ts, value, "
               "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_anomaly FROM events")
EVENTS_INTERVAL = ("SELECT CAST(0 AS BIGINT) AS series_id, event_id AS rid, ts, value, "
                   f"CASE WHEN ts BETWEEN TIMESTAMP '{INTERVAL[0]}' AND TIMESTAMP '{INTERVAL[1]}' "
                   "THEN 1 ELSE 0 END AS is_anomaly FROM events")
_CM = f"(event_id % {COLLECTIVE_PERIOD} BETWEEN {COLLECTIVE_LO} AND {COLLECTIVE_HI})"
EVENTS_COLLECTIVE = (f"SELECT CAST(0 AS BIGINT) AS series_id, event_id AS rid, ts, "
                     f"CASE WHEN {_CM} THEN CAST({COLLECTIVE_VALUE} AS DOUBLE) ELSE value END AS value, "
                     f"CASE WHEN {_CM} THEN 1 ELSE 0 END AS is_anomaly FROM events")
EVENTS_SPARSE_PAIR = ("SELECT CAST(0 AS BIGINT) AS series_id, event_id AS rid, ts, "
                      f"CASE WHEN event_id % 31 <> 5 THEN value + {PLANT_SHIFT} * {FLAG} END AS value, "
                      "CASE WHEN event_id % 43 <> 11 THEN CAST(hour(ts) * 60 + minute(ts) AS DOUBLE) END AS minute, "
                      f"{FLAG} AS is_anomaly FROM events")
LFLAG = f"(CASE WHEN l_orderkey % {PLANT_EVERY} = 0 THEN 1 ELSE 0 END)"
LINEITEM = (f"SELECT CAST(0 AS BIGINT) AS series_id, l_orderkey * 8 + l_linenumber AS rid, l_partkey, l_suppkey, "
            f"l_quantity + {LINE_PLANT_SHIFT} * {LFLAG} AS l_quantity, l_extendedprice, l_discount, l_tax, "
            f"{LFLAG} AS is_anomaly FROM lineitem")
LINEITEM_SRC = f"({LINEITEM})"
EMBEDDINGS = ("SELECT CAST(0 AS BIGINT) AS series_id, vec_id AS rid, "
              "list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec, label AS class_label, "
              "CASE WHEN label = 0 THEN 1 ELSE 0 END AS is_anomaly FROM embeddings")

DATASETS = {"events": EVENTS, "events_by_user": EVENTS_BY_USER, "events_weak": EVENTS_WEAK,
            "events_interval": EVENTS_INTERVAL, "events_collective": EVENTS_COLLECTIVE,
            "lineitem": LINEITEM, "embeddings": EMBEDDINGS}


def knn_1d(src: str, k: int) -> str:
    """Brute-force k-th neighbour distance per row (self excluded) -> series_id, rid, score."""
    return f"""(SELECT series_id, rid, d AS score FROM (
        SELECT a.series_id, a.rid, abs(a.value - b.value) AS d,
               row_number() OVER (PARTITION BY a.series_id, a.rid ORDER BY abs(a.value - b.value)) AS rn
        FROM ({src}) a JOIN ({src}) b ON a.series_id = b.series_id AND a.rid <> b.rid) WHERE rn = {k})"""


def percentile_flag(src: str, q: float, score: str = "score") -> str:
    """Rows of src plus flag = score > per-series percentile q (0..100)."""
    return f"""(SELECT x.*, CASE WHEN x.{score} > t.th THEN 1 ELSE 0 END AS flag FROM ({src}) x
        JOIN (SELECT series_id, quantile_cont({score}, {q / 100.0}) AS th FROM ({src}) GROUP BY series_id) t
        USING (series_id))"""


def f1_sql(src: str, label: str = "is_anomaly", flag: str = "flag") -> str:
    tp = f"CAST(count_if({label} = 1 AND {flag} = 1) AS BIGINT)"
    fp = f"CAST(count_if({label} = 0 AND {flag} = 1) AS BIGINT)"
    fn = f"CAST(count_if({label} = 1 AND {flag} = 0) AS BIGINT)"
    return (f"(SELECT CASE WHEN 2*{tp}+{fp}+{fn} = 0 THEN 0.0 ELSE 2.0*{tp} / (2*{tp}+{fp}+{fn}) END "
            f"FROM ({src}))")


def auroc_sql(src: str, score: str = "score", label: str = "is_anomaly", by: str = "") -> str:
    """Mann-Whitney AUROC with mid-ranks; ``by`` = optional grouping column list."""
    part = f"PARTITION BY {by}" if by else ""
    part2 = f"PARTITION BY {by}, {score}" if by else f"PARTITION BY {score}"
    sel = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""(SELECT {sel}CASE WHEN P > 0 AND N > 0 THEN (S - P * (P + 1) / 2.0) / (P * N) END AS auroc FROM (
        SELECT {sel}sum(CASE WHEN {label} = 1 THEN r0 + (c - 1) / 2.0 ELSE 0 END) AS S,
               CAST(sum({label}) AS DOUBLE) AS P, CAST(count(*) - sum({label}) AS DOUBLE) AS N
        FROM (SELECT *, rank() OVER ({part} ORDER BY {score}) AS r0, count(*) OVER ({part2}) AS c
              FROM ({src})) {grp}))"""


def with_pos(src: str, by: str = "series_id", order: str = "ts, rid", name: str = "row_idx") -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"(SELECT *, row_number() OVER ({part} ORDER BY {order}) - 1 AS {name} FROM ({src}))"


def knn_1d_band(src: str, k: int) -> str:
    """k-th neighbour distance using value-order positions (band join of +-k rows)."""
    return f"""(SELECT series_id, rid, d AS score FROM (
        SELECT a.series_id, a.rid, abs(a.value - b.value) AS d,
               row_number() OVER (PARTITION BY a.series_id, a.rid ORDER BY abs(a.value - b.value)) AS rn
        FROM {with_pos(src, order='value, rid', name='vp')} a
        JOIN {with_pos(src, order='value, rid', name='vp')} b
          ON a.series_id = b.series_id AND b.vp BETWEEN a.vp - {k} AND a.vp + {k} AND b.vp <> a.vp)
        WHERE rn = {k})"""


def erf(x: str) -> str:
    """erf by Abramowitz & Stegun 7.1.26 (same fixed values as the Spark side)."""
    from vigil.functions.columns import ERF_A, ERF_P
    a1, a2, a3, a4, a5 = ERF_A
    t = f"(1.0 / (1.0 + {ERF_P} * abs({x})))"
    y = f"(1.0 - (((((({a5} * {t} + ({a4})) * {t} + {a3}) * {t} + ({a2})) * {t} + {a1}) * {t}) * exp(-(abs({x}) * abs({x})))))"
    return f"(CASE WHEN {x} < 0 THEN -{y} ELSE {y} END)"


def loop_from_edges(edges: str, extent: int = 3) -> str:
    """LoOP from an edge relation (series_id, rid, nid, d) -> series_id, rid, score."""
    return f"""(WITH e AS ({edges}),
    pd AS (SELECT series_id, rid, {extent}.0 * sqrt(avg(d * d)) AS pdist FROM e GROUP BY series_id, rid),
    ev AS (SELECT e.series_id, e.rid, avg(pd.pdist) AS ev FROM e JOIN pd ON e.series_id = pd.series_id
           AND e.nid = pd.rid GROUP BY e.series_id, e.rid),
    pl AS (SELECT pd.series_id, pd.rid, pd.pdist / (CASE WHEN ev.ev = 0 THEN 1e-8 ELSE ev.ev END) - 1.0 AS plof
           FROM pd JOIN ev USING (series_id, rid)),
    np AS (SELECT series_id, {extent}.0 * sqrt(avg(plof * plof)) AS nplof FROM pl GROUP BY series_id),
    x AS (SELECT pl.series_id, pl.rid, np.nplof, pl.plof / (np.nplof * sqrt(2.0)) AS z
          FROM pl JOIN np USING (series_id))
    SELECT series_id, rid, CASE WHEN nplof > 0 THEN greatest(0.0, {erf('z')}) ELSE 0.0 END AS score FROM x)"""


def edges_1d(src: str, k: int) -> str:
    """Brute-force k nearest others by |dv|, ties by position gap then position (value order)."""
    p = with_pos(src, order="value, rid", name="vp")
    return f"""SELECT series_id, rid, nid, d FROM (
        SELECT a.series_id, a.rid, b.rid AS nid, abs(a.value - b.value) AS d,
               row_number() OVER (PARTITION BY a.series_id, a.rid
                                  ORDER BY abs(a.value - b.value), abs(a.vp - b.vp), b.vp) AS rn
        FROM {p} a JOIN {p} b ON a.series_id = b.series_id AND a.rid <> b.rid) WHERE rn <= {k}"""


def edges_vec(q: str, r: str, k: int, p: int = 2, exclude_self: bool = True) -> str:
    """Brute-force k nearest references per query vector, ties by reference id."""
    dist = ("list_distance(a.vec, b.vec)" if p == 2 else
            "list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: abs(z[1] - z[2])))")
    cond = "AND a.rid <> b.rid" if exclude_self else ""
    return f"""SELECT series_id, rid, nid, d FROM (
        SELECT a.series_id, a.rid, b.rid AS nid, {dist} AS d,
               row_number() OVER (PARTITION BY a.series_id, a.rid ORDER BY {dist}, b.rid) AS rn
        FROM ({q}) a JOIN ({r}) b ON a.series_id = b.series_id {cond}) WHERE rn <= {k}"""


def kfold_expr(pos: str, n: str, k: int) -> str:
    """Contiguous KFold id: the first n % k folds hold one extra row."""
    q = f"({n} // {k})"
    r = f"({n} % {k})"
    return (f"CAST(CASE WHEN {pos} < {r} * ({q} + 1) THEN {pos} // ({q} + 1) "
            f"ELSE {r} + ({pos} - {r} * ({q} + 1)) // {q} END AS INTEGER)")


def windows(src: str, w: int, p: int, by: str = "series_id") -> str:
    """Window summaries for windows of w rows with p target rows (full windows only)."""
    part = f"PARTITION BY {by}" if by else ""
    frame = f"OVER ({part} ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)"
    tgt = f"lead(value, {w}) OVER ({part} ORDER BY row_idx)"
    full = f"lead(value, {w + p - 1}) OVER ({part} ORDER BY row_idx)"
    return f"""(SELECT {by + ', ' if by else ''}row_idx AS win_start, CAST(count(*) {frame} AS INTEGER) AS n_window,
               sum(value) {frame} AS window_sum, value AS window_first,
               lead(value, {w - 1}) OVER ({part} ORDER BY row_idx) AS window_last,
               {tgt} AS target, {full} AS full_marker FROM {with_pos(src, by)})"""


# ------------------------------------------------------------------ isolation forest


def unit(*parts: str) -> str:
    """The hash number of operators.forest.hash_unit: 52 bits of an MD5 as [0, 1)."""
    return f"(CAST(('0x' || substr(md5({' || chr(58) || '.join(parts)}), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def forest_ctes(src: str, key: list[str], feats: list[str], n_trees: int, psi: int, seed: int = 42) -> tuple[str, int]:
    """CTEs of a whole forest (base, e0 .. eL hold the levels' nodes) and the last level."""
    limit = max(1, (psi - 1).bit_length())
    f, s = ", ".join(feats), f"'{seed}'"
    k = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in key)
    out = [f"base AS MATERIALIZED (SELECT *, {k} AS k, row_number() OVER () AS rowno FROM {src})",
           f"pool AS MATERIALIZED (SELECT k, {f} FROM base WHERE {unit(s, chr(39) + 'pool' + chr(39), 'k')} < (2.0 * {psi} * {n_trees} + 1000.0) / (SELECT count(*) FROM base))",
           f"""s0 AS MATERIALIZED (SELECT tree, CAST(1 AS BIGINT) AS node, {f} FROM (SELECT tree, {f},
               row_number() OVER (PARTITION BY tree ORDER BY {unit(s, 'tree', 'k')}, k, {f}) AS rn
               FROM pool, (SELECT unnest(range({n_trees})) AS tree)) WHERE rn <= {psi})"""]
    for lv in range(limit + 1):
        usable = ", ".join(f"CASE WHEN max({c}) > min({c}) THEN {i} END" for i, c in enumerate(feats))
        out.append(f"""a{lv} AS MATERIALIZED (SELECT tree, node, count(*) AS size, [{', '.join(f'min({c})' for c in feats)}] AS lo,
            [{', '.join(f'max({c})' for c in feats)}] AS hi, list_filter([{usable}], lambda x: x IS NOT NULL) AS c FROM s{lv} GROUP BY tree, node)""")
        out.append(f"""d{lv} AS (SELECT *, CASE WHEN size > 1 AND len(c) > 0 AND {lv} < {limit}
            THEN c[1 + CAST(floor({unit(s, "'feature'", 'tree', 'node')} * len(c)) AS INT)] ELSE -1 END AS feature FROM a{lv})""")
        out.append(f"""e{lv} AS MATERIALIZED (SELECT CAST(tree AS INT) AS tree, node, feature,
            CASE WHEN feature >= 0 THEN lo[feature + 1] + {unit(s, "'threshold'", 'tree', 'node')} * (hi[feature + 1] - lo[feature + 1]) ELSE 0.0::DOUBLE END AS threshold,
            CASE WHEN feature >= 0 THEN 2 * node ELSE -1 END AS "left", CASE WHEN feature >= 0 THEN 2 * node + 1 ELSE -1 END AS "right",
            size, {lv} AS depth FROM d{lv})""")
        if lv < limit:
            out.append(f"""s{lv + 1} AS MATERIALIZED (SELECT s.tree, 2 * s.node + CASE WHEN [{f}][e.feature + 1] >= e.threshold THEN 1 ELSE 0 END AS node, {f}
                FROM s{lv} s JOIN e{lv} e ON s.tree = e.tree AND s.node = e.node WHERE e.feature >= 0)""")
    return ", ".join(out), limit


def forest_nodes(src, key, feats, n_trees, psi, seed=42) -> str:
    ctes, limit = forest_ctes(src, key, feats, n_trees, psi, seed)
    union = " UNION ALL ".join(f"SELECT * FROM e{lv}" for lv in range(limit + 1))
    return f"""WITH {ctes} SELECT tree, node, feature, round(threshold, 6) AS threshold, "left", "right", size, depth FROM ({union})"""


def forest_paths(src, key, feats, n_trees, psi, seed=42) -> str:
    """CTEs ending with paths(rowno, tree, h): every row's path length in every tree, one level per CTE."""
    ctes, limit = forest_ctes(src, key, feats, n_trees, psi, seed)
    f = ", ".join(feats)
    steps, ends = [f"w0 AS (SELECT rowno, CAST(tree AS INT) AS tree, CAST(1 AS BIGINT) AS node, {f} FROM base, (SELECT unnest(range({n_trees})) AS tree))"], []
    for lv in range(limit + 1):
        steps.append(f"j{lv} AS MATERIALIZED (SELECT w.*, e.feature, e.threshold, e.size FROM w{lv} w LEFT JOIN e{lv} e ON w.tree = e.tree AND w.node = e.node)")
        ends.append(f"SELECT rowno, tree, {lv} + coalesce({c_factor('size')}, 0.0) AS h FROM j{lv} WHERE coalesce(feature, -1) < 0")
        if lv < limit:
            steps.append(f"w{lv + 1} AS (SELECT rowno, tree, 2 * node + CASE WHEN [{f}][feature + 1] >= threshold THEN 1 ELSE 0 END AS node, {f} FROM j{lv} WHERE feature >= 0)")
    return f"{ctes}, {', '.join(steps)}, paths AS MATERIALIZED ({' UNION ALL '.join(ends)})"


def c_factor(n) -> str:
    return f"(CASE WHEN {n} > 2 THEN 2.0 * (ln({n} - 1.0) + 0.5772156649015329) - 2.0 * ({n} - 1.0) / {n} WHEN {n} = 2 THEN 1.0 ELSE 0.0 END)"


def forest_scores(src, key, feats, cols, n_trees, psi, seed=42) -> str:
    """(cols, score) of all rows."""
    return f"""WITH {forest_paths(src, key, feats, n_trees, psi, seed)}
        SELECT {cols}, round(pow(2.0, -h / ({n_trees} * {c_factor(float(psi))})), 6) AS score
        FROM base JOIN (SELECT rowno, sum(h) AS h FROM paths GROUP BY rowno) USING (rowno)"""


def forest_cv(rows: str, feats: list[str], combos: str, levels: int, folds: int = 5, seed: int = 42) -> str:
    """Mean AUROC over the folds of every forest of ``combos`` (n_trees, max_samples, max_features, contamination).

    ``rows`` has rid, fold, is_anomaly and the features; ``levels`` bounds the depth of any tree.
    """
    s, d, key = f"'{seed}'", len(feats), "f, psi, sub, tree"
    lo, hi = (", ".join(f"{fn}({c})" for c in feats) for fn in ("min", "max"))
    f = ", ".join(feats)
    out = [f"base AS MATERIALIZED (SELECT *, CAST(rid AS VARCHAR) AS k FROM {rows})", f"combo AS MATERIALIZED ({combos})",
           f"""want AS MATERIALIZED (SELECT c.*, t.f, greatest(2, CAST(floor(c.max_samples * t.n) AS BIGINT)) AS psi, greatest(1, CAST(round(c.max_features * {d}) AS INT)) AS sub
               FROM combo c, (SELECT f, count(*) FILTER (fold <> f) AS n FROM base, (SELECT unnest(range({folds})) AS f) GROUP BY f) t)""",
           "forest AS MATERIALIZED (SELECT f, psi, sub, max(n_trees) AS trees, CAST(ceil(log2(psi)) AS INT) AS lim FROM want GROUP BY f, psi, sub)",
           f"own AS MATERIALIZED (SELECT tree, list(ft ORDER BY {unit(s, chr(39) + 'features' + chr(39), 'tree', 'ft')}) AS o FROM (SELECT unnest(range(1000)) AS tree), (SELECT unnest(range({d})) AS ft) GROUP BY tree)",
           f"""hashed AS MATERIALIZED (SELECT rid, k, fold, tree, {unit(s, 'tree', 'k')} AS h FROM base, (SELECT unnest(range((SELECT max(trees) FROM forest))) AS tree))""",
           """drawn AS MATERIALIZED (SELECT f, psi, tree, rid FROM (SELECT w.f, w.psi, h.tree, h.rid, row_number() OVER (PARTITION BY w.f, w.psi, h.tree ORDER BY h.h, h.k) AS rn
               FROM hashed h JOIN (SELECT f, psi, max(trees) AS trees FROM forest GROUP BY f, psi) w ON h.fold <> w.f AND h.tree < w.trees) WHERE rn <= psi)""",
           "s0 AS MATERIALIZED (SELECT d.f, d.psi, w.sub, w.lim, d.tree, CAST(1 AS BIGINT) AS node, d.rid FROM drawn d JOIN forest w ON d.f = w.f AND d.psi = w.psi AND d.tree < w.trees)",
           "w0 AS MATERIALIZED (SELECT w.f, w.psi, w.sub, t.tree, CAST(1 AS BIGINT) AS node, b.rid FROM forest w JOIN base b ON b.fold = w.f, (SELECT unnest(range(1000)) AS tree) t WHERE t.tree < w.trees)"]
    ends = []
    for lv in range(levels + 1):
        out.append(f"a{lv} AS (SELECT {key}, lim, node, count(*) AS size, [{lo}] AS lo, [{hi}] AS hi FROM s{lv} JOIN base USING (rid) GROUP BY {key}, lim, node)")
        out.append(f"""c{lv} AS (SELECT a.*, list_filter(list_sort(list_slice(o, 1, sub)), lambda i: hi[i + 1] > lo[i + 1]) AS c FROM a{lv} a JOIN own USING (tree))""")
        out.append(f"""e{lv} AS MATERIALIZED (SELECT {key}, node, size, ft, CASE WHEN ft >= 0 THEN lo[ft + 1] + {unit(s, "'threshold'", 'tree', 'node')} * (hi[ft + 1] - lo[ft + 1]) END AS thr
            FROM (SELECT *, CASE WHEN size > 1 AND len(c) > 0 AND {lv} < lim THEN c[1 + CAST(floor({unit(s, "'feature'", 'tree', 'node')} * len(c)) AS INT)] ELSE -1 END AS ft FROM c{lv}))""")
        out.append(f"""j{lv} AS MATERIALIZED (SELECT w.*, e.ft, e.thr, e.size FROM w{lv} w LEFT JOIN e{lv} e USING ({key}, node))""")
        ends.append(f"SELECT {key}, rid, {lv} + coalesce({c_factor('size')}, 0.0) AS h FROM j{lv} WHERE coalesce(ft, -1) < 0")
        if lv < levels:
            step = f"2 * node + CASE WHEN [{f}][ft + 1] >= thr THEN 1 ELSE 0 END AS node"
            out.append(f"s{lv + 1} AS MATERIALIZED (SELECT {key}, lim, {step}, rid FROM s{lv} JOIN e{lv} USING ({key}, node) JOIN base USING (rid) WHERE ft >= 0)")
            out.append(f"w{lv + 1} AS MATERIALIZED (SELECT {key}, {step}, rid FROM j{lv} JOIN base USING (rid) WHERE ft >= 0)")
    return f"""WITH {', '.join(out)}, paths AS MATERIALIZED ({' UNION ALL '.join(ends)}),
    sc AS MATERIALIZED (SELECT p.f, p.psi, p.sub, q.n_trees, p.rid, round(pow(2.0, -sum(p.h) / (q.n_trees * {c_factor('CAST(p.psi AS DOUBLE)')})), 9) AS score
        FROM paths p JOIN (SELECT DISTINCT f, psi, sub, n_trees FROM want) q ON p.f = q.f AND p.psi = q.psi AND p.sub = q.sub AND p.tree < q.n_trees GROUP BY p.f, p.psi, p.sub, q.n_trees, p.rid),
    r AS (SELECT sc.*, is_anomaly, rank() OVER (PARTITION BY f, psi, sub, n_trees ORDER BY score) + (count(*) OVER (PARTITION BY f, psi, sub, n_trees, score) - 1) / 2.0 AS mid FROM sc JOIN base USING (rid)),
    a AS (SELECT f, psi, sub, n_trees, sum(CASE WHEN is_anomaly = 1 THEN mid END) AS w, CAST(count_if(is_anomaly = 1) AS DOUBLE) AS p, CAST(count_if(is_anomaly = 0) AS DOUBLE) AS n FROM r GROUP BY ALL)
    SELECT CAST(n_trees AS INTEGER) AS n_trees, max_samples, max_features, contamination, round(avg(CASE WHEN p > 0 AND n > 0 THEN (w - p * (p + 1) / 2) / (p * n) END), 6) AS mean_auroc
    FROM want JOIN a USING (f, psi, sub, n_trees) GROUP BY ALL"""
