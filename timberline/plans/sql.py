"""Oracle SQL, written from the semantics alone: levels of a tree unrolled into common table expressions."""

from __future__ import annotations

from statistics import NormalDist

from timberline.options import Impurity, Options, Selection
from timberline.plans.data import Data


def impurity(counts: list[str], kind: Impurity) -> str:
    n = "(" + " + ".join(counts) + ")"
    if kind is Impurity.Gini:
        body = "1.0::DOUBLE - (" + " + ".join(f"({c}::DOUBLE / {n}) * ({c}::DOUBLE / {n})" for c in counts) + ")"
    else:
        body = " + ".join(f"CASE WHEN {c} > 0 THEN -({c}::DOUBLE / {n}) * log2({c}::DOUBLE / {n}) ELSE 0::DOUBLE END" for c in counts)
    return f"(CASE WHEN {n} > 0 THEN {body} ELSE 0::DOUBLE END)"


def rows(data: Data) -> list[str]:
    """CTE r0: path, class_id, f0.."""
    return [f"src AS ({data.sql})", "r0 AS (SELECT '' AS path, (dense_rank() OVER (ORDER BY label) - 1)::INT AS class_id, * EXCLUDE (label) FROM src)", "classes AS (SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS class_id FROM (SELECT DISTINCT label FROM src))"]


def histogram(data: Data, i: int) -> list[str]:
    k = range(data.classes)
    long = " UNION ALL ".join(f"SELECT path, class_id, {f} AS fi, f{f} AS v FROM r{i}" for f in range(len(data.features)))
    counts = ", ".join(f"count(*) FILTER (class_id = {c}) AS c{c}" for c in k)
    return [f"n{i} AS (SELECT path, count(*) AS n, {counts} FROM r{i} GROUP BY path)", f"h{i} AS (SELECT path, fi, v, min(class_id) AS mn, max(class_id) AS mx, {counts} FROM ({long}) GROUP BY path, fi, v)"]


def sweep(data: Data, i: int, o: Options) -> list[str]:
    """w: boundaries; s: valid candidates of nodes that may split."""
    k = range(data.classes)
    run = ", ".join(f"sum(c{c}) OVER (PARTITION BY path, fi ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS l{c}, sum(c{c}) OVER (PARTITION BY path, fi)::BIGINT AS t{c}" for c in k)
    left, every, right = [f"l{c}" for c in k], [f"t{c}" for c in k], [f"(t{c} - l{c})" for c in k]
    nl, nr, n = " + ".join(left), " + ".join(right), " + ".join(every)
    gain = f"{impurity(every, o.impurity)} - ((({nl})::DOUBLE / ({n})) * {impurity(left, o.impurity)} + (({nr})::DOUBLE / ({n})) * {impurity(right, o.impurity)})"
    apart = f"abs(pv - v) >= {o.epsilon}" + (" AND pmx <> mn" if o.candidates == "adjacent" else "")
    least = max(1, o.min_samples_per_leaf)
    can = f"greatest({', '.join(f'n{i}.c{c}' for c in k)}) < n{i}.n AND n{i}.n >= {o.min_samples_to_split}"
    ratio = o.selection is Selection.MeanGainFiltered
    split = impurity(["nl", "nr"], Impurity.Entropy) if ratio else "0.0::DOUBLE"
    return [
        f"w{i} AS (SELECT *, lag(v) OVER (PARTITION BY path, fi ORDER BY v) AS pv, lag(mx) OVER (PARTITION BY path, fi ORDER BY v) AS pmx, {run} FROM h{i})",
        f"g{i} AS (SELECT path, fi, (pv + v)::DOUBLE / 2.0 AS threshold, pv, {nl} AS nl, {nr} AS nr, {gain} AS gain FROM w{i} WHERE pv IS NOT NULL AND {apart})",
        f"q{i} AS (SELECT g{i}.*, {split} AS si FROM g{i} JOIN n{i} USING (path) WHERE nl >= {least} AND nr >= {least} AND gain > {o.epsilon} AND {can})",
        f"s{i} AS (SELECT *, {'gain / si' if ratio else '0.0::DOUBLE'} AS gr, {'gain / si' if ratio else 'gain'} AS score FROM q{i}" + (f" WHERE si > {o.epsilon})" if ratio else ")"),
    ]


def choose(i: int, o: Options) -> list[str]:
    """pf: best of each feature; b: best of each node."""
    e, ratio = o.epsilon, o.selection is Selection.MeanGainFiltered

    def tied(name: str, source: str, key: str) -> list[str]:
        out = [f"{name}a AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY {key}) AS top FROM {source}) WHERE score >= top - {e})"]
        if ratio:
            out.append(f"{name}b AS (SELECT * FROM (SELECT * EXCLUDE (top), max(gain) OVER (PARTITION BY {key}) AS top FROM {name}a) WHERE gain >= top - {e})")
        return out

    last = "b" if ratio else "a"
    mean = f"SELECT * FROM (SELECT *, avg(gain) OVER (PARTITION BY path) AS mean FROM pf{i}) WHERE gain + {e} >= mean" if ratio else f"SELECT * FROM pf{i}"
    return [
        *tied(f"pf{i}", f"s{i}", "path, fi"),
        f"pf{i} AS (SELECT * EXCLUDE (k, top) FROM (SELECT *, row_number() OVER (PARTITION BY path, fi ORDER BY threshold) AS k FROM pf{i}{last}) WHERE k = 1)",
        f"mg{i} AS ({mean})",
        *tied(f"b{i}", f"mg{i}", "path"),
        f"b{i} AS (SELECT * EXCLUDE (k, top) FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY fi, threshold) AS k FROM b{i}{last}) WHERE k = 1" + (f" AND gr > {e})" if ratio else ")"),
    ]


def descend(data: Data, i: int) -> str:
    value = "CASE b.fi " + " ".join(f"WHEN {f} THEN f{f}" for f in range(len(data.features))) + " END"
    return f"r{i + 1} AS (SELECT r.path || CASE WHEN {value} <= b.pv THEN 'L' ELSE 'R' END AS path, r.* EXCLUDE (path) FROM r{i} r JOIN b{i} b ON r.path = b.path)"


def level(data: Data, o: Options, i: int = 0) -> list[str]:
    return [*histogram(data, i), *sweep(data, i, o), *choose(i, o)]


def grown(data: Data, o: Options) -> list[str]:
    """CTE nodes: path, depth, n, c0.., fi, threshold (null at leaves), majority class."""
    out = rows(data)
    for i in range(o.max_depth):
        out += [*level(data, o, i), descend(data, i)]
    out.append(histogram(data, o.max_depth)[0])
    cs = [f"c{c}" for c in range(data.classes)]
    best = "CASE " + " ".join(f"WHEN {c} = greatest({', '.join(cs)}) THEN {j}" for j, c in enumerate(cs)) + " END"
    parts = [f"SELECT path, {i} AS depth, n, {', '.join(cs)}, " + (f"fi, threshold FROM n{i} LEFT JOIN (SELECT path, fi, threshold FROM b{i}) USING (path)" if i < o.max_depth else f"NULL::INT AS fi, NULL::DOUBLE AS threshold FROM n{i}") for i in range(o.max_depth + 1)]
    out.append(f"nodes AS (SELECT *, {best} AS major FROM ({' UNION ALL '.join(parts)}))")
    return out


def routed(data: Data, o: Options) -> list[str]:
    """CTE routed: each row's class and the leaf that thresholds lead to."""
    value = "CASE b.fi " + " ".join(f"WHEN {f} THEN f{f}" for f in range(len(data.features))) + " END"
    out = ["p0 AS (SELECT * FROM r0)"]
    for i in range(o.max_depth):
        out.append(f"p{i + 1} AS (SELECT p.path || CASE WHEN b.path IS NULL THEN '' WHEN {value} <= b.threshold THEN 'L' ELSE 'R' END AS path, p.* EXCLUDE (path) FROM p{i} p LEFT JOIN (SELECT path, fi, threshold FROM b{i}) b ON p.path = b.path)")
    out.append(f"routed AS (SELECT path, class_id FROM p{o.max_depth})")
    return out


def pessimistic(n: str, e: str, factor: float) -> str:
    z = NormalDist().inv_cdf(1 - factor)
    rate = f"(({e} + 0.5) / {n}::DOUBLE)"
    upper = f"({rate} + {z * z} / (2.0 * {n}) + {z} * sqrt({rate} / {n} - {rate} * {rate} / {n} + {z * z} / (4.0 * {n} * {n}))) / (1.0 + {z * z} / {n})"
    extra = f"CASE WHEN {e} = 0 THEN {n} * (1.0 - pow({factor}::DOUBLE, 1.0::DOUBLE / {n})) WHEN {e} + 0.5 >= {n} THEN greatest({n} - {e}, 0)::DOUBLE ELSE greatest({upper} * {n} - {e}, 0::DOUBLE) END"
    return f"(CASE WHEN {n} > 0 THEN {e} + {extra} ELSE 0::DOUBLE END)"


def pruned(data: Data, o: Options, mode: str) -> list[str]:
    """CTE kept: the nodes that remain: path, depth, is_leaf, n, major, fi, threshold."""
    cs = range(data.classes)
    counts = ", ".join(f"count(*) FILTER (r.class_id = {c}) AS d{c}" for c in cs)
    top = f"greatest({', '.join(f'd{c}' for c in cs)})"
    major = "CASE " + " ".join(f"WHEN d{c} = {top} THEN {c}" for c in cs) + " END"
    own = "CASE major " + " ".join(f"WHEN {c} THEN d{c}" for c in cs) + " END"
    out = [f"spot AS (SELECT nodes.*, x.* EXCLUDE (path) FROM nodes JOIN (SELECT nodes.path, count(r.class_id) AS rn, {counts} FROM nodes LEFT JOIN routed r ON starts_with(r.path, nodes.path) GROUP BY nodes.path) x USING (path))"]
    price = (lambda n, e: pessimistic(n, e, o.confidence_factor)) if mode == "pessimistic" else (lambda n, e: f"({e})::DOUBLE")
    alpha = 0.0 if mode == "pessimistic" else o.ccp_alpha
    for d in range(o.max_depth, -1, -1):
        leaf = f"SELECT path, TRUE AS leaf, FALSE AS cut, {price('rn', f'(rn - {own})')} AS cost, 1 AS leaves FROM spot WHERE depth = {d} AND fi IS NULL"
        if d == o.max_depth:
            out.append(f"k{d} AS ({leaf})")
            continue
        inner = f"SELECT a.path, {price('rn', f'(rn - {top})')} AS one, l.cost + r.cost AS many, l.leaves + r.leaves AS leaves FROM spot a JOIN k{d + 1} l ON l.path = a.path || 'L' JOIN k{d + 1} r ON r.path = a.path || 'R' WHERE depth = {d} AND fi IS NOT NULL"
        test = f"one + {alpha} <= many + {alpha} * leaves + {o.epsilon}"
        out.append(f"k{d} AS ({leaf} UNION ALL SELECT path, {test}, {test}, CASE WHEN {test} THEN one ELSE many END, CASE WHEN {test} THEN 1 ELSE leaves END FROM ({inner}))")
    every = " UNION ALL ".join(f"SELECT * FROM k{d}" for d in range(o.max_depth + 1))
    out.append(f"cuts AS ({every})")
    out.append(f"kept AS (SELECT a.path, a.depth, c.leaf AS is_leaf, CASE WHEN c.cut THEN rn ELSE n END AS n, CASE WHEN c.cut THEN {major} ELSE major END AS major, CASE WHEN NOT c.leaf THEN fi END AS fi, CASE WHEN NOT c.leaf THEN threshold END AS threshold FROM spot a JOIN cuts c USING (path) WHERE NOT EXISTS (SELECT 1 FROM cuts u WHERE u.cut AND u.path <> a.path AND starts_with(a.path, u.path)))")
    return out


def many_classes(data: Data, depth: int) -> str:
    """Nodes of a tree by Gini and highest gain, for any number of classes: sums of squared counts as running sums of (2 * count before + 1) over rows."""
    out = ["src AS (%s)" % data.sql, "r0 AS (SELECT '' AS path, * FROM src)"]
    for i in range(depth):
        long = " UNION ALL ".join(f"SELECT path, label, {f} AS fi, f{f} AS v FROM r{i}" for f in range(len(data.features)))
        value = "CASE b.fi " + " ".join(f"WHEN {f} THEN f{f}" for f in range(len(data.features))) + " END"
        out += [
            f"h{i} AS (SELECT path, fi, v, label, count(*) AS n FROM ({long}) GROUP BY ALL)",
            f"l{i} AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY path, fi, label ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS l, sum(n) OVER (PARTITION BY path, fi, label)::BIGINT AS t FROM h{i})",
            f"v{i} AS (SELECT path, fi, v, min(label) AS mn, max(label) AS mx, sum(n)::BIGINT AS n, sum(n * n + 2 * l * n)::BIGINT AS dl, sum(n * n - 2 * (t - l) * n)::BIGINT AS dr FROM l{i} GROUP BY ALL)",
            f"w{i} AS (SELECT path, fi, v, mn, lag(v) OVER o AS pv, lag(mx) OVER o AS pmx, sum(n) OVER e AS nl, sum(dl) OVER e AS sl, sum(dr) OVER e AS sr, sum(n) OVER (PARTITION BY path, fi) AS nn, sum(dl) OVER (PARTITION BY path, fi) AS s FROM v{i} WINDOW o AS (PARTITION BY path, fi ORDER BY v), e AS (PARTITION BY path, fi ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
            f"g{i} AS (SELECT *, (nn - s::DOUBLE / nn - (nl - sl::DOUBLE / nl) - ((nn - nl) - (s + sr)::DOUBLE / (nn - nl))) / nn AS gain FROM w{i} WHERE pv IS NOT NULL AND abs(pv - v) >= 1e-9 AND pmx <> mn)",
            f"b{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY fi, (pv + v)::DOUBLE) AS k FROM (SELECT *, max(gain) OVER (PARTITION BY path) AS top FROM g{i} WHERE gain > 1e-9) WHERE gain >= top - 1e-9) WHERE k = 1)",
            f"r{i + 1} AS (SELECT r.path || CASE WHEN {value} <= b.pv THEN 'L' ELSE 'R' END AS path, r.* EXCLUDE (path) FROM r{i} r JOIN b{i} b ON r.path = b.path)",
        ]
    counts = " UNION ALL ".join(f"SELECT {i} AS depth, path, label, count(*) AS n FROM r{i} GROUP BY ALL" for i in range(depth + 1))
    splits = " UNION ALL ".join(f"SELECT path, fi, (pv + v)::DOUBLE / 2.0 AS threshold FROM b{i}" for i in range(depth))
    out += [f"c AS ({counts})", "nodes AS (SELECT path, depth, sum(n)::BIGINT AS n, count(*)::INT AS classes FROM c GROUP BY ALL)", "major AS (SELECT path, label FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, label) AS k FROM c) WHERE k = 1)", f"splits AS ({splits})"]
    return query(out, "SELECT path, depth, fi IS NULL AS is_leaf, fi AS feature_index, threshold, CASE WHEN fi IS NULL THEN label END AS leaf_label, n AS sample_count, classes FROM nodes JOIN major USING (path) LEFT JOIN splits USING (path)")


def query(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
