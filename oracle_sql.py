"""DuckDB twins of the registered queries (the correctness oracle).

Written independently in DuckDB's dialect over the pre-registered views; doubles
are rounded to 6 decimals as on the Spark side.  Shared only: fixed values (the
structure list, grammar patterns, periodic symbols, masses, table constants) and the
engine-neutral normal-distribution stages, whose accuracy is tested separately
against Python's ``math.erfc`` / ``statistics.NormalDist``.
"""

from __future__ import annotations

from propkit.functions import grammar as G
from propkit.functions.normal import log_cdf_stages, ppf_stages
from propkit.functions.staged import stages_sql
from propkit.operators.stats import AD_BASE_CRITICAL, AD_SIGNIFICANCE
from propkit.plans.fixtures import STRUCTURES

Y = "(SELECT value AS y FROM events WHERE value IS NOT NULL AND NOT isnan(value))"


def _lit(s: str) -> str:
    parts = s.split("\u00a0")
    return " || chr(160) || ".join("'" + p.replace("'", "''") + "'" for p in parts)


def _list(items) -> str:
    return "[" + ", ".join(_lit(x) if isinstance(x, str) else repr(x) for x in items) + "]"


def _bisected(name: str, rows: str, family: str) -> str:
    """CTE ``name(lam)``: the zero of the score of the power family's likelihood over ``rows`` (y), by bisection."""
    power = lambda x, k: f"(pow({x}, {k}) - 1) / ({k})"
    slope = lambda x, k: f"(pow({x}, {k}) * ln({x}) - {power(x, k)}) / ({k})"
    if family == "boxcox":
        z, z1, c = power("y", "mid"), slope("y", "mid"), "ln(y)"
    else:
        z = f"CASE WHEN y >= 0 THEN {power('(1 + y)', 'mid')} ELSE -({power('(1 - y)', '(2 - mid)')}) END"
        z1 = f"CASE WHEN y >= 0 THEN {slope('(1 + y)', 'mid')} ELSE {slope('(1 - y)', '(2 - mid)')} END"
        c = "sign(y) * ln(1 + abs(y))"
    return f"""{name}_(lo, hi, step) AS (SELECT -5.1::DOUBLE, 5.3::DOUBLE, 0
  UNION ALL SELECT CASE WHEN sc > 0 THEN mid ELSE lo END, CASE WHEN sc > 0 THEN hi ELSE mid END, step + 1 FROM (
    SELECT lo, hi, step, mid, sum({c}) - count(*) * covar_pop({z}, {z1}) / var_pop({z}) AS sc
    FROM (SELECT *, (lo + hi) / 2 AS mid FROM {name}_ WHERE step < 60), ({rows}) GROUP BY lo, hi, step, mid)),
{name} AS (SELECT (lo + hi) / 2 AS lam FROM {name}_ WHERE step = 60)"""


YJ = """CASE WHEN y >= 0 THEN (pow(1 + y, lam) - 1) / lam ELSE -(pow(1 - y, 2 - lam) - 1) / (2 - lam) END"""
DIMS = 64  # of the embeddings


def _solved(rows: str, alphas: list[float]) -> str:
    """CTEs that solve ridge regression in closed form for every group ``g`` of ``rows`` (g, v, y):
    ``solved(g, alpha, b0, b)``, by Gauss-Jordan elimination of the centred normal equations."""
    return f"""
tr AS ({rows}),
avgs AS (SELECT g, i, avg(x) AS m FROM (SELECT g, unnest(list_append(v, y)) AS x, unnest(range(1, {DIMS} + 2)) AS i FROM tr) GROUP BY g, i),
mean AS (SELECT g, list(m ORDER BY i) AS m FROM avgs GROUP BY g),
cen AS (SELECT tr.g, list_transform(list_append(v, y), lambda x, i: x - mean.m[i]) AS z FROM tr JOIN mean USING (g)),
prod AS (SELECT g, i, j, sum(z[i] * z[j]) AS s FROM cen, range(1, {DIMS} + 1) a(i), range(1, {DIMS} + 2) b(j) GROUP BY g, i, j),
line AS (SELECT g, alpha, i, list(s + CASE WHEN i = j THEN alpha ELSE 0 END ORDER BY j) AS r
  FROM prod, (SELECT unnest({alphas!r}::DOUBLE[]) AS alpha) GROUP BY g, alpha, i),
elim(g, alpha, k, m) AS (
  SELECT g, alpha, 1, list(r ORDER BY i) FROM line GROUP BY g, alpha
  UNION ALL
  SELECT g, alpha, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda e: e / m[k][k])
    ELSE list_transform(r, lambda e, j: e - r[k] * m[k][j] / m[k][k]) END) FROM elim WHERE k <= {DIMS}),
beta AS (SELECT g, alpha, list_transform(m, lambda r: r[{DIMS} + 1]) AS b FROM elim WHERE k = {DIMS} + 1),
solved AS (SELECT g, alpha, b, mean.m[{DIMS} + 1] - list_dot_product(b, mean.m[1:{DIMS}]) AS b0 FROM beta JOIN mean USING (g))"""


METRICS = """count(*) AS n, round(1 - sum(pow(t - p, 2)) / (var_pop(t) * count(t)), 6) AS r2, round(avg(pow(t - p, 2)), 6) AS mse,
  round(sqrt(avg(pow(t - p, 2))), 6) AS rmse, round(avg(abs(t - p)), 6) AS mae, round(regr_slope(p, t), 6) AS slope, round(regr_intercept(p, t), 6) AS intercept"""


def _folds(folds: int, alphas: list[float], seed: int = 42, half: int = 1000000) -> str:
    """``r2s(fold, alpha, r2)``: every fold scored by the fit on the others, over a sample of ``half`` in a million."""
    part = f"('0x' || substr(md5('{seed + 7}:fold:' || vec_id::VARCHAR), 1, 12))::BIGINT % 1000000 < {half}"
    fold = f"('0x' || substr(md5('{seed}:fold:' || vec_id::VARCHAR), 1, 12))::BIGINT % {folds}"
    return f"""WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label::DOUBLE AS y, {fold} AS fold FROM embeddings WHERE {part}),
{_solved(f"SELECT f.g, v, y FROM e, range({folds}) f(g) WHERE fold <> f.g", alphas)},
r2s AS (SELECT fold, alpha, 1 - sum(pow(y - b0 - list_dot_product(b, v), 2)) / (var_pop(y) * count(y)) AS r2
  FROM e JOIN solved ON g = fold GROUP BY fold, alpha)"""


STRUCT_SRC = (f"SELECT p_partkey AS row_id, {_list(STRUCTURES)}[(p_partkey % {len(STRUCTURES)}) + 1] AS smiles, "
              f"p_size FROM part")


def _cap(x: str) -> str:
    sym = f"regexp_extract({x}, '{G.SYMBOL_RE}', 1)"
    return f"(upper(substr({sym}, 1, 1)) || lower(substr({sym}, 2, 2)))"


def _category(z: str) -> str:
    whens = []
    for name, ranges in G.CATEGORY_RULES:
        cond = " OR ".join(f"({z} BETWEEN {lo} AND {hi})" for lo, hi in ranges)
        whens.append(f"WHEN {cond} THEN '{name}'")
    return f"CASE {' '.join(whens)} ELSE 'Other' END"


def _counter(arr: str) -> str:
    return (f"array_to_string(list_sort(list_transform(list_distinct({arr}), lambda k: k || ':' || "
            f"CAST(len(list_filter({arr}, lambda z: z = k)) AS VARCHAR))), ',')")


def profile_sql() -> str:
    mk = list(G.MASSES.keys())
    mv = list(G.MASSES.values())
    hcount = (f"CASE WHEN regexp_extract(x, '{G.BRACKET_H_RE}', 1) = '' THEN 0 "
              f"WHEN regexp_extract(x, '{G.BRACKET_H_RE}', 1) = 'H' THEN 1 "
              f"ELSE CAST(substr(regexp_extract(x, '{G.BRACKET_H_RE}', 1), 2) AS DOUBLE) END")
    mass = f"(list_extract(CAST({_list(mv)} AS DOUBLE[]), list_position({_list(mk)}, {_cap('x')})) + ({hcount}) * {G.H_MASS!r})"
    return f"""
WITH src AS ({STRUCT_SRC}),
c AS (SELECT *, trim(replace(smiles, chr(160), '')) AS s FROM src),
t AS (SELECT *, regexp_extract_all(s, '{G.ATOM_RE}', 1) AS ta,
             regexp_extract_all(regexp_replace(s, '{G.BRACKET_RE}', '', 'g'), '{G.RING_RE}', 1) AS labels FROM c),
u AS (SELECT *, CASE WHEN len(list_filter(ta, lambda x: x <> '[H]')) > 0
                     THEN list_filter(ta, lambda x: x <> '[H]') ELSE ta END AS toks FROM t),
v AS (SELECT *, list_transform(toks, lambda x: {_cap('x')}) AS syms,
             list_transform(toks, lambda x: {mass}) AS masses,
             len(list_filter(toks, lambda x: regexp_matches(x, '{G.AROMATIC_RE}'))) > 0 AS arom FROM u),
w AS (SELECT *, list_transform(syms, lambda x: coalesce(list_position({_list(G.SYMBOLS)}, x), 0)) AS zs FROM v),
x AS (SELECT *, (length(s) > 0 AND regexp_matches(s, '{G.VALID_RE}')
          AND length(s) - length(replace(s, '(', '')) = length(s) - length(replace(s, ')', ''))
          AND len(list_filter(labels, lambda l: len(list_filter(labels, lambda z: z = l)) % 2 <> 0)) = 0
          AND len(list_filter(zs, lambda z: z = 0)) = 0
          AND (NOT arom OR len(labels) > 0)) AS is_valid FROM w)
SELECT row_id, smiles, p_size, is_valid,
       CASE WHEN is_valid THEN CAST(len(toks) AS BIGINT) END AS n_atoms,
       CASE WHEN is_valid THEN arom END AS is_aromatic,
       CASE WHEN is_valid THEN len(labels) = 0 END AS is_non_cyclic,
       CASE WHEN is_valid THEN len(labels) > 0 AND NOT arom END AS is_cyclic_non_aromatic,
       CASE WHEN is_valid THEN CASE WHEN list_contains(syms, 'C') THEN 'Organic' ELSE 'Inorganic' END END AS category,
       CASE WHEN is_valid THEN CASE WHEN len(list_filter(masses, lambda m: m IS NULL)) > 0 THEN NULL
                                    ELSE round(list_sum(masses), 6) END END AS molecular_weight,
       CASE WHEN is_valid THEN {_counter('syms')} END AS elements,
       CASE WHEN is_valid THEN {_counter(f'list_transform(zs, lambda z: {_category("z")})')} END AS element_categories,
       syms, zs
FROM x
"""


def _profile_cte() -> str:
    return f"WITH prof AS ({profile_sql()}), v AS (SELECT * FROM prof WHERE is_valid)"


def _element_counts_cte() -> str:
    return (_profile_cte() + ", el AS (SELECT row_id, unnest(syms) AS element FROM v)")


def _y_strings_sql() -> str:
    q = "CAST(l_quantity AS VARCHAR)"
    return f"""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 7
        WHEN 0 THEN {q}
        WHEN 1 THEN {q} || ' - ' || CAST(l_quantity + l_tax * 100 AS VARCHAR)
        WHEN 2 THEN ' ' || {q} || 'd'
        WHEN 3 THEN '-' || {q}
        WHEN 4 THEN {q} || '-'
        WHEN 5 THEN '-' || {q} || ' - ' || CAST(l_tax AS VARCHAR)
        ELSE 'nan' END AS y_raw FROM lineitem"""


NUM = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"


def _num(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{NUM}') THEN TRY_CAST(trim({x}) AS DOUBLE) END"


def _parse(x: str) -> str:
    p = f"string_split({x}, '-')"
    v = (f"coalesce({_num(x)}, CASE WHEN len({p}) = 2 AND length({p}[1]) > 0 AND length({p}[2]) > 0 "
         f"THEN ({_num(p + '[1]')} + {_num(p + '[2]')}) / 2.0 END)")
    return f"CASE WHEN isnan({v}) THEN NULL ELSE {v} END"


def _scaled(expr: str) -> str:
    return f"SELECT c_custkey, round({expr}, 6) AS scaled FROM customer, s"


def oracle_sql() -> dict[str, str]:
    q = {}
    q["row_count"] = "SELECT count(*) AS n_rows FROM events"
    cols = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"
    conv = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in cols.split(", "))
    q["preview_head"] = f"SELECT {conv} FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 20)"
    q["preview_tail"] = f"SELECT {conv} FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 20)"
    q["table_summary"] = ("SELECT 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' "
                          "AS columns, count(*) AS shape, CAST(NULL AS VARCHAR) AS index_name FROM orders")
    q["row_index_payload"] = ("SELECT o_custkey, min(r) AS first_id, max(r) AS last_id, count(*) AS n_ids FROM (SELECT o_custkey, "
                              "row_number() OVER (ORDER BY o_custkey) - 1 AS r FROM orders) GROUP BY o_custkey")
    q["row_index"] = ("SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS row_id "
                      "FROM orders")
    part_cols = "row_id, p_name, p_brand, p_type, p_size, round(p_retailprice, 6) AS p_retailprice"
    q["dedup_kept"] = (f"SELECT {part_cols} FROM (SELECT p_partkey AS row_id, * FROM part) "
                       "QUALIFY row_number() OVER (PARTITION BY lower(p_name) ORDER BY row_id) = 1")
    q["dedup_dropped"] = (f"SELECT {part_cols} FROM (SELECT p_partkey AS row_id, * FROM part) "
                          "QUALIFY row_number() OVER (PARTITION BY lower(p_name) ORDER BY row_id) > 1")
    q["dedup_documents"] = ("SELECT doc_id AS row_id, lang, CAST(length(text) AS BIGINT) AS n_chars FROM documents "
                            "QUALIFY row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) = 1")
    q["range_filter"] = ("SELECT event_id, round(value, 6) AS value FROM events "
                         "WHERE NOT isnan(value) AND value BETWEEN 10.0 AND 100.0")
    q["range_filter_open"] = "SELECT event_id, round(value, 6) AS value FROM events WHERE NOT isnan(value) AND value >= 0.0"
    q["parse_range_target"] = (f"SELECT l_orderkey, l_linenumber, round({_parse('y_raw')}, 6) AS y "
                               f"FROM ({_y_strings_sql()})")
    q["training_rows"] = (
        "SELECT vec_id AS row_id, round(y, 6) AS y, CAST(len(embedding) AS BIGINT) AS dim FROM ("
        f"SELECT vec_id, embedding, {_parse('y_raw')} AS y FROM (SELECT vec_id, embedding, "
        "CASE WHEN label % 4 = 0 THEN 'n/a' ELSE CAST(label AS VARCHAR) END AS y_raw FROM embeddings)) "
        "WHERE y IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z = 0)) = 0")
    # ---- distribution
    q["describe"] = (f"SELECT count(y) AS count, round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS std, "
                     f"round(min(y), 6) AS min, round(quantile_cont(y, 0.25), 6) AS q25, "
                     f"round(quantile_cont(y, 0.5), 6) AS q50, round(quantile_cont(y, 0.75), 6) AS q75, "
                     f"round(max(y), 6) AS max FROM {Y}")
    q["histogram"] = f"""
WITH y AS {Y},
s AS (SELECT count(*) AS n, min(y) AS lo, max(y) AS hi, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM y),
p AS (SELECT *, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS f, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS l,
             (hi - lo) / (log2(n) + 1.0) AS sturges, 2.0 * (q3 - q1) * pow(n, -1.0 / 3.0) AS fd FROM s),
w AS (SELECT *, CASE WHEN fd > 0 THEN least(fd, sturges) ELSE sturges END AS width FROM p),
b AS (SELECT *, CASE WHEN width > 0 THEN CAST(ceil((l - f) / width) AS BIGINT) ELSE 1 END AS nb FROM w),
e AS (SELECT *, (l - f) / nb AS step FROM b),
i0 AS (SELECT y.y, e.*, least(CAST(floor((y.y - f) * (nb / (l - f))) AS BIGINT), nb - 1) AS k0 FROM y, e),
i1 AS (SELECT *, CASE WHEN y < (CASE WHEN k0 >= nb THEN l ELSE k0 * step + f END) THEN k0 - 1 ELSE k0 END AS k1 FROM i0),
i2 AS (SELECT *, CASE WHEN y >= (CASE WHEN k1 + 1 >= nb THEN l ELSE (k1 + 1) * step + f END) AND k1 <> nb - 1
                      THEN k1 + 1 ELSE k1 END AS bin FROM i1),
c AS (SELECT bin, count(*) AS cnt FROM i2 GROUP BY bin),
g AS (SELECT range AS bin, e.* FROM e, range(0, (SELECT nb FROM e)))
SELECT CAST(g.bin AS INTEGER) AS bin,
       round(CASE WHEN g.bin >= nb THEN l ELSE g.bin * step + f END, 6) AS lo,
       round(CASE WHEN g.bin + 1 >= nb THEN l ELSE (g.bin + 1) * step + f END, 6) AS hi,
       coalesce(c.cnt, 0) AS count
FROM g LEFT JOIN c ON g.bin = c.bin"""
    q["skew_kurtosis"] = f"""
SELECT round(skewness(y) * (n - 2) / sqrt(n * (n - 1)), 6) AS skew_biased, round(skewness(y), 6) AS skewness,
       round((kurtosis(y) * (n - 2) * (n - 3) / (n - 1) - 6) / (n + 1), 6) AS kurtosis_biased,
       round(kurtosis(y), 6) AS kurtosis
FROM (SELECT y, count(*) OVER () AS n FROM {Y}) GROUP BY n"""
    q["kde"] = f"""
WITH y AS {Y}, s AS (SELECT count(*) AS n, min(y) AS lo, max(y) AS hi, stddev_samp(y) AS sd FROM y),
g AS (SELECT range AS point, lo + (hi - lo) * range / 99.0 AS x, n, sd * pow(n, -0.2) AS h FROM s, range(0, 100))
SELECT CAST(point AS INTEGER) AS point, round(x, 6) AS x,
       round(sum(exp(-pow(x - y, 2) / (2.0 * h * h))) / (n * h * sqrt(2.0 * pi())), 6) AS density
FROM g, y GROUP BY point, x, n, h"""
    ranked = f"SELECT y, row_number() OVER (ORDER BY y) AS rank, count(*) OVER () AS n FROM {Y}"
    m = ("SELECT rank, y, CASE WHEN rank = n THEN pow(0.5, 1.0 / n) WHEN rank = 1 THEN 1 - pow(0.5, 1.0 / n) "
         f"ELSE (rank - 0.3175) / (n + 0.365) END AS m FROM ({ranked})")
    q["qq_plot"] = stages_sql(m, ppf_stages("m", "tq"),
                              "CAST(rank AS BIGINT) AS rank, round(tq, 6) AS theoretical_quantile, "
                              "round(y, 6) AS sample_quantile")
    w = (f"SELECT rank, n, (y - avg(y) OVER ()) / stddev_samp(y) OVER () AS w FROM ({ranked})")
    inner = stages_sql(w, log_cdf_stages("w", "lc", "ls"), "rank, n, lc, ls")
    stat = f"SELECT -max(n) - sum((2.0 * rank - 1.0) * lc + (2.0 * (n - rank) + 1.0) * ls) / max(n) AS a2, max(n) AS n FROM ({inner})"
    levels = " UNION ALL ".join(f"SELECT CAST({s!r} AS DOUBLE) AS sl, CAST({a!r} AS DOUBLE) AS av" for s, a in zip(AD_SIGNIFICANCE, AD_BASE_CRITICAL))
    q["anderson_darling"] = (f"SELECT round(sl, 6) AS significance_level, "
                             f"round(round(av / (1.0 + 4.0 / n - 25.0 / n / n), 3), 6) AS critical_value, "
                             f"round(a2, 6) AS statistic FROM ({stat}), ({levels})")
    q["transform_candidates"] = f"""
WITH y AS {Y}, g AS (SELECT skewness(y) AS g1 FROM y),
t AS (SELECT y, ln(1 + y) AS log1p, CASE WHEN y >= 0 THEN sqrt(y) END AS sqrt,
             CASE WHEN y + 1 <> 0 THEN 1.0 / (y + 1) END AS reciprocal, y * y AS square,
             CASE WHEN g.g1 < 0 THEN exp(y) END AS exp FROM y, g),
sk AS (SELECT count(*) AS n, skewness(y) AS s0, skewness(log1p) AS s1, count(log1p) AS c1, skewness(sqrt) AS s2,
              count(sqrt) AS c2, skewness(reciprocal) AS s3, count(reciprocal) AS c3, skewness(square) AS s4,
              skewness(exp) AS s5, count(exp) AS c5 FROM t),
b AS (SELECT n, s0 * (n - 2) / sqrt(n * (n - 1)) AS f0, s1 * (n - 2) / sqrt(n * (n - 1)) AS f1,
             s2 * (n - 2) / sqrt(n * (n - 1)) AS f2, s3 * (n - 2) / sqrt(n * (n - 1)) AS f3,
             s4 * (n - 2) / sqrt(n * (n - 1)) AS f4, s5 * (n - 2) / sqrt(n * (n - 1)) AS f5, c1, c2, c3, c5 FROM sk),
cand AS (
  SELECT 0 AS candidate, 'original' AS method, f0 AS skewness FROM b
  UNION ALL SELECT 1, 'log1p', CASE WHEN c1 = n THEN f1 END FROM b, g WHERE g1 > 0
  UNION ALL SELECT 2, 'sqrt', CASE WHEN c2 = n THEN f2 END FROM b, g WHERE g1 > 0
  UNION ALL SELECT 3, 'reciprocal', CASE WHEN c3 = n THEN f3 END FROM b, g WHERE g1 > 0
  UNION ALL SELECT 1, 'square', f4 FROM b, g WHERE g1 < 0
  UNION ALL SELECT 2, 'exp', CASE WHEN c5 = n AND NOT isinf(f5) THEN f5 END FROM b, g WHERE g1 < 0),
best AS (SELECT candidate FROM cand WHERE skewness IS NOT NULL ORDER BY abs(skewness), candidate LIMIT 1)
SELECT CAST(candidate AS INTEGER) AS candidate, method, round(skewness, 6) AS skewness,
       candidate = (SELECT candidate FROM best) AS is_best FROM cand"""
    q["scalar_transforms"] = """
SELECT l_orderkey, l_linenumber,
  round(ln(1 + l_quantity), 6) AS log1p, round(exp(ln(1 + l_quantity)) - 1, 6) AS log1p_inv,
  round(sqrt(l_quantity), 6) AS sqrt, round(pow(sqrt(l_quantity), 2), 6) AS sqrt_inv,
  round(1.0 / (l_quantity + 1), 6) AS reciprocal, round(1.0 / (1.0 / (l_quantity + 1)) - 1, 6) AS reciprocal_inv,
  round(pow(l_quantity, 2), 6) AS square, round(sqrt(pow(l_quantity, 2)), 6) AS square_inv,
  round(exp(l_discount), 6) AS exp, round(ln(exp(l_discount)), 6) AS exp_inv
FROM lineitem"""
    q["power_given_lambda"] = """
SELECT event_id, round((pow(value, 0.25) - 1) / 0.25, 6) AS boxcox,
  round(CASE WHEN value - 50.0 >= 0 THEN (pow(value - 50.0 + 1, 0.8) - 1) / 0.8
             ELSE -(pow(1 - (value - 50.0), 2 - 0.8) - 1) / (2 - 0.8) END, 6) AS yeo_johnson
FROM events"""
    s_std = "WITH s AS (SELECT avg(c_acctbal) AS m, CASE WHEN stddev_pop(c_acctbal) = 0 THEN 1 ELSE stddev_pop(c_acctbal) END AS sc FROM customer) "
    q["scale_standard"] = s_std + _scaled("(c_acctbal - m) / sc")
    q["scale_minmax"] = ("WITH s AS (SELECT min(c_acctbal) AS lo, CASE WHEN max(c_acctbal) = min(c_acctbal) THEN 1 "
                         "ELSE max(c_acctbal) - min(c_acctbal) END AS sc FROM customer) " + _scaled("(c_acctbal - lo) / sc"))
    q["scale_maxabs"] = ("WITH s AS (SELECT CASE WHEN max(abs(c_acctbal)) = 0 THEN 1 ELSE max(abs(c_acctbal)) END AS sc "
                         "FROM customer) " + _scaled("c_acctbal / sc"))
    q["scale_robust"] = ("WITH s AS (SELECT quantile_cont(c_acctbal, 0.5) AS med, CASE WHEN quantile_cont(c_acctbal, 0.75) "
                         "= quantile_cont(c_acctbal, 0.25) THEN 1 ELSE quantile_cont(c_acctbal, 0.75) - "
                         "quantile_cont(c_acctbal, 0.25) END AS sc FROM customer) " + _scaled("(c_acctbal - med) / sc"))
    # ---- structure profile
    q["structure_profile"] = (f"SELECT row_id, is_valid, n_atoms, is_aromatic, is_non_cyclic, is_cyclic_non_aromatic, "
                              f"category, molecular_weight, elements, element_categories FROM ({profile_sql()})")
    q["size_counts"] = _profile_cte() + " SELECT n_atoms, count(*) AS count FROM v GROUP BY n_atoms"
    q["size_bins"] = _profile_cte() + """,
mm AS (SELECT min(n_atoms) AS lo, max(n_atoms) AS hi FROM v),
k AS (SELECT v.n_atoms, mm.lo, mm.hi, greatest(CAST(ceil((v.n_atoms - mm.lo) / 3.0) AS BIGINT), 1) - 1 AS k FROM v, mm)
SELECT CAST(lo + k * 3 AS VARCHAR) || '-' || CAST(least(lo + (k + 1) * 3, hi) AS VARCHAR) AS bins, count(*) AS count
FROM k GROUP BY lo, hi, k"""
    q["structural_distribution"] = _profile_cte() + """
SELECT 'aromatic' AS structural_category, count(*) FILTER (WHERE is_aromatic) AS count FROM v
UNION ALL SELECT 'non-cyclic', count(*) FILTER (WHERE is_non_cyclic) FROM v
UNION ALL SELECT 'cyclic non-aromatic', count(*) FILTER (WHERE is_cyclic_non_aromatic) FROM v"""
    q["elemental_distribution"] = (_element_counts_cte() +
                                   " SELECT element, count(DISTINCT row_id) AS count FROM el GROUP BY element")
    q["top_elements"] = (_element_counts_cte() +
                         " SELECT element, CAST(count(*) AS BIGINT) AS count FROM el GROUP BY element "
                         "ORDER BY count DESC, element LIMIT 5")
    q["element_category_totals"] = (_profile_cte() + ", ec AS (SELECT unnest(zs) AS z FROM v) "
                                    f"SELECT {_category('z')} AS element_category, CAST(count(*) AS BIGINT) AS count "
                                    "FROM ec GROUP BY 1")
    q["profile_summary"] = (f"WITH prof AS ({profile_sql()}) SELECT count(*) AS n_rows, count(*) FILTER (WHERE is_valid) "
                            "AS n_valid, count(*) FILTER (WHERE category = 'Organic') AS n_organic, "
                            "count(*) FILTER (WHERE category = 'Inorganic') AS n_inorganic, "
                            "count(*) FILTER (WHERE is_aromatic) AS n_aromatic, count(*) FILTER (WHERE is_non_cyclic) "
                            "AS n_non_cyclic, count(*) FILTER (WHERE is_cyclic_non_aromatic) AS n_cyclic_non_aromatic "
                            "FROM prof")
    q["profile_filter"] = _element_counts_cte() + """,
df AS (SELECT element, count(DISTINCT row_id) AS c FROM el GROUP BY element),
excl AS (SELECT element FROM df WHERE c <= 100 UNION SELECT 'Br'),
sizes AS (SELECT n_atoms FROM v GROUP BY n_atoms HAVING count(*) > 10),
kept AS (SELECT row_id FROM v WHERE n_atoms IN (SELECT n_atoms FROM sizes) AND n_atoms >= 2 AND n_atoms <= 12
         AND NOT is_cyclic_non_aromatic
         AND row_id NOT IN (SELECT row_id FROM el WHERE element IN (SELECT element FROM excl)))
SELECT p_partkey AS row_id, p_name, p_size, round(p_retailprice, 6) AS p_retailprice FROM part
WHERE p_partkey IN (SELECT row_id FROM kept)"""
    # ---- evaluation
    pairs = ("SELECT l_orderkey, l_linenumber, l_quantity AS y_true, "
             "l_quantity * (1 - l_discount) + l_tax * 10 AS y_pred FROM lineitem")
    q["prediction_metrics"] = f"""
SELECT count(*) AS n, round(1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(y_true)), 6) AS r2,
  round(avg((y_true - y_pred) * (y_true - y_pred)), 6) AS mse, round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 6) AS rmse,
  round(avg(abs(y_true - y_pred)), 6) AS mae, round(regr_slope(y_pred, y_true), 6) AS slope,
  round(regr_intercept(y_pred, y_true), 6) AS intercept FROM ({pairs})"""
    q["prediction_fit"] = f"""
WITH p AS ({pairs}), l AS (SELECT regr_slope(y_pred, y_true) AS m, regr_intercept(y_pred, y_true) AS c FROM p)
SELECT l_orderkey, l_linenumber, round(y_true, 6) AS y_true, round(y_pred, 6) AS y_pred,
       round(m * y_true + c, 6) AS y_linear_fit FROM p, l"""

    # ---- vectors / neighbours / split / corpus
    q["vector_standardize"] = """
WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS dim FROM embeddings),
s AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS sd FROM x GROUP BY dim)
SELECT vec_id, CAST(dim AS BIGINT) AS dim, round((v - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) AS z
FROM x JOIN s USING (dim)"""
    split = ("SELECT vec_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id) - 1 "
             "< ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM embeddings")
    q["train_test_split"] = f"SELECT vec_id AS row_id, split FROM ({split})"
    q["knn_predict"] = f"""
WITH sp AS ({split}), e AS (SELECT vec_id, embedding, CAST(label AS DOUBLE) AS y, split FROM embeddings JOIN sp USING (vec_id)),
d AS (SELECT te.vec_id AS qid, tr.vec_id AS tid, tr.y AS ty,
             list_sum(list_transform(range(1, len(te.embedding) + 1),
                      lambda i: pow(CAST(te.embedding[i] AS DOUBLE) - CAST(tr.embedding[i] AS DOUBLE), 2))) AS dist
      FROM (SELECT * FROM e WHERE split = 'test') te, (SELECT * FROM e WHERE split = 'train') tr)
SELECT qid AS row_id, round(avg(ty), 6) AS y_pred
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS rk FROM d) WHERE rk <= 5 GROUP BY qid"""
    # ---- power transforms by bisection of the score
    skew = lambda v: f"(avg(pow({v} - m, 3)) / pow(var_pop({v}), 1.5))"
    q["boxcox_fit"] = f"""WITH RECURSIVE {_bisected("b", Y[1:-1], "boxcox")},
t AS (SELECT lam, (pow(y, lam) - 1) / lam AS v FROM {Y}, b), k AS (SELECT avg(v) AS m FROM t)
SELECT round(lam, 6) AS lam, round({skew("v")}, 6) AS skew, count(*) AS n FROM t, k GROUP BY lam"""
    acct = "SELECT c_acctbal AS y FROM customer WHERE c_acctbal IS NOT NULL AND NOT isnan(c_acctbal)"
    q["yeo_johnson_fit"] = f"""WITH RECURSIVE {_bisected("b", acct, "yeo_johnson")},
t AS (SELECT lam, {YJ} AS v FROM ({acct}), b), k AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM t)
SELECT round(lam, 6) AS lam, round(avg((v - m) / s), 6) + 0.0 AS mean, round(stddev_pop((v - m) / s), 6) AS std FROM t, k GROUP BY lam"""
    q["auto_transform"] = f"""WITH RECURSIVE {_bisected("b", Y[1:-1], "boxcox")}, {_bisected("j", Y[1:-1], "yeo_johnson")},
t AS (SELECT 0 AS candidate, 'original' AS method, NULL::DOUBLE AS lam, y AS v FROM {Y}
  UNION ALL SELECT 1, 'log1p', NULL, ln(1 + y) FROM {Y} UNION ALL SELECT 2, 'sqrt', NULL, sqrt(y) FROM {Y}
  UNION ALL SELECT 3, 'reciprocal', NULL, 1 / (1 + y) FROM {Y} UNION ALL SELECT 4, 'boxcox', lam, (pow(y, lam) - 1) / lam FROM {Y}, b
  UNION ALL SELECT 5, 'yeo_johnson', lam, {YJ} FROM {Y}, j),
k AS (SELECT candidate, avg(v) AS m FROM t GROUP BY candidate),
s AS (SELECT candidate, method, lam, {skew("v")} AS sk FROM t JOIN k USING (candidate) GROUP BY candidate, method, lam)
SELECT candidate, method, round(sk, 6) AS skewness, row_number() OVER (ORDER BY abs(sk), candidate) = 1 AS is_best, round(lam, 6) AS lam FROM s"""

    # ---- linear models in closed form, draws
    parts = f"e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label::DOUBLE AS y, split FROM embeddings JOIN ({split}) USING (vec_id))"
    q["train_linear"] = f"""WITH RECURSIVE {parts}, {_solved("SELECT 0 AS g, v, y FROM e WHERE split = 'train'", [0.0])},
s AS (SELECT split, y AS t, b0 + list_dot_product(b, v) AS p FROM e, solved) SELECT split, {METRICS} FROM s GROUP BY split"""
    q["train_ridge"] = f"""WITH RECURSIVE {parts}, k AS (SELECT min(ln(1 + y)) AS lo, max(ln(1 + y)) - min(ln(1 + y)) AS w FROM e),
{_solved("SELECT 0 AS g, v, (ln(1 + y) - lo) / w AS y FROM e, k WHERE split = 'train'", [1.0])},
s AS (SELECT split, y AS t, exp((b0 + list_dot_product(b, v)) * w + lo) - 1 AS p FROM e, k, solved) SELECT split, {METRICS} FROM s GROUP BY split"""
    q["score_batch"] = f"""WITH RECURSIVE {parts}, {_solved("SELECT 0 AS g, v, sqrt(y) AS y FROM e WHERE split = 'train'", [0.0])}
SELECT vec_id AS row_id, round(pow(b0 + list_dot_product(b, v), 2), 6) AS predicted_value FROM e, solved"""
    q["cross_validation"] = f"{_folds(5, [1.0])} SELECT fold::INTEGER AS fold, round(r2, 6) AS r2 FROM r2s"
    q["grid_search"] = f"""{_folds(3, [0.001, 0.01, 0.1])},
c AS (SELECT alpha, avg(r2) AS m, stddev_pop(r2) AS s FROM r2s GROUP BY alpha)
SELECT (row_number() OVER (ORDER BY alpha) - 1)::INTEGER AS candidate, '{{"alpha": ' || alpha::VARCHAR || '}}' AS params, round(m, 6) AS mean_test_score,
  round(s, 6) AS std_test_score, (rank() OVER (ORDER BY m DESC))::INTEGER AS rank_test_score FROM c"""
    some = "SELECT fold, alpha, r2 FROM r2s"
    grid = [0.001, 0.01, 0.1, 1.0]
    q["halving_search"] = f"""
WITH a AS (SELECT alpha, avg(r2) AS m FROM ({_folds(3, grid, half=500000)} {some}) GROUP BY alpha),
b AS (SELECT alpha, avg(r2) AS m FROM ({_folds(3, grid)} {some}) GROUP BY alpha),
best AS (SELECT alpha FROM a ORDER BY m DESC, alpha LIMIT 2)
SELECT 0 AS iteration, '{{"alpha": ' || alpha::VARCHAR || '}}' AS params, 0.5::DOUBLE AS fraction, round(m, 6) AS mean_test_score FROM a
UNION ALL SELECT 1, '{{"alpha": ' || alpha::VARCHAR || '}}', 1.0::DOUBLE, round(m, 6) FROM b WHERE alpha IN (SELECT alpha FROM best)"""
    q["row_index_scan"] = "SELECT o_orderkey, row_number() OVER () - 1 AS row_id FROM orders"
    q["train_knn"] = f"""WITH {parts},
d AS (SELECT a.split, a.vec_id AS qid, a.y AS t, b.y, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_sum(list_transform(range(1, {DIMS} + 1),
    lambda i: pow(a.v[i] - b.v[i], 2))), b.vec_id) AS rk FROM e a, e b WHERE b.split = 'train'),
s AS (SELECT split, qid, t, avg(y) AS p FROM d WHERE rk <= 5 GROUP BY split, qid, t) SELECT split, {METRICS} FROM s GROUP BY split"""
    u = lambda what: f"(('0x' || substr(md5('7:{what}:' || d.draw::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE"
    q["bootstrap_sample"] = f"""
WITH o AS (SELECT vec_id, label::DOUBLE AS y, row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS k, count(*) OVER () AS n FROM embeddings),
d AS (SELECT range AS draw FROM range(1000))
SELECT d.draw, vec_id AS row_id, round(y + sqrt(-2.0 * ln({u("radius")})) * cos(2.0 * pi() * {u("angle")}) * 0.05 * abs(y), 6) AS y
FROM d JOIN o ON o.k = least(floor({u("row")} * o.n), o.n - 1)"""
    tok_s = f"regexp_extract_all(trim(replace(smiles, chr(160), '')), '{G.ATOM_RE}', 1)"
    q["corpus_structures"] = f"""
WITH src AS ({STRUCT_SRC}), t AS (SELECT row_id, {tok_s} AS toks FROM src),
s AS (SELECT row_id, CASE WHEN len(toks) > 0 THEN flatten(list_transform(range(1, len(toks) + 1), lambda i:
        [toks[i], '1|' || coalesce(CASE WHEN i > 1 THEN toks[i - 1] END, '') || '|' || toks[i] || '|' || coalesce(CASE WHEN i < len(toks) THEN toks[i + 1] END, '')]))
        ELSE [] END AS sentence FROM t)
SELECT row_id, CAST(len(sentence) AS BIGINT) AS n_ids, array_to_string(sentence, ' ') AS sentence FROM s"""
    tok_d = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: length(w) > 0)"
    q["corpus_documents"] = f"""
WITH t AS (SELECT doc_id, {tok_d} AS toks FROM documents),
s AS (SELECT doc_id, CASE WHEN len(toks) > 0 THEN flatten(list_transform(range(1, len(toks) + 1), lambda i:
        [toks[i], '1|' || coalesce(CASE WHEN i > 1 THEN toks[i - 1] END, '') || '|' || toks[i] || '|' || coalesce(CASE WHEN i < len(toks) THEN toks[i + 1] END, '')]))
        ELSE [] END AS sentence FROM t)
SELECT doc_id, CAST(len(sentence) AS BIGINT) AS n_ids, md5(array_to_string(sentence, ' ')) AS sentence_md5 FROM s"""
    q["embed_given_vectors"] = f"""
WITH src AS ({STRUCT_SRC}), t AS (SELECT row_id, unnest({tok_s}) AS word FROM src),
v AS (SELECT row_id, sum(length(word)) AS v0, sum(ascii(word)) AS v1, sum(ascii(reverse(word))) AS v2 FROM t GROUP BY row_id)
SELECT src.row_id, coalesce(v.v0 <> 0 OR v.v1 <> 0 OR v.v2 <> 0, false) AS is_valid,
       round(CAST(v.v0 AS DOUBLE), 6) AS v0, round(CAST(v.v1 AS DOUBLE), 6) AS v1, round(CAST(v.v2 AS DOUBLE), 6) AS v2
FROM src LEFT JOIN v USING (row_id)"""
    q["invalid_structures"] = f"SELECT row_id, smiles FROM ({profile_sql()}) WHERE NOT is_valid"
    q["clean_documents"] = """
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5 FROM (
  SELECT doc_id, CASE WHEN trim(replace(text, chr(160), '')) = 'nan' THEN NULL
                      ELSE trim(replace(text, chr(160), '')) END AS t FROM documents)"""
    q["dedup_summary"] = """
SELECT count(*) AS n_rows, count(DISTINCT lower(p_name)) + max(CAST(p_name IS NULL AS INTEGER)) AS n_kept,
       count(*) - (count(DISTINCT lower(p_name)) + max(CAST(p_name IS NULL AS INTEGER))) AS n_dropped FROM part"""
    q["scale_quantile"] = """
WITH y AS (SELECT c_custkey, c_acctbal AS y FROM customer WHERE c_acctbal IS NOT NULL AND NOT isnan(c_acctbal)),
s AS (SELECT y, row_number() OVER (ORDER BY y) - 1 AS k FROM y),
n AS (SELECT count(*) AS n, least(1000, count(*)) AS nq FROM y),
refs AS (SELECT range AS j, CASE WHEN range = nq - 1 THEN 1.0 ELSE range * (1.0 / (nq - 1)) END AS r, n
         FROM n, range(0, (SELECT nq FROM n))),
pos AS (SELECT j, r, r * (n - 1) AS h FROM refs),
qs AS (SELECT pos.j, pos.r, lo.y + (hi.y - lo.y) * (pos.h - floor(pos.h)) AS q
       FROM pos JOIN s lo ON lo.k = floor(pos.h) JOIN s hi ON hi.k = ceil(pos.h)),
qq AS (SELECT j, r, q, lead(q) OVER (ORDER BY j) AS q1, lead(r) OVER (ORDER BY j) AS r1,
              lag(q) OVER (ORDER BY j) AS q0, lag(r) OVER (ORDER BY j) AS r0 FROM qs),
up AS (SELECT y.c_custkey, y.y, max(qs.j) AS j FROM y JOIN qs ON qs.q <= y.y GROUP BY y.c_custkey, y.y),
dn AS (SELECT y.c_custkey, min(qs.j) AS j FROM y JOIN qs ON qs.q >= y.y GROUP BY y.c_custkey),
v AS (SELECT up.c_custkey,
        CASE WHEN a.q1 IS NULL THEN a.r ELSE ((a.r1 - a.r) / (a.q1 - a.q)) * (up.y - a.q) + a.r END AS inc,
        CASE WHEN b.q0 IS NULL THEN b.r ELSE b.r - ((b.r - b.r0) / (b.q - b.q0)) * (b.q - up.y) END AS dec
      FROM up JOIN qq a ON a.j = up.j JOIN dn USING (c_custkey) JOIN qq b ON b.j = dn.j)
SELECT c_custkey, round(least(greatest(0.5 * (inc + dec), 0.0), 1.0), 6) AS scaled FROM v"""
    return q
