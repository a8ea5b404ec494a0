"""DuckDB SQL oracles, one per registered query (same column names)."""

from __future__ import annotations

PAIR = """
li AS (
  SELECT l_quantity, l_extendedprice, l_extendedprice * (1.0 - l_discount) AS net_price,
         l_discount, l_tax, l_linenumber, l_returnflag, l_linestatus,
         (('0x' || substr(md5(CAST(l_orderkey AS VARCHAR)), 1, 13))::BIGINT % 2)::INTEGER AS src
  FROM lineitem)"""

#: All rows of lineitem as one table (src 0).
PAIR_WHOLE = """
li AS (
  SELECT l_quantity, l_extendedprice, l_extendedprice * (1.0 - l_discount) AS net_price,
         l_discount, l_tax, l_linenumber, l_returnflag, l_linestatus, 0 AS src
  FROM lineitem)"""

NUM_COLS = ["l_quantity", "l_extendedprice", "net_price"]
CAT_COLS = ["l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus"]


def _long_num(src_table: str = "li", cols=NUM_COLS, extra: str = "src") -> str:
    return " UNION ALL ".join(
        f"SELECT {extra}, '{c}' AS col, CAST({c} AS DOUBLE) AS v FROM {src_table} WHERE {c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE))"
        for c in cols)


def _long_cat(src_table: str = "li", cols=CAT_COLS, keep_null: bool = True, extra: str = "src") -> str:
    val = (lambda c: f"coalesce(CAST({c} AS VARCHAR), 'nan')") if keep_null else (lambda c: f"CAST({c} AS VARCHAR)")
    where = (lambda c: "") if keep_null else (lambda c: f" WHERE {c} IS NOT NULL")
    return " UNION ALL ".join(f"SELECT {extra}, '{c}' AS col, {val(c)} AS v FROM {src_table}{where(c)}" for c in cols)


def r6(expr: str) -> str:
    return f"(round(CAST({expr} AS DOUBLE), 6) + 0.0)"


NUM_CDF = f"""
lnum AS ({_long_num()}),
vc AS (SELECT col, v, sum(CASE WHEN src = 0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN src = 1 THEN 1 ELSE 0 END) AS b
       FROM lnum GROUP BY col, v),
cdf AS (SELECT col, v, a, b,
               sum(a) OVER (PARTITION BY col ORDER BY v) AS cum_a, sum(b) OVER (PARTITION BY col ORDER BY v) AS cum_b,
               sum(a) OVER (PARTITION BY col) AS na, sum(b) OVER (PARTITION BY col) AS nb,
               lead(v) OVER (PARTITION BY col ORDER BY v) AS next_v
        FROM vc),
cdf2 AS (SELECT *, cum_a / na AS F, cum_b / nb AS G FROM cdf),
rstd AS (SELECT col, stddev_pop(v) AS std_real FROM lnum WHERE src = 0 GROUP BY col)"""

CAT_SHARES = f"""
lcat AS ({_long_cat()}),
cvc AS (SELECT col, v, sum(CASE WHEN src = 0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN src = 1 THEN 1 ELSE 0 END) AS b
        FROM lcat GROUP BY col, v),
csh AS (SELECT col, v, a, b, a / sum(a) OVER (PARTITION BY col) AS p, b / sum(b) OVER (PARTITION BY col) AS q FROM cvc)"""

KS = f"""WITH {PAIR}, {NUM_CDF}
SELECT col AS column_name, {r6('max(abs(F - G))')} AS ks_statistic,
       CAST(max(na) AS BIGINT) AS n_real, CAST(max(nb) AS BIGINT) AS n_syn
FROM cdf2 GROUP BY col HAVING max(na) >= 2 AND max(nb) >= 2"""

TV = f"""WITH {PAIR}, {CAT_SHARES}
SELECT col AS column_name, {r6('0.5 * sum(abs(p - q))')} AS total_variation FROM csh GROUP BY col"""

FIDELITY_COLS = f"""WITH {PAIR}, {NUM_CDF}, {CAT_SHARES},
ks AS (SELECT col, round(max(abs(F - G)), 6) AS s FROM cdf2 GROUP BY col HAVING max(na) >= 2 AND max(nb) >= 2),
tv AS (SELECT col, round(0.5 * sum(abs(p - q)), 6) AS s FROM csh GROUP BY col),
parts AS (SELECT col, 'numerical' AS kind, 1.0 - s AS raw FROM ks UNION ALL SELECT col, 'categorical', 1.0 - s FROM tv)"""

FIDELITY_COLUMNS = FIDELITY_COLS + f"""
SELECT col AS column_name, kind, {r6('least(greatest(raw, 0.0), 1.0)')} AS score FROM parts"""

FIDELITY_SCORE = FIDELITY_COLS + f"""
SELECT {r6('coalesce(avg(round(least(greatest(raw, 0.0), 1.0), 6)), 0.0)')} AS fidelity_score,
       CAST(count(*) AS BIGINT) AS n_columns FROM parts"""

WASSERSTEIN = f"""WITH {PAIR}, {NUM_CDF},
w AS (SELECT col, sum(abs(F - G) * coalesce(next_v - v, 0.0)) AS w1 FROM cdf2 GROUP BY col
      HAVING max(na) >= 2 AND max(nb) >= 2)
SELECT w.col AS column_name, {r6('w1')} AS wasserstein,
       {r6('w1 / CASE WHEN std_real IS NULL OR std_real = 0 THEN 1.0 ELSE std_real END')} AS normalized_wasserstein
FROM w JOIN rstd USING (col)"""

DISTRIBUTION_SCORE = f"""WITH {PAIR}, {NUM_CDF}, {CAT_SHARES},
w AS (SELECT col, sum(abs(F - G) * coalesce(next_v - v, 0.0)) AS w1 FROM cdf2 GROUP BY col
      HAVING max(na) >= 2 AND max(nb) >= 2),
nw AS (SELECT round(w1 / CASE WHEN std_real IS NULL OR std_real = 0 THEN 1.0 ELSE std_real END, 6) AS x FROM w JOIN rstd USING (col)),
tv AS (SELECT round(0.5 * sum(abs(p - q)), 6) AS t FROM csh GROUP BY col),
parts AS (SELECT 1.0 / (1.0 + x) AS part FROM nw UNION ALL SELECT least(greatest(1.0 - t, 0.0), 1.0) FROM tv)
SELECT {r6('coalesce(avg(part), 0.0)')} AS distribution_score, CAST(count(*) AS BIGINT) AS n_parts FROM parts"""

QUANTILE_ERROR = f"""WITH {PAIR}, lnum AS ({_long_num()}),
q AS (SELECT col,
             quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) FILTER (WHERE src = 0) AS qr,
             quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) FILTER (WHERE src = 1) AS qs,
             stddev_pop(v) FILTER (WHERE src = 0) AS sd,
             count(*) FILTER (WHERE src = 0) AS na, count(*) FILTER (WHERE src = 1) AS nb
      FROM lnum GROUP BY col),
e AS (SELECT col, sd, unnest(qr) AS a, unnest(qs) AS b FROM q WHERE na >= 2 AND nb >= 2)
SELECT col AS column_name, {r6('avg(abs(a - b)) / CASE WHEN max(sd) IS NULL OR max(sd) = 0 THEN 1.0 ELSE max(sd) END')} AS quantile_error
FROM e GROUP BY col"""

HISTOGRAM_OVERLAP = f"""WITH {PAIR}, lnum AS ({_long_num()}),
rng AS (SELECT col, min(v) AS lo, max(v) AS hi, sum(1 - src) AS na, sum(src) AS nb FROM lnum GROUP BY col
        HAVING sum(1 - src) >= 2 AND sum(src) >= 2),
b AS (SELECT l.col, l.src, least(floor((l.v - r.lo) * (10.0 / (r.hi - r.lo))), 9) AS bin, r.na, r.nb
      FROM lnum l JOIN rng r USING (col) WHERE r.hi > r.lo),
c AS (SELECT col, bin, sum(1 - src) AS a, sum(src) AS bb, max(na) AS na, max(nb) AS nb FROM b GROUP BY col, bin),
o AS (SELECT col, sum(least(a / na, bb / nb)) AS ov FROM c GROUP BY col
      UNION ALL SELECT col, 1.0 FROM rng WHERE hi <= lo)
SELECT col AS column_name, {r6('least(greatest(ov, 0.0), 1.0)')} AS histogram_overlap FROM o"""

JS = f"""WITH {PAIR},
lcat AS ({_long_cat(keep_null=False)}),
cvc AS (SELECT col, v, sum(CASE WHEN src = 0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN src = 1 THEN 1 ELSE 0 END) AS b
        FROM lcat GROUP BY col, v),
csh AS (SELECT col, v, a, b, sum(a) OVER (PARTITION BY col) AS na, sum(b) OVER (PARTITION BY col) AS nb FROM cvc),
s AS (SELECT col, v, na, nb, coalesce(a / nullif(na, 0), 0.0) AS p, coalesce(b / nullif(nb, 0), 0.0) AS q FROM csh),
agg AS (SELECT col, 0.5 * sum(abs(p - q)) AS tv,
               0.5 * sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0.0 END)
             + 0.5 * sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0.0 END) AS js,
               sum(CASE WHEN q > 0 THEN 1 ELSE 0 END) AS nq, sum(CASE WHEN p > 0 THEN 1 ELSE 0 END) AS np,
               max(na) AS na, max(nb) AS nb
        FROM s GROUP BY col)
SELECT col AS column_name, {r6('tv')} AS total_variation_distance, {r6('greatest(js, 0.0)')} AS jensen_shannon_divergence,
       {r6('nq / greatest(np, 1)')} AS category_coverage
FROM agg WHERE na > 0 AND nb > 0"""


def _pearson_pairs(table: str, cols, where: str = "") -> str:
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(
                f"SELECT '{a}' AS a, '{b}' AS b, covar_pop({a}, {b}) AS c, "
                f"stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) AS sx, "
                f"stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END) AS sy FROM {table} {where}")
    return " UNION ALL ".join(parts)


CORRELATION_SCORE = f"""WITH {PAIR},
r AS ({_pearson_pairs('li', NUM_COLS, 'WHERE src = 0')}),
s AS ({_pearson_pairs('li', NUM_COLS, 'WHERE src = 1')}),
rr AS (SELECT a, b, CASE WHEN sx * sy > 0 THEN c / (sx * sy) ELSE 0.0 END AS rho FROM r),
ss AS (SELECT a, b, CASE WHEN sx * sy > 0 THEN c / (sx * sy) ELSE 0.0 END AS rho FROM s)
SELECT {r6('least(greatest(1.0 - avg(abs(rr.rho - ss.rho)), 0.0), 1.0)')} AS correlation_score,
       CAST(count(*) AS BIGINT) AS n_pairs, 'computed' AS status
FROM rr JOIN ss USING (a, b)"""

DIVERSITY = f"""WITH {PAIR},
syn AS (SELECT * EXCLUDE (src) FROM li WHERE src = 1),
u AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT * FROM syn)) / (SELECT count(*) FROM syn) AS unique_ratio),
lc AS ({_long_cat(keep_null=False)}),
cr AS (SELECT DISTINCT col, v FROM lc WHERE src = 0), cs AS (SELECT DISTINCT col, v FROM lc WHERE src = 1),
inter AS (SELECT col, count(*) AS k FROM cr JOIN cs USING (col, v) GROUP BY col),
pc AS (SELECT col, count(*) AS nr FROM cr GROUP BY col),
cc AS (SELECT coalesce(avg(coalesce(k, 0) / nr), 1.0) AS category_coverage FROM pc LEFT JOIN inter USING (col)),
ln AS ({_long_num()}),
mm AS (SELECT col, min(v) FILTER (WHERE src = 0) AS rlo, max(v) FILTER (WHERE src = 0) AS rhi,
              min(v) FILTER (WHERE src = 1) AS slo, max(v) FILTER (WHERE src = 1) AS shi FROM ln GROUP BY col),
rc AS (SELECT coalesce(avg(least(greatest(coalesce(least(rhi, shi) - greatest(rlo, slo), 0.0) / (rhi - rlo), 0.0), 1.0)), 1.0)
              AS range_coverage FROM mm WHERE rhi - rlo > 0)
SELECT {r6('(unique_ratio + category_coverage + range_coverage) / 3')} AS diversity_score,
       {r6('unique_ratio')} AS unique_ratio, {r6('category_coverage')} AS category_coverage,
       {r6('range_coverage')} AS range_coverage
FROM u, cc, rc"""

ORACLE: dict[str, str] = {
    "f1_ks_statistic": KS,
    "f2_total_variation": TV,
    "f3_fidelity_columns": FIDELITY_COLUMNS,
    "f3_fidelity_score": FIDELITY_SCORE,
    "f4_wasserstein": WASSERSTEIN,
    "f4_distribution_score": DISTRIBUTION_SCORE,
    "f5_quantile_error": QUANTILE_ERROR,
    "f6_histogram_overlap": HISTOGRAM_OVERLAP,
    "f7_js_divergence": JS,
    "f8_correlation_score": CORRELATION_SCORE,
    "f9_diversity_score": DIVERSITY,
}


# ---- profile (P) and sizing (N) ---------------------------------------------

from tabvet.plans import oracle_profile as op  # noqa: E402

ORACLE.update({
    "p1_dataset_summary_orders": op.dataset_summary_sql("orders"),
    "p1_dataset_summary_lineitem": op.dataset_summary_sql("lineitem"),
    "p2_missing_profile_orders": op.missing_profile_sql("orders"),
    "p4_unique_counts_lineitem": op.unique_counts_sql("lineitem"),
    "p5_column_kinds_lineitem": op.column_kinds_sql("lineitem"),
    "p5_column_kinds_orders": op.column_kinds_sql("orders"),
    "p6_semantic_types_orders": op.semantic_types_sql("orders"),
    "p6_semantic_types_customer": op.semantic_types_sql("customer"),
    "p6_semantic_types_lineitem": op.semantic_types_sql("lineitem"),
    "p6_semantic_types_documents": op.semantic_types_sql("documents"),
    "p6_semantic_types_events": op.semantic_types_sql("events"),
    "p6_semantic_types_labeled_docs": op.semantic_types_sql("labeled_docs", target="quality"),
    "p7_numeric_stats_lineitem": op.numeric_stats_sql(
        "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]),
    "p8_top_categories_orders": op.top_categories_sql("orders", ["o_orderstatus", "o_orderdate", "o_orderpriority"]),
    "p9_correlations_lineitem": op.correlations_sql(
        "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]),
    "p10_class_distribution_labels": op.class_distribution_sql("labels", "quality"),
    "p11_low_cardinality_lineitem": op.low_cardinality_sql("lineitem"),
    "p13_infer_task_labeled_docs": op.infer_task_sql("labeled_docs", "quality"),
    "p13_infer_task_lineitem": op.infer_task_sql("lineitem", "l_extendedprice"),
    "p14_detect_issues_orders": op.detect_issues_sql("orders"),
    "p14_detect_issues_labeled_docs": op.detect_issues_sql("labeled_docs", "quality"),
    "p14_detect_issues_supplier": op.detect_issues_sql("supplier"),
    "p15_sdtypes_orders": op.sdtypes_sql("orders"),
    "p15_sdtypes_customer": op.sdtypes_sql("customer"),
    "p15_sdtypes_labeled_docs": op.sdtypes_sql("labeled_docs"),
    "n1_plan_labeled_docs": op.plan_sql_minority("labeled_docs", "quality"),
    "n1_plan_labeled_docs_by_lang": op.plan_sql_minority("labeled_docs", "quality", by="lang"),
    "n2_plan_supplier": op.plan_sql_small("supplier"),
})

ORACLE.update({
    "c1_discover_constraints_all": op.constraints_discover_sql("lineitem"),
    "c1_discover_constraints": op.constraints_discover_sql("lineitem_real"),
    "c2_constraint_violations": op.constraint_violations_sql("lineitem_real", "lineitem_syn"),
    "c3_validity_score": op.validity_sql("lineitem_real", "lineitem_syn"),
})


# ---- dependency (D1-D8) -----------------------------------------------------

def _sim(diffs: str, name: str) -> str:
    return (f"SELECT CASE WHEN count(*) > 0 THEN round(least(greatest(1.0 - avg(d), 0.0), 1.0), 6) + 0.0 END AS {name}, "
            f"CAST(count(*) AS BIGINT) AS n_pairs FROM ({diffs})")


PEARSON_SIM = f"""WITH {PAIR},
r AS ({_pearson_pairs('li', NUM_COLS, 'WHERE src = 0')}), s AS ({_pearson_pairs('li', NUM_COLS, 'WHERE src = 1')}),
rr AS (SELECT a, b, CASE WHEN sx * sy > 0 THEN c / (sx * sy) ELSE 0.0 END AS rho FROM r),
ss AS (SELECT a, b, CASE WHEN sx * sy > 0 THEN c / (sx * sy) ELSE 0.0 END AS rho FROM s)
{_sim('SELECT abs(rr.rho - ss.rho) AS d FROM rr JOIN ss USING (a, b)', 'pearson_similarity')}"""

_RANKS = "ranked AS (SELECT src, " + ", ".join(
    f"rank() OVER (PARTITION BY src ORDER BY {c}) + (count(*) OVER (PARTITION BY src, {c}) - 1) / 2.0 AS {c}"
    for c in NUM_COLS) + " FROM li)"

SPEARMAN_PAIRS = f"""WITH {PAIR}, {_RANKS},
r AS ({_pearson_pairs('ranked', NUM_COLS, 'WHERE src = 0')})
SELECT a, b, round(CASE WHEN sx * sy > 0 THEN c / (sx * sy) ELSE 0.0 END, 6) AS rho FROM r"""

SPEARMAN_SIM = f"""WITH {PAIR}, {_RANKS},
r AS ({_pearson_pairs('ranked', NUM_COLS, 'WHERE src = 0')}), s AS ({_pearson_pairs('ranked', NUM_COLS, 'WHERE src = 1')}),
rr AS (SELECT a, b, CASE WHEN sx * sy > 0 THEN c / (sx * sy) ELSE 0.0 END AS rho FROM r),
ss AS (SELECT a, b, CASE WHEN sx * sy > 0 THEN c / (sx * sy) ELSE 0.0 END AS rho FROM s)
{_sim('SELECT abs(rr.rho - ss.rho) AS d FROM rr JOIN ss USING (a, b)', 'spearman_similarity')}"""


def _cramers(where: str) -> str:
    cells = " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, coalesce(CAST({a} AS VARCHAR), 'nan') AS va, "
        f"coalesce(CAST({b} AS VARCHAR), 'nan') AS vb, count(*) AS n FROM li WHERE {where} GROUP BY 3, 4"
        for i, a in enumerate(CAT_COLS) for b in CAT_COLS[i + 1:])
    return f"""(SELECT a, b, CASE WHEN r < 2 OR c < 2 THEN 0.0 ELSE sqrt(greatest(s - 1, 0.0) / (least(r, c) - 1)) END AS v
  FROM (SELECT cl.a, cl.b, sum(cl.n * cl.n / (R.R * C.C)) AS s, count(DISTINCT cl.va) AS r, count(DISTINCT cl.vb) AS c
        FROM ({cells}) cl
        JOIN (SELECT a, b, va, sum(n) AS R FROM ({cells}) GROUP BY a, b, va) R USING (a, b, va)
        JOIN (SELECT a, b, vb, sum(n) AS C FROM ({cells}) GROUP BY a, b, vb) C USING (a, b, vb)
        GROUP BY cl.a, cl.b))"""


CRAMERS = f"WITH {PAIR} SELECT a, b, round({'v'}, 6) + 0.0 AS cramers_v FROM {_cramers('src = 0')}"
CAT_DEP_SIM = f"""WITH {PAIR}, vr AS {_cramers('src = 0')}, vs AS {_cramers('src = 1')}
{_sim('SELECT abs(round(vr.v, 6) - round(vs.v, 6)) AS d FROM vr JOIN vs USING (a, b)', 'categorical_dependency_similarity')}"""


def _eta(where: str) -> str:
    long = " UNION ALL ".join(
        f"SELECT '{n}' AS num, '{c}' AS cat, coalesce(CAST({c} AS VARCHAR), 'nan') AS g, CAST({n} AS DOUBLE) AS x "
        f"FROM li WHERE {where} AND {n} IS NOT NULL" for n in NUM_COLS for c in CAT_COLS)
    return f"""(SELECT num, cat, CASE WHEN levels < 2 OR n * vp <= 0 THEN 0.0 ELSE sqrt(ssb / (n * vp)) END AS eta
  FROM (SELECT g.num, g.cat, sum(g.ng * (g.mg - t.m) * (g.mg - t.m)) AS ssb, count(*) AS levels, max(t.n) AS n, max(t.vp) AS vp
        FROM (SELECT num, cat, g, count(*) AS ng, avg(x) AS mg FROM ({long}) GROUP BY 1, 2, 3) g
        JOIN (SELECT num, cat, count(*) AS n, avg(x) AS m, var_pop(x) AS vp FROM ({long}) GROUP BY 1, 2) t USING (num, cat)
        GROUP BY g.num, g.cat))"""


ETA = f"WITH {PAIR} SELECT num, cat, round(eta, 6) + 0.0 AS eta FROM {_eta('src = 0')}"
MIXED_SIM = f"""WITH {PAIR}, er AS {_eta('src = 0')}, es AS {_eta('src = 1')}
{_sim('SELECT abs(round(er.eta, 6) - round(es.eta, 6)) AS d FROM er JOIN es USING (num, cat)', 'mixed_dependency_similarity')}"""


DEPENDENCY = f"""WITH {PAIR},
r AS ({_pearson_pairs('li', NUM_COLS, 'WHERE src = 0')}), s AS ({_pearson_pairs('li', NUM_COLS, 'WHERE src = 1')}),
rr AS (SELECT a, b, CASE WHEN sx * sy > 0 THEN c / (sx * sy) ELSE 0.0 END AS rho FROM r),
ss AS (SELECT a, b, CASE WHEN sx * sy > 0 THEN c / (sx * sy) ELSE 0.0 END AS rho FROM s),
{_RANKS},
r2 AS ({_pearson_pairs('ranked', NUM_COLS, 'WHERE src = 0')}), s2 AS ({_pearson_pairs('ranked', NUM_COLS, 'WHERE src = 1')}),
rr2 AS (SELECT a, b, CASE WHEN sx * sy > 0 THEN c / (sx * sy) ELSE 0.0 END AS rho FROM r2),
ss2 AS (SELECT a, b, CASE WHEN sx * sy > 0 THEN c / (sx * sy) ELSE 0.0 END AS rho FROM s2),
vr AS {_cramers('src = 0')}, vs AS {_cramers('src = 1')}, er AS {_eta('src = 0')}, es AS {_eta('src = 1')},
parts AS (
  SELECT 'pearson_similarity' AS part, round(least(greatest(1.0 - avg(abs(rr.rho - ss.rho)), 0.0), 1.0), 6) + 0.0 AS value FROM rr JOIN ss USING (a, b)
  UNION ALL SELECT 'spearman_similarity', round(least(greatest(1.0 - avg(abs(rr2.rho - ss2.rho)), 0.0), 1.0), 6) + 0.0 FROM rr2 JOIN ss2 USING (a, b)
  UNION ALL SELECT 'categorical_dependency_similarity', round(least(greatest(1.0 - avg(abs(round(vr.v, 6) - round(vs.v, 6))), 0.0), 1.0), 6) + 0.0 FROM vr JOIN vs USING (a, b)
  UNION ALL SELECT 'mixed_dependency_similarity', round(least(greatest(1.0 - avg(abs(round(er.eta, 6) - round(es.eta, 6))), 0.0), 1.0), 6) + 0.0 FROM er JOIN es USING (num, cat))
SELECT part, value, 'computed' AS status FROM parts
UNION ALL SELECT 'overall_dependency_score', round(avg(value), 6) + 0.0, 'computed' FROM parts"""

_ROWKEY = "concat_ws(chr(31), " + ", ".join(
    [f"coalesce(CAST(CAST(round(CAST({c} AS DOUBLE) * 1000000.0) AS BIGINT) AS VARCHAR), 'nan')"
     for c in ["l_quantity", "l_extendedprice", "net_price", "l_discount", "l_tax"]]
    + ["coalesce(CAST(l_linenumber AS VARCHAR), 'nan')", "coalesce(l_returnflag, 'nan')", "coalesce(l_linestatus, 'nan')"]) + ")"

BALANCED = f"""WITH {PAIR},
k AS (SELECT least(500, (SELECT count(*) FROM li WHERE src = 0), (SELECT count(*) FROM li WHERE src = 1)) AS k),
u AS (SELECT *, ('0x' || substr(md5('42:sample:' || {_ROWKEY}), 1, 13))::BIGINT AS h FROM li),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY h, l_quantity, l_extendedprice, net_price, l_discount, l_tax,
                                   l_linenumber, l_returnflag, l_linestatus) AS rn FROM u)
SELECT l_quantity, l_extendedprice, net_price, l_discount, l_tax, l_linenumber, l_returnflag, l_linestatus, src
FROM r WHERE rn <= (SELECT k FROM k)"""

ORACLE.update({
    "d1_pearson_similarity": PEARSON_SIM,
    "d2_spearman_pairs": SPEARMAN_PAIRS,
    **{f"{k}_all": q.replace(PAIR, PAIR_WHOLE) for k, q in (("d2_spearman_pairs", SPEARMAN_PAIRS), ("d3_cramers_v", CRAMERS), ("d5_correlation_ratio", ETA))},
    "d2_spearman_similarity": SPEARMAN_SIM,
    "d3_cramers_v": CRAMERS,
    "d4_categorical_dependency_similarity": CAT_DEP_SIM,
    "d5_correlation_ratio": ETA,
    "d6_mixed_dependency_similarity": MIXED_SIM,
    "d7_dependency_similarity": DEPENDENCY,
    "d8_balanced_samples": BALANCED,
})


# ---- privacy (V) ------------------------------------------------------------

_ALL = ["l_quantity", "l_extendedprice", "net_price", "l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus"]
_COLS = ", ".join(_ALL)


def _md5u(seed_tag: str, key: str) -> str:
    return f"('0x' || substr(md5('{seed_tag}:' || {key}), 1, 13))::BIGINT"


def _micro(c: str) -> str:
    return f"coalesce(CAST(CAST(round(CAST({c} AS DOUBLE) * 1000000.0) AS BIGINT) AS VARCHAR), 'nan')"


def _vc(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR), 'nan')"


EXACT_MATCH = f"""WITH {PAIR},
r AS (SELECT DISTINCT {_COLS} FROM li WHERE src = 0),
s AS (SELECT {_COLS}, count(*) AS m FROM li WHERE src = 1 GROUP BY {_COLS}),
hit AS (SELECT coalesce(sum(m), 0) AS matched FROM s WHERE EXISTS (
          SELECT 1 FROM r WHERE {' AND '.join(f'r.{c} IS NOT DISTINCT FROM s.{c}' for c in _ALL)})),
tot AS (SELECT count(*) AS n FROM li WHERE src = 1)
SELECT round(CASE WHEN n > 0 THEN matched / n ELSE 0.0 END, 6) + 0.0 AS exact_duplicate_rate,
       CAST(matched AS BIGINT) AS matched_rows, CAST(n AS BIGINT) AS synthetic_rows FROM hit, tot"""

_NUMS = NUM_COLS
_CATS = CAT_COLS
_REAL_KEY = "concat_ws(chr(31), " + ", ".join([_micro(c) for c in _NUMS] + [_vc(c) for c in _CATS]) + ")"
_SYN_KEY = "concat_ws(chr(31), " + ", ".join([_micro(c) for c in _NUMS + ["l_discount", "l_tax"]]
                                              + [_vc(c) for c in ["l_linenumber", "l_returnflag", "l_linestatus"]]) + ")"
_GOWER = "(" + " + ".join(
    [f"CASE WHEN s.{c} IS NOT NULL AND o.{c} IS NOT NULL THEN abs(s.{c} - o.{c}) / sp.{c} ELSE 0.0 END" for c in _NUMS]
    + [f"CASE WHEN coalesce(CAST(s.{c} AS VARCHAR), 'None') = coalesce(CAST(o.{c} AS VARCHAR), 'None') THEN 0.0 ELSE 1.0 END"
       for c in _CATS]) + ") / (" + " + ".join(
    [f"CASE WHEN s.{c} IS NOT NULL AND o.{c} IS NOT NULL THEN 1 ELSE 0 END" for c in _NUMS] + [str(len(_CATS))]) + ")"

NEAR_CTE = f"""real AS (SELECT {_COLS} FROM li WHERE src = 0), syn AS (SELECT {_COLS} FROM li WHERE src = 1),
sp AS (SELECT {', '.join(f"coalesce(nullif(max({c}) - min({c}), 0), 1.0) AS {c}" for c in _NUMS)} FROM real),
rs AS (SELECT * FROM (SELECT *, {_md5u('42:near_real', _REAL_KEY)} AS h FROM real)
       ORDER BY h, {', '.join(_NUMS)}, {', '.join(f'CAST({c} AS VARCHAR)' for c in _CATS)} LIMIT 200),
np AS (SELECT least(80, (SELECT count(*) FROM syn), (SELECT count(*) FROM real)) AS k),
ss AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY h, {_COLS}) AS id FROM
         (SELECT *, {_md5u('42:near_syn', _SYN_KEY)} AS h FROM syn)) WHERE id <= (SELECT k FROM np)),
best AS (SELECT s.id, min({_GOWER}) AS d FROM ss s, rs o, sp GROUP BY s.id),
near AS (SELECT round(CASE WHEN count(*) > 0 THEN avg(CASE WHEN d < 0.05 THEN 1.0 ELSE 0.0 END) ELSE 0.0 END, 6) + 0.0
                  AS high_similarity_rate,
                CAST(count(*) FILTER (WHERE d < 0.05) AS BIGINT) AS close_rows, CAST(count(*) AS BIGINT) AS probed_rows
         FROM best)"""

NEAR_MATCH = f"WITH {PAIR}, {NEAR_CTE} SELECT * FROM near"

PRIVACY_SCORE = f"""WITH {PAIR}, {NEAR_CTE},
r0 AS (SELECT DISTINCT {_COLS} FROM li WHERE src = 0),
s0 AS (SELECT {_COLS}, count(*) AS m FROM li WHERE src = 1 GROUP BY {_COLS}),
hit AS (SELECT coalesce(sum(m), 0) AS matched FROM s0 WHERE EXISTS (
          SELECT 1 FROM r0 WHERE {' AND '.join(f'r0.{c} IS NOT DISTINCT FROM s0.{c}' for c in _ALL)})),
dup AS (SELECT round(matched / (SELECT count(*) FROM li WHERE src = 1), 6) + 0.0 AS exact_duplicate_rate FROM hit)
SELECT round(least(greatest(1.0 - 0.7 * exact_duplicate_rate - 0.3 * high_similarity_rate, 0.0), 1.0), 6) + 0.0 AS privacy_score,
       exact_duplicate_rate, high_similarity_rate,
       round(exact_duplicate_rate + 0.5 * high_similarity_rate, 6) + 0.0 AS membership_risk_indicator,
       CASE WHEN exact_duplicate_rate + 0.5 * high_similarity_rate >= 0.20 THEN 'HIGH'
            WHEN exact_duplicate_rate + 0.5 * high_similarity_rate >= 0.08 THEN 'MEDIUM' ELSE 'LOW' END AS privacy_risk_level
FROM dup, near"""

# Every synthetic row against every real row. One differing category alone costs 1/8, so close rows agree on all of them.
NEAR_ALL_CTE = f"""real AS (SELECT {_COLS} FROM li WHERE src = 0), syn AS (SELECT row_number() OVER () AS id, {_COLS} FROM li WHERE src = 1),
sp AS (SELECT {', '.join(f"coalesce(nullif(max({c}) - min({c}), 0), 1.0) AS {c}" for c in _NUMS)} FROM real),
best AS (SELECT s.id, min({_GOWER}) AS d FROM syn s JOIN real o
           ON {' AND '.join(f"coalesce(CAST(s.{c} AS VARCHAR), 'None') = coalesce(CAST(o.{c} AS VARCHAR), 'None')" for c in _CATS)}
         CROSS JOIN sp GROUP BY s.id),
near AS (SELECT round(CASE WHEN t.n > 0 THEN count(*) FILTER (WHERE d < 0.05) / t.n ELSE 0.0 END, 6) + 0.0 AS high_similarity_rate,
                CAST(count(*) FILTER (WHERE d < 0.05) AS BIGINT) AS close_rows, CAST(t.n AS BIGINT) AS probed_rows
         FROM best RIGHT JOIN (SELECT count(*) AS n FROM syn) t ON TRUE GROUP BY t.n)"""
NEAR_MATCH_ALL = f"WITH {PAIR}, {NEAR_ALL_CTE} SELECT * FROM near"
PRIVACY_SCORE_ALL = PRIVACY_SCORE.replace(NEAR_CTE, NEAR_ALL_CTE)

THIRDS = """
li3 AS (
  SELECT l_quantity, l_extendedprice, l_extendedprice * (1.0 - l_discount) AS net_price,
         l_discount, l_tax, l_linenumber, l_returnflag, l_linestatus,
         (('0x' || substr(md5(CAST(l_orderkey AS VARCHAR)), 1, 13))::BIGINT % 3)::INTEGER AS t
  FROM lineitem)"""
_DP_NUM = ["l_quantity", "l_extendedprice", "net_price", "l_discount", "l_tax", "l_linenumber"]
_DP_CAT = ["l_returnflag", "l_linestatus"]
_DP_KEY = "concat_ws(chr(31), " + ", ".join([_micro(c) for c in _DP_NUM] + [_vc(c) for c in _DP_CAT]) + ")"


def _dp_sample(t: int, tag: str) -> str:
    return (f"(SELECT * FROM (SELECT {_COLS}, {_md5u('42:' + tag, _DP_KEY)} AS h FROM li3 WHERE t = {t}) "
            f"ORDER BY h, {', '.join(_DP_NUM)}, {', '.join(_DP_CAT)} LIMIT 128)")


_DP_DIST = "(" + " + ".join(
    [f"(CASE WHEN a.{c} IS NULL AND b.{c} IS NULL THEN 0.0 WHEN a.{c} IS NULL OR b.{c} IS NULL THEN 1.0 "
     f"ELSE abs(a.{c} - b.{c}) / sc.{c} END) / 8.0" for c in _DP_NUM]
    + [f"(CASE WHEN coalesce(a.{c}, 'None') = coalesce(b.{c}, 'None') THEN 0.0 ELSE 1.0 END) / 8.0" for c in _DP_CAT]) + ")"

DISTANCE_PRIVACY = f"""WITH {THIRDS},
sc AS (SELECT {', '.join(f"CASE WHEN stddev_pop({c}) > 1e-8 THEN stddev_pop({c}) ELSE 1.0 END AS {c}" for c in _DP_NUM)}
       FROM li3 WHERE t = 0),
rs AS (SELECT row_number() OVER () AS id, * FROM {_dp_sample(0, 'dp_train')}),
hs AS (SELECT row_number() OVER () AS id, * FROM {_dp_sample(1, 'dp_holdout')}),
gs AS (SELECT row_number() OVER () AS id, * FROM {_dp_sample(2, 'dp_syn')}),
to_train AS (SELECT a.id, min({_DP_DIST}) AS d FROM gs a, rs b, sc GROUP BY a.id),
to_hold AS (SELECT a.id, min({_DP_DIST}) AS d FROM gs a, hs b, sc GROUP BY a.id),
mem AS (SELECT 1 AS label, -min({_DP_DIST}) AS score FROM rs a, gs b, sc GROUP BY a.id
        UNION ALL SELECT 0, -min({_DP_DIST}) FROM hs a, gs b, sc GROUP BY a.id),
rk AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM mem),
auc AS (SELECT round((sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
              / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)), 6) + 0.0 AS distance_attack_auc FROM rk),
tr AS (SELECT {_COLS}, count(*) AS m FROM li3 WHERE t = 2 GROUP BY {_COLS}),
r0 AS (SELECT DISTINCT {_COLS} FROM li3 WHERE t = 0),
ex AS (SELECT round(coalesce(sum(m), 0) / (SELECT count(*) FROM li3 WHERE t = 2), 6) + 0.0 AS exact_training_match_rate
       FROM tr WHERE EXISTS (SELECT 1 FROM r0 WHERE {' AND '.join(f'r0.{c} IS NOT DISTINCT FROM tr.{c}' for c in _ALL)}))
SELECT exact_training_match_rate,
       (SELECT round(avg(CASE WHEN d < 0.01 THEN 1.0 ELSE 0.0 END), 6) + 0.0 FROM to_train) AS near_training_match_rate,
       (SELECT round(median(d), 6) + 0.0 FROM to_train) AS median_distance_to_train,
       (SELECT round(median(d), 6) + 0.0 FROM to_hold) AS median_distance_to_holdout,
       distance_attack_auc,
       (SELECT CAST(count(*) AS BIGINT) FROM rs) AS train_sample_count,
       (SELECT CAST(count(*) AS BIGINT) FROM hs) AS holdout_sample_count,
       CAST(128 AS BIGINT) AS sample_cap
FROM ex, auc"""

def _dp_all(t: int) -> str:
    return f"(SELECT row_number() OVER () AS id, {_COLS} FROM li3 WHERE t = {t})"


DISTANCE_PRIVACY_ALL = DISTANCE_PRIVACY
for _t, _tag in ((0, "dp_train"), (1, "dp_holdout"), (2, "dp_syn")):
    DISTANCE_PRIVACY_ALL = DISTANCE_PRIVACY_ALL.replace(f"(SELECT row_number() OVER () AS id, * FROM {_dp_sample(_t, _tag)})", _dp_all(_t))
DISTANCE_PRIVACY_ALL = (DISTANCE_PRIVACY_ALL.replace("AS train_sample_count", "AS train_rows").replace("AS holdout_sample_count,", "AS holdout_rows")
                        .replace("       CAST(128 AS BIGINT) AS sample_cap\n", ""))

ORACLE.update({
    "v2_near_match_rate_all": NEAR_MATCH_ALL,
    "v3_privacy_score_all": PRIVACY_SCORE_ALL,
    "v4_distance_privacy_all": DISTANCE_PRIVACY_ALL,
    "v1_exact_match_rate": EXACT_MATCH,
    "v2_near_match_rate": NEAR_MATCH,
    "v3_privacy_score": PRIVACY_SCORE,
    "v4_distance_privacy": DISTANCE_PRIVACY,
})


# ---- splits and prediction metrics (U) --------------------------------------

LABELED = "(SELECT l.doc_id, l.quality, l.toxic, d.lang, d.source, d.n_chars FROM labels l JOIN documents d USING (doc_id))"


def _split_sql(src: str, key: str, stratum: str, test: float, validation: float, seed: int, out_cols: str) -> str:
    def alloc(name, frame, frac):
        return f"""
c_{name} AS (SELECT s, count(*) AS n FROM {frame} GROUP BY s),
t_{name} AS (SELECT sum(n) AS total, CAST(ceil(CAST({frac} AS DOUBLE) * CAST(sum(n) AS DOUBLE)) AS BIGINT) AS take FROM c_{name}),
e_{name} AS (SELECT s, CAST(n AS DOUBLE) * take / total AS ex, floor(CAST(n AS DOUBLE) * take / total) AS fl FROM c_{name}, t_{name}),
a_{name} AS (SELECT s, fl + CASE WHEN row_number() OVER (ORDER BY ex - fl DESC, s)
                  <= (SELECT take FROM t_{name}) - (SELECT sum(fl) FROM e_{name}) THEN 1 ELSE 0 END AS alloc FROM e_{name})"""
    return f"""WITH k AS (SELECT *, {stratum} AS s, {_md5u(f'{seed}:split_test', key)} AS h1,
                    {_md5u(f'{seed + 1}:split_validation', key)} AS h2 FROM {src}),
{alloc('t', 'k', test)},
r1 AS (SELECT k.*, row_number() OVER (PARTITION BY s ORDER BY h1) - 1 AS rk FROM k),
m1 AS (SELECT r1.*, rk < alloc AS is_test FROM r1 JOIN a_t USING (s)),
dev AS (SELECT * FROM m1 WHERE NOT is_test),
{alloc('v', 'dev', validation)},
r2 AS (SELECT dev.*, row_number() OVER (PARTITION BY s ORDER BY h2) - 1 AS rk2 FROM dev),
m2 AS (SELECT r2.*, CASE WHEN rk2 < alloc THEN 'validation' ELSE 'train' END AS split FROM r2 JOIN a_v USING (s))
SELECT {out_cols}, split FROM m2
UNION ALL SELECT {out_cols}, 'test' FROM m1 WHERE is_test"""


_LAB_KEY = "concat_ws(chr(31), " + ", ".join(_vc(c) for c in ["doc_id", "quality", "toxic", "lang", "source", "n_chars"]) + ")"
_ORD_KEY = ("concat_ws(chr(31), " + ", ".join([_vc("o_orderkey"), _vc("o_custkey"), _vc("o_orderstatus"),
                                              _micro("o_totalprice"), "coalesce(CAST(epoch_us(o_orderdate) AS VARCHAR), 'nan')",
                                              _vc("o_orderpriority")]) + ")")
_LI_KEY = ("concat_ws(chr(31), " + ", ".join([_vc(c) for c in ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]]
                                             + [_micro(c) for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]]
                                             + [_vc("l_returnflag"), _vc("l_linestatus"),
                                                "coalesce(CAST(epoch_us(l_shipdate) AS VARCHAR), 'nan')"]) + ")")

SPLIT_LABELED = _split_sql(LABELED, _LAB_KEY, "CAST(quality AS VARCHAR)", 0.25, 0.25, 42, "doc_id")
SPLIT_UNLABELED = _split_sql("orders", _ORD_KEY, "'all'", 0.2, 0.25, 7, "o_orderkey")

TWO_WAY = f"""WITH k AS (SELECT *, CAST(l_returnflag AS VARCHAR) AS s, {_md5u('42:split_test', _LI_KEY)} AS h1 FROM lineitem),
c_t AS (SELECT s, count(*) AS n FROM k GROUP BY s),
t_t AS (SELECT sum(n) AS total, CAST(ceil(CAST(0.25 AS DOUBLE) * CAST(sum(n) AS DOUBLE)) AS BIGINT) AS take FROM c_t),
e_t AS (SELECT s, CAST(n AS DOUBLE) * take / total AS ex, floor(CAST(n AS DOUBLE) * take / total) AS fl FROM c_t, t_t),
a_t AS (SELECT s, fl + CASE WHEN row_number() OVER (ORDER BY ex - fl DESC, s)
                  <= (SELECT take FROM t_t) - (SELECT sum(fl) FROM e_t) THEN 1 ELSE 0 END AS alloc FROM e_t),
r1 AS (SELECT k.*, row_number() OVER (PARTITION BY s ORDER BY h1) - 1 AS rk FROM k)
SELECT CASE WHEN rk < alloc THEN 'test' ELSE 'train' END AS split, l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n
FROM r1 JOIN a_t USING (s) GROUP BY 1, 2, 3"""

PRED = f"(SELECT *, CAST(n_chars >= 2000 AS INTEGER) AS predicted FROM {LABELED})"


def _macro_sql(src: str, y: str, p: str, g: str, x: str = "") -> str:
    return f"""conf{x} AS (SELECT CAST({g} AS VARCHAR) AS g, CAST({y} AS VARCHAR) AS y, CAST({p} AS VARCHAR) AS p, count(*) AS n
                FROM {src} GROUP BY 1, 2, 3),
lbl{x} AS (SELECT DISTINCT g, y AS label FROM conf{x} UNION SELECT DISTINCT g, p FROM conf{x}),
per{x} AS (SELECT l.g, l.label,
               coalesce((SELECT sum(n) FROM conf{x} c WHERE c.g = l.g AND c.y = l.label AND c.p = l.label), 0) AS tp,
               coalesce((SELECT sum(n) FROM conf{x} c WHERE c.g = l.g AND c.y = l.label), 0) AS t,
               coalesce((SELECT sum(n) FROM conf{x} c WHERE c.g = l.g AND c.p = l.label), 0) AS q FROM lbl{x} l),
macro{x} AS (SELECT g, avg(CASE WHEN q > 0 THEN tp / q ELSE 0.0 END) AS prec, avg(CASE WHEN t > 0 THEN tp / t ELSE 0.0 END) AS rec,
                 avg(CASE WHEN t + q > 0 THEN 2 * tp / (t + q) ELSE 0.0 END) AS f1 FROM per{x} GROUP BY g),
acc{x} AS (SELECT g, sum(n) AS n, sum(CASE WHEN y = p THEN n ELSE 0 END) AS hit FROM conf{x} GROUP BY g)"""


def _auc_sql(src: str, label: str, score: str, g: str) -> str:
    return f"""rk AS (SELECT CAST({g} AS VARCHAR) AS g, {label} AS label,
                rank() OVER (PARTITION BY {g} ORDER BY CAST({score} AS DOUBLE))
                + (count(*) OVER (PARTITION BY {g}, {score}) - 1) / 2.0 AS r
              FROM {src} WHERE {score} IS NOT NULL AND {label} IS NOT NULL),
auc AS (SELECT g, sum(r) FILTER (WHERE label = 1) AS r1, count(*) FILTER (WHERE label = 1) AS n1,
               count(*) FILTER (WHERE label <> 1) AS n0 FROM rk GROUP BY g)"""


CLASSIFICATION = f"""WITH {_macro_sql(PRED, 'quality', 'predicted', "'all'")}, {_auc_sql(PRED, 'quality', 'n_chars', "'all'")}
SELECT round(hit / n, 6) + 0.0 AS accuracy, round(prec, 6) + 0.0 AS precision_macro, round(rec, 6) + 0.0 AS recall_macro,
       round(f1, 6) + 0.0 AS f1_macro, CAST(n AS BIGINT) AS n, round(f1, 6) + 0.0 AS primary_value,
       'f1_macro' AS primary_metric,
       round((r1 - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) + 0.0 AS roc_auc
FROM macro JOIN acc USING (g) JOIN auc USING (g)"""

PRICED = ("(SELECT l.l_quantity, l.l_extendedprice, p.p_retailprice, l.l_quantity * p.p_retailprice AS estimate "
          "FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey)")
REGRESSION = f"""WITH e AS (SELECT l_extendedprice AS y, l_extendedprice - estimate AS e FROM {PRICED}),
a AS (SELECT avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, sum(e * e) AS ss_res, var_pop(y) * count(y) AS ss_tot,
             count(*) AS n FROM e),
b AS (SELECT *, CASE WHEN ss_tot > 0 THEN 1.0 - ss_res / ss_tot WHEN ss_res = 0 THEN 1.0 ELSE 0.0 END AS r2 FROM a)
SELECT round(mae, 6) + 0.0 AS mae, round(rmse, 6) + 0.0 AS rmse, round(r2, 6) + 0.0 AS r2, CAST(n AS BIGINT) AS n,
       round(r2, 6) + 0.0 AS primary_value, 'r2' AS primary_metric FROM b"""

ROC = f"""WITH {_auc_sql(PRED, 'quality', 'n_chars', "'all'")}
SELECT CASE WHEN n1 > 0 AND n0 > 0 THEN round((r1 - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) + 0.0 END AS auc,
       CAST(n1 AS BIGINT) AS positives, CAST(n0 AS BIGINT) AS negatives FROM auc"""
ROC_BY = f"""WITH {_auc_sql(PRED, 'quality', 'n_chars', 'lang')}
SELECT g AS "group", CASE WHEN n1 > 0 AND n0 > 0 THEN round((r1 - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) + 0.0 END AS auc,
       CAST(n1 AS BIGINT) AS positives, CAST(n0 AS BIGINT) AS negatives FROM auc"""

FAIRNESS = f"""WITH {_macro_sql(PRED, 'quality', 'predicted', 'lang')},
gap AS (SELECT CASE WHEN count(*) >= 2 THEN max(f1) - min(f1) END AS max_gap FROM macro)
SELECT g AS "group", CAST(n AS DOUBLE) AS n, round(f1, 6) + 0.0 AS f1, round(prec, 6) + 0.0 AS precision,
       round(rec, 6) + 0.0 AS recall, round(max_gap, 6) + 0.0 AS max_gap
FROM macro JOIN acc USING (g), gap"""

PRED_ALT = f"(SELECT *, toxic AS alt FROM {PRED})"
_m1 = _macro_sql(PRED_ALT, 'quality', 'predicted', 'lang')
_m2 = _macro_sql(PRED_ALT, "quality", "alt", "lang", "2")
IMPROVEMENT = f"""WITH {_m1}, {_m2}
SELECT m.g AS "group", round(m.f1, 6) + 0.0 AS baseline, round(m2.f1, 6) + 0.0 AS augmented,
       round((round(m2.f1, 6) - round(m.f1, 6)) / CASE WHEN round(m.f1, 6) = 0 THEN 1.0 ELSE abs(round(m.f1, 6)) END, 6) + 0.0 AS improvement
FROM macro m JOIN macro2 m2 USING (g)"""

ORACLE.update({
    "u1_three_way_split_labeled": SPLIT_LABELED,
    "u2_two_way_split_lineitem": TWO_WAY,
    "u3_three_way_split_unlabeled": SPLIT_UNLABELED,
    "u5_classification_metrics": CLASSIFICATION,
    "u6_regression_metrics": REGRESSION,
    "u9_primary_improvement": IMPROVEMENT,
    "u12_roc_auc": ROC,
    "u12_roc_auc_by_lang": ROC_BY,
    "u13_group_fairness": FAIRNESS,
})


# ---- generation (G) ---------------------------------------------------------

def _bootstrap_sql(where: str, n_expr: str) -> str:
    return f"""WITH src AS (SELECT * FROM orders WHERE {where}),
st AS (SELECT stddev_pop(CAST(o_orderkey AS DOUBLE)) AS sd_k, min(o_orderkey) AS mn_k, max(o_orderkey) AS mx_k,
              stddev_pop(CAST(o_custkey AS DOUBLE)) AS sd_c, min(o_custkey) AS mn_c, max(o_custkey) AS mx_c,
              stddev_pop(o_totalprice) AS sd_p, min(o_totalprice) AS mn_p, max(o_totalprice) AS mx_p FROM orders),
m AS (SELECT count(*) AS m FROM src),
idx AS (SELECT *, row_number() OVER (ORDER BY {_md5u('42:bootstrap_index', _ORD_KEY)}) - 1 AS i FROM src),
draws AS (SELECT range AS d, CAST(floor({_md5u('42:draw', 'CAST(range AS VARCHAR)')} / 4503599627370496.0 * (SELECT m FROM m)) AS BIGINT) AS i
          FROM range((SELECT {n_expr}))),
z AS (SELECT d, i,
  sqrt(-2 * ln(greatest({_md5u('42:n1:o_orderkey', 'CAST(d AS VARCHAR)')} / 4503599627370496.0, 1e-300))) * cos(2 * pi() * {_md5u('42:n2:o_orderkey', 'CAST(d AS VARCHAR)')} / 4503599627370496.0) AS zk,
  sqrt(-2 * ln(greatest({_md5u('42:n1:o_custkey', 'CAST(d AS VARCHAR)')} / 4503599627370496.0, 1e-300))) * cos(2 * pi() * {_md5u('42:n2:o_custkey', 'CAST(d AS VARCHAR)')} / 4503599627370496.0) AS zc,
  sqrt(-2 * ln(greatest({_md5u('42:n1:o_totalprice', 'CAST(d AS VARCHAR)')} / 4503599627370496.0, 1e-300))) * cos(2 * pi() * {_md5u('42:n2:o_totalprice', 'CAST(d AS VARCHAR)')} / 4503599627370496.0) AS zp
  FROM draws)
SELECT z.d AS _draw,
  CAST(round_even(least(greatest(o_orderkey + zk * 0.01 * sd_k, mn_k), mx_k), 0) AS BIGINT) AS o_orderkey,
  CAST(round_even(least(greatest(o_custkey + zc * 0.01 * sd_c, mn_c), mx_c), 0) AS BIGINT) AS o_custkey,
  o_orderstatus, least(greatest(o_totalprice + zp * 0.01 * sd_p, mn_p), mx_p) AS o_totalprice, o_orderdate, o_orderpriority
FROM z JOIN idx USING (i), st"""


ORACLE.update({
    "g1_bootstrap_orders": _bootstrap_sql("TRUE", "(SELECT count(*) FROM orders) // 2"),
    "g2_bootstrap_orders_where": _bootstrap_sql("CAST(o_orderstatus AS VARCHAR) = 'F'", "(SELECT count(*) FROM orders) // 4"),
})


# ---- sequences (T) ----------------------------------------------------------

_C_TRAIN = repr(1 - 0.2 - 0.2)
_C_VALID = repr(1 - 0.2)

GRID = """
ev AS (SELECT event_type, date_trunc('hour', ts) AS hour, value FROM events),
hourly AS (SELECT event_type, hour, count(*) AS n_events, sum(value) AS value_sum FROM ev GROUP BY 1, 2),
bounds AS (SELECT event_type, min(hour) AS lo, max(hour) AS hi FROM ev GROUP BY 1),
spine AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour FROM bounds),
grid AS (SELECT s.event_type, s.hour, CAST(coalesce(h.n_events, 0) AS DOUBLE) AS n_events,
                coalesce(h.value_sum, 0.0) AS value_sum
         FROM spine s LEFT JOIN hourly h USING (event_type, hour))"""


def _profile_sql(src: str, entity: str, ts: str) -> str:
    return f"""d AS (SELECT CAST({entity} AS VARCHAR) AS entity,
                 epoch_us({ts}) - lag(epoch_us({ts})) OVER (PARTITION BY {entity} ORDER BY {ts}) AS dt FROM {src}),
m AS (SELECT entity, CAST(floor(quantile_cont(dt, 0.5)) AS BIGINT) AS interval_us FROM d WHERE dt IS NOT NULL GROUP BY 1)
SELECT entity, CAST(count(*) AS BIGINT) AS rows, interval_us,
       CAST(count(*) FILTER (WHERE abs(dt - interval_us) > greatest(1.0, interval_us * 0.01)) AS BIGINT) AS irregular_intervals
FROM d JOIN m USING (entity) GROUP BY entity, interval_us"""


PROFILE_RAW = f"WITH {_profile_sql('events', 'event_type', 'ts')}"
PROFILE_GRID = f"WITH {GRID}, {_profile_sql('grid', 'event_type', 'hour')}"

SPLIT_GRID = f"""{GRID},
pos AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY hour) - 1 AS pos,
               count(*) OVER (PARTITION BY event_type) AS n FROM grid),
b AS (SELECT *, CAST(trunc(n * CAST({_C_TRAIN} AS DOUBLE)) AS BIGINT) AS e1,
              CAST(trunc(n * CAST({_C_VALID} AS DOUBLE)) AS BIGINT) AS e2 FROM pos),
sp AS (SELECT *, CASE WHEN pos < e1 THEN 'train' WHEN pos < e2 THEN 'validation' ELSE 'test' END AS split,
              pos - CASE WHEN pos < e1 THEN 0 WHEN pos < e2 THEN e1 ELSE e2 END AS q,
              CASE WHEN pos < e1 THEN e1 WHEN pos < e2 THEN e2 - e1 ELSE n - e2 END AS n_part FROM b)"""

CHRONO = f"""WITH {SPLIT_GRID}
SELECT event_type AS entity, split, CAST(count(*) AS BIGINT) AS rows, min(hour) AS first_hour, max(hour) AS last_hour
FROM sp GROUP BY 1, 2"""

SCALE = f"""{SPLIT_GRID},
st AS (SELECT min(n_events) AS lo0, max(n_events) AS hi0, min(value_sum) AS lo1, max(value_sum) AS hi1,
              quantile_cont(n_events, 0.5) AS md0, quantile_cont(value_sum, 0.5) AS md1 FROM sp WHERE split = 'train'),
sc AS (SELECT sp.*, (n_events - lo0) / CASE WHEN hi0 > lo0 THEN hi0 - lo0 ELSE 1.0 END * 2 - 1 AS f0,
              (value_sum - lo1) / CASE WHEN hi1 > lo1 THEN hi1 - lo1 ELSE 1.0 END * 2 - 1 AS f1 FROM sp, st),
starts AS (SELECT DISTINCT event_type, split, n_part, q AS s FROM sc WHERE q % 6 = 0 AND q + 24 <= n_part),
win AS (SELECT w.event_type, w.split, w.s, r.q - w.s AS t, r.hour, r.f0, r.f1,
               w.event_type || ':' || w.split || ':' || CAST(w.s AS VARCHAR) AS wid
        FROM starts w JOIN sc r ON r.event_type = w.event_type AND r.split = w.split AND r.q >= w.s AND r.q < w.s + 24)"""

SCALER = f"""WITH {SCALE}
SELECT 'n_events' AS feature, lo0 AS minimum, CASE WHEN hi0 > lo0 THEN hi0 - lo0 ELSE 1.0 END AS span, md0 AS training_median FROM st
UNION ALL SELECT 'value_sum', lo1, CASE WHEN hi1 > lo1 THEN hi1 - lo1 ELSE 1.0 END, md1 FROM st"""

WINDOWS = f"""WITH {SCALE}
SELECT split, event_type AS entity, CAST(s AS BIGINT) AS start, min(hour) AS first_ts, max(hour) AS last_ts,
       CAST(count(*) AS BIGINT) AS n_steps, round(sum(f0 + f1), 6) AS value_total
FROM win GROUP BY split, event_type, s"""

WINDOW_BOOTSTRAP = f"""WITH {SCALE},
ids AS (SELECT DISTINCT wid, split FROM win),
tr AS (SELECT wid, row_number() OVER (ORDER BY {_md5u('42:window_index', 'wid')}, wid) - 1 AS i FROM ids WHERE split = 'train'),
m AS (SELECT count(*) AS m FROM tr),
draws AS (SELECT range AS draw, CAST(floor({_md5u('42:draw', 'CAST(range AS VARCHAR)')} / 4503599627370496.0 * (SELECT m FROM m)) AS BIGINT) AS i
          FROM range((SELECT count(*) FROM ids WHERE split = 'test')))
SELECT draw, wid AS source_window_id FROM draws JOIN tr USING (i)"""

_METRIC_BASE = f"""{SCALE},
lv AS (SELECT CASE WHEN split = 'train' THEN 0 ELSE 1 END AS src, wid, t, 0 AS f, f0 AS v FROM win WHERE split IN ('train', 'test')
       UNION ALL SELECT CASE WHEN split = 'train' THEN 0 ELSE 1 END, wid, t, 1, f1 FROM win WHERE split IN ('train', 'test')),
wm AS (SELECT src, wid, f, avg(v) AS m FROM lv GROUP BY 1, 2, 3),
c AS (SELECT lv.*, v - m AS c FROM lv JOIN wm USING (src, wid, f)),
den AS (SELECT src, wid, f, sum(c * c) AS den FROM c GROUP BY 1, 2, 3)"""

_LAGS = list(range(1, min(10, 24 // 4) + 1))

SEQ_METRICS = f"""WITH {_METRIC_BASE},
vc AS (SELECT f, v, sum(1 - src) AS a, sum(src) AS b FROM lv GROUP BY 1, 2),
cdf AS (SELECT f, sum(a) OVER (PARTITION BY f ORDER BY v) / sum(a) OVER (PARTITION BY f) AS Fa,
               sum(b) OVER (PARTITION BY f ORDER BY v) / sum(b) OVER (PARTITION BY f) AS Fb FROM vc),
ks AS (SELECT f, max(abs(Fa - Fb)) AS ks FROM cdf GROUP BY f),
mom AS (SELECT f, avg(v) FILTER (WHERE src = 0) AS mr, avg(v) FILTER (WHERE src = 1) AS ms,
               var_pop(v) FILTER (WHERE src = 0) AS vr, var_pop(v) FILTER (WHERE src = 1) AS vs FROM lv GROUP BY f),
lags AS (SELECT unnest({_LAGS}) AS lag),
ac AS (SELECT a.src, a.wid, a.f, l.lag, sum(a.c * b.c) AS num FROM c a JOIN lags l ON TRUE
       JOIN c b ON b.src = a.src AND b.wid = a.wid AND b.f = a.f AND b.t = a.t + l.lag GROUP BY 1, 2, 3, 4),
acf AS (SELECT ac.src, ac.f, ac.lag, avg(num / den) AS acf FROM ac JOIN den USING (src, wid, f) WHERE den > 1e-12
        GROUP BY 1, 2, 3),
acd AS (SELECT r.f, avg(abs(r.acf - s.acf)) AS acf_error FROM acf r JOIN acf s ON r.f = s.f AND r.lag = s.lag
        AND r.src = 0 AND s.src = 1 GROUP BY r.f),
slope AS (SELECT src, wid, f, sum(v * (t - 11.5)) / {sum((t - 11.5) ** 2 for t in range(24))} AS sl FROM lv GROUP BY 1, 2, 3),
sl AS (SELECT f, avg(sl) FILTER (WHERE src = 0) AS sr, avg(sl) FILTER (WHERE src = 1) AS ss FROM slope GROUP BY f),
ks_idx AS (SELECT unnest(range(0, 13)) AS k),
pw AS (SELECT c.src, c.wid, c.f, k.k, pow(sum(c.c * cos(2 * pi() * k.k * c.t / 24.0)), 2)
                                     + pow(sum(c.c * sin(2 * pi() * k.k * c.t / 24.0)), 2) AS p
       FROM c JOIN ks_idx k ON TRUE GROUP BY 1, 2, 3, 4),
mp AS (SELECT src, f, k, avg(p) AS p FROM pw GROUP BY 1, 2, 3),
np AS (SELECT src, f, k, p / sum(p) OVER (PARTITION BY src, f) AS p, sum(p) OVER (PARTITION BY src, f) AS tot FROM mp),
js AS (SELECT r.f, CASE WHEN min(r.tot) > 0 AND min(s.tot) > 0 THEN
              0.5 * sum(CASE WHEN r.p > 0 THEN r.p * log2(r.p / ((r.p + s.p) / 2)) ELSE 0 END)
            + 0.5 * sum(CASE WHEN s.p > 0 THEN s.p * log2(s.p / ((r.p + s.p) / 2)) ELSE 0 END) END AS js
       FROM np r JOIN np s ON r.f = s.f AND r.k = s.k AND r.src = 0 AND s.src = 1 GROUP BY r.f)
SELECT ks.f AS feature_index, round(ks, 6) + 0.0 AS ks_statistic,
       round(abs(mr - ms) / greatest(sqrt(vr), 1e-8), 6) + 0.0 AS normalized_mean_error,
       round(abs(vr - vs) / (vr + 1e-8), 6) + 0.0 AS normalized_variance_error,
       round(acf_error, 6) + 0.0 AS acf_error,
       round(abs(sr - ss) / greatest(sqrt(vr), 1e-8), 6) + 0.0 AS normalized_trend_error,
       round(greatest(js, 0.0), 6) + 0.0 AS spectral_js_divergence
FROM ks JOIN mom USING (f) JOIN sl USING (f) LEFT JOIN js USING (f) LEFT JOIN acd USING (f)"""

SEQ_SUMMARY = f"""WITH {_METRIC_BASE},
pairs AS (SELECT a.src, 0 AS lag, a.v AS x, b.v AS y FROM lv a JOIN lv b ON a.src = b.src AND a.wid = b.wid AND a.t = b.t
          WHERE a.f = 0 AND b.f = 1
          UNION ALL
          SELECT a.src, 1, a.v, b.v FROM lv a JOIN lv b ON a.src = b.src AND a.wid = b.wid AND b.t = a.t + 1
          WHERE a.f = 0 AND b.f = 1),
cc AS (SELECT src, lag, CASE WHEN stddev_pop(x) > 1e-8 AND stddev_pop(y) > 1e-8 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END AS r
       FROM pairs GROUP BY 1, 2),
xc AS (SELECT round(avg(abs(a.r - b.r)), 6) + 0.0 AS cross_correlation_error FROM cc a JOIN cc b ON a.lag = b.lag
          AND a.src = 0 AND b.src = 1),
wv AS (SELECT wid, list([f0, f1] ORDER BY t) AS vals FROM win WHERE split = 'test' GROUP BY wid),
uq AS (SELECT round(count(DISTINCT vals) / count(*), 6) + 0.0 AS unique_sequence_ratio FROM wv)
SELECT * FROM xc, uq"""

ORACLE.update({
    "t2_profile_events_raw": PROFILE_RAW,
    "t2_profile_event_grid": PROFILE_GRID,
    "t4_chronological_split": CHRONO,
    "t6_scaler": SCALER,
    "t7_sliding_windows": WINDOWS,
    "t10_window_bootstrap": WINDOW_BOOTSTRAP,
    "t11_t15_sequence_metrics": SEQ_METRICS,
    "t15_t16_sequence_summary": SEQ_SUMMARY,
})


# ---- text (X), gates and selection (R), sources (S) --------------------------

RENDER = """SELECT o_orderkey, 'Order ' || CAST(o_orderkey AS VARCHAR) || ' for customer ' || coalesce(CAST(o_custkey AS VARCHAR), 'None')
  || ': ' || concat_ws(', ', 'o_orderstatus=' || coalesce(CAST(o_orderstatus AS VARCHAR), 'None'),
                       'o_totalprice=' || coalesce(CAST(o_totalprice AS VARCHAR), 'None'),
                       'o_orderpriority=' || coalesce(CAST(o_orderpriority AS VARCHAR), 'None')) AS text
FROM orders"""

_RULES = "(SELECT * FROM (VALUES ('o_orderstatus', 'F', 'o_orderstatus=F'), ('o_orderstatus', 'O', 'o_orderstatus=O'), ('o_orderstatus', 'P', 'pending')) r(field, value, expected_text))"
CONSISTENCY_CTE = f"""r AS ({RENDER}),
j AS (SELECT r.o_orderkey, o.o_orderstatus, lower(r.text) AS t FROM r JOIN orders o USING (o_orderkey)),
h AS (SELECT j.o_orderkey, ru.field, contains(j.t, lower(ru.expected_text)) AS hit FROM j
      JOIN {_RULES} ru ON ru.field = 'o_orderstatus' AND ru.value = CAST(j.o_orderstatus AS VARCHAR)),
per AS (SELECT j.o_orderkey, coalesce(string_agg(h.field, ',' ORDER BY h.field) FILTER (WHERE h.hit), '') AS matched,
               CAST(count(*) FILTER (WHERE NOT h.hit) AS BIGINT) AS n_violations
        FROM j LEFT JOIN h USING (o_orderkey) GROUP BY j.o_orderkey)"""
CONSISTENCY = f"WITH {CONSISTENCY_CTE} SELECT o_orderkey, matched, n_violations, n_violations = 0 AS consistent FROM per"
CONSISTENCY_SUMMARY = f"""WITH {CONSISTENCY_CTE}
SELECT CAST(count(*) AS BIGINT) AS count, CAST(count(*) FILTER (WHERE n_violations = 0) AS BIGINT) AS consistent_count,
       round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE n_violations = 0) / count(*) ELSE 1.0 END, 6) + 0.0 AS consistency_rate
FROM per"""

CANDIDATES = """cand AS (
  WITH d AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
  total AS (SELECT count(*) AS n_total, avg(n_chars) AS avg_all, max(n_chars) AS max_all, count(DISTINCT lang) AS n_langs FROM documents),
  la AS (SELECT lang, count(*) AS k_all FROM documents GROUP BY lang),
  ls AS (SELECT source, lang, count(*) AS k FROM documents GROUP BY 1, 2),
  ns AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
  tv AS (SELECT source, 1.0 - 0.5 * (sum(abs(k / n - k_all / n_total)) + 1.0 - sum(k_all / n_total)) AS distribution_score
         FROM ls JOIN la USING (lang) JOIN ns USING (source), total GROUP BY source),
  per AS (SELECT source, count(*) AS n, count(DISTINCT text) AS u, avg(CASE WHEN n_chars >= 50 THEN 1.0 ELSE 0.0 END) AS validity,
                 avg(toxic) AS toxic, avg(quality) AS quality, count(DISTINCT lang) AS langs, avg(n_chars) AS avg_chars,
                 stddev_pop(n_chars) AS sd_chars FROM d GROUP BY source)
  SELECT source AS candidate_id, round(1.0 - u / n, 6) AS exact_match_rate, round(u / n, 6) AS diversity_score,
         round(validity, 6) AS validity_score, round(1.0 - coalesce(toxic, 0.0), 6) AS privacy_score,
         round(coalesce(quality, 0.0), 6) AS utility, round(langs / n_langs, 6) AS dependency_score,
         round(distribution_score, 6) AS distribution_score,
         round(1.0 - abs(avg_chars - avg_all) / max_all, 6) AS multivariate_score,
         round(least(1.0, sd_chars / avg_chars), 6) AS discriminator_score,
         distribution_score >= 0.55 AS passed, n / 1000.0 AS cost_seconds
  FROM per JOIN tv USING (source), total)"""

_HARD = """g AS (SELECT *, list_filter([
    CASE WHEN privacy_score IS NULL OR privacy_score < 0.70 THEN 'privacy_score_below_threshold' END,
    CASE WHEN exact_match_rate IS NOT NULL AND exact_match_rate > 0.05 THEN 'exact_match_rate_above_threshold' END,
    CASE WHEN validity_score IS NULL OR validity_score < 0.95 THEN 'validity_score_below_threshold' END,
    CASE WHEN distribution_score IS NULL OR distribution_score < 0.60 THEN 'distribution_score_below_threshold' END],
    lambda x: x IS NOT NULL) AS failed FROM cand)"""

RUN_GATES = f"""WITH {CANDIDATES}
SELECT candidate_id, array_to_string(list_filter([
    CASE WHEN NOT passed THEN 'overall_validation_below_threshold' END,
    CASE WHEN privacy_score < 0.70 THEN 'privacy_score_below_threshold' END,
    CASE WHEN exact_match_rate > 0.05 THEN 'exact_match_rate_above_threshold' END,
    CASE WHEN validity_score IS NULL OR validity_score < 0.95 THEN 'validity_score_below_threshold' END,
    CASE WHEN round(distribution_score, 4) < 0.60 THEN 'distribution_score_below_threshold' END], lambda x: x IS NOT NULL), ',') AS failed,
  passed AND NOT (privacy_score < 0.70 OR exact_match_rate > 0.05 OR validity_score IS NULL OR validity_score < 0.95
                  OR round(distribution_score, 4) < 0.60) AS artifact_eligible
FROM cand"""

HARD_GATES = f"""WITH {CANDIDATES}, {_HARD}
SELECT candidate_id, len(failed) = 0 AS passed_hard_gates,
       CASE WHEN len(failed) > 0 THEN array_to_string(failed, ', ') END AS failure_reason FROM g"""

_OBJ = ["utility", "dependency_score", "distribution_score", "multivariate_score", "diversity_score",
        "discriminator_score", "privacy_score", "validity_score"]
_PRIO = ("0.45 * coalesce(utility, 0) + 0.15 * coalesce(dependency_score, 0) + 0.15 * coalesce(distribution_score, 0) "
         "+ 0.10 * coalesce(multivariate_score, 0) + 0.10 * coalesce(diversity_score, 0) + 0.05 * coalesce(discriminator_score, 0)")
_DOM = (" AND ".join(f"coalesce(o.{c}, 0) >= coalesce(c.{c}, 0)" for c in _OBJ) + " AND (" +
        " OR ".join(f"coalesce(o.{c}, 0) > coalesce(c.{c}, 0)" for c in _OBJ) + ")")
PARETO_CTE = f"""{CANDIDATES}, {_HARD},
v AS (SELECT * FROM g WHERE len(failed) = 0),
f AS (SELECT c.candidate_id FROM v c WHERE NOT EXISTS (SELECT 1 FROM v o WHERE o.candidate_id <> c.candidate_id AND {_DOM}))"""
PARETO = f"""WITH {PARETO_CTE}
SELECT candidate_id, candidate_id IN (SELECT candidate_id FROM f) AS pareto_optimal, round({_PRIO}, 8) AS priority FROM g"""
SELECT_CAND = f"""WITH {PARETO_CTE}
SELECT candidate_id, round({_PRIO}, 8) AS priority, TRUE AS selected FROM g WHERE candidate_id IN (SELECT candidate_id FROM f)
ORDER BY {_PRIO} DESC, candidate_id DESC LIMIT 1"""

QUALITY_COST = f"""WITH {CANDIDATES}, {_HARD},
t AS (SELECT candidate_id AS generator, distribution_score AS s, cost_seconds AS c, len(failed) = 0 AS ok FROM g),
pool AS (SELECT * FROM t WHERE ok OR NOT EXISTS (SELECT 1 FROM t WHERE ok)),
fr AS (SELECT * FROM pool p WHERE NOT EXISTS (SELECT 1 FROM pool o WHERE o.generator <> p.generator
         AND o.s >= p.s AND o.c <= p.c AND (o.s > p.s OR o.c < p.c))),
mx AS (SELECT coalesce(nullif(max(c), 0), 1) AS m FROM fr),
win AS (SELECT generator FROM fr, mx ORDER BY s - 0.05 * c / m DESC LIMIT 1)
SELECT generator, generator IN (SELECT generator FROM fr) AS pareto_optimal,
       generator IN (SELECT generator FROM win) AS selected, EXISTS (SELECT 1 FROM t WHERE ok) AS quality_gates_passed FROM t"""

FINGERPRINT = f"""
SELECT CAST(sum(('0x' || substr(md5({_LI_KEY}), 1, 13))::BIGINT::HUGEINT) % 4503599627370496 AS BIGINT) AS dataset_hash,
       CAST(count(*) AS BIGINT) AS num_rows,
       'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate' AS columns,
       'source' AS generator, CAST(42 AS BIGINT) AS random_seed
FROM lineitem"""

PREVIEW = "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10"
READ_VALIDATE = "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(11 AS BIGINT) AS columns FROM lineitem"

ORACLE.update({
    "x1_render_text_orders": RENDER,
    "x2_text_consistency_orders": CONSISTENCY,
    "x2_consistency_summary_orders": CONSISTENCY_SUMMARY,
    "r1_run_gates": RUN_GATES,
    "r2_hard_gates": HARD_GATES,
    "r3_pareto_frontier": PARETO,
    "r4_select_candidate": SELECT_CAND,
    "r5_select_quality_cost": QUALITY_COST,
    "s2_read_validate_lineitem": READ_VALIDATE,
    "s9_preview_orders": PREVIEW,
    "s10_fingerprint_lineitem": FINGERPRINT,
})


# ---- extra oracles: N4 ratio override, T9 windows to rows ----------------------

PLAN_OVERRIDE = """WITH r AS (SELECT count(*) AS rows FROM supplier),
z AS (SELECT rows, CAST(round_even(CAST(rows AS DOUBLE) * 0.3, 0) AS BIGINT) AS req,
             greatest(1, CAST(floor(rows * 0.5) AS BIGINT)) AS mx FROM r)
SELECT 'all' AS segment, least(req, mx) > 0 AS generation_needed, 'small_dataset_expansion' AS generation_mode,
       CAST(least(greatest(req, 0), mx) AS BIGINT) AS samples_to_generate, CAST(rows AS BIGINT) AS original_rows,
       CAST(NULL AS VARCHAR) AS target_class, CAST(NULL AS BIGINT) AS current_target_count,
       CAST(NULL AS BIGINT) AS desired_target_count, CAST(mx AS BIGINT) AS max_allowed_samples, req > mx AS capped,
       round(least(greatest(req, 0), mx) / greatest(rows, 1), 6) + 0.0 AS augmentation_ratio
FROM z"""

WINDOWS_TO_ROWS = f"""WITH {SCALE},
v AS (SELECT * FROM win WHERE split = 'validation'),
ids AS (SELECT wid, row_number() OVER (ORDER BY wid) - 1 AS i FROM (SELECT DISTINCT wid FROM v))
SELECT 'synthetic_' || CAST(i AS VARCHAR) AS event_type, TIMESTAMP '2000-01-01 00:00:00' + t * INTERVAL 1 HOUR AS hour,
       (f0 + 1) / 2 * CASE WHEN hi0 > lo0 THEN hi0 - lo0 ELSE 1.0 END + lo0 AS n_events,
       (f1 + 1) / 2 * CASE WHEN hi1 > lo1 THEN hi1 - lo1 ELSE 1.0 END + lo1 AS value_sum
FROM v JOIN ids USING (wid), st"""

ORACLE.update({
    "n4_plan_supplier_ratio": PLAN_OVERRIDE,
    "t9_windows_to_rows": WINDOWS_TO_ROWS,
    "t9_windows_to_rows_all": WINDOWS_TO_ROWS.replace(" WHERE split = 'validation'", ""),
})


# ---- flagship: bootstrap of the real half + validation summary (F10) -----------

def _py(expr: str, d: int) -> str:
    return op.pyround(expr, d)


_FLAG_KEY = "concat_ws(chr(31), " + ", ".join(
    [_micro(c) for c in ["l_quantity", "l_extendedprice", "net_price", "l_discount", "l_tax"]]
    + [_vc(c) for c in ["l_linenumber", "l_returnflag", "l_linestatus"]]) + ")"


def _noise(col: str) -> str:
    u1 = _md5u(f"42:n1:{col}", "CAST(d AS VARCHAR)") + " / 4503599627370496.0"
    u2 = _md5u(f"42:n2:{col}", "CAST(d AS VARCHAR)") + " / 4503599627370496.0"
    return f"sqrt(-2 * ln(greatest({u1}, 1e-300))) * cos(2 * pi() * {u2})"


op.SOURCES["flag_real"] = "(SELECT * EXCLUDE (src) FROM li WHERE src = 0)"
op.SOURCES["flag_boot"] = "(SELECT * EXCLUDE (src) FROM li WHERE src = 1)"
op.SCHEMAS["flag_real"] = [("l_quantity", "float"), ("l_extendedprice", "float"), ("net_price", "float"),
                           ("l_discount", "float"), ("l_tax", "float"), ("l_linenumber", "int"),
                           ("l_returnflag", "str"), ("l_linestatus", "str")]
op.SCHEMAS["flag_boot"] = op.SCHEMAS["flag_real"]

_NUMS3 = ["l_quantity", "l_extendedprice", "net_price"]
_BOOT = f"""
base AS ({PAIR.split('AS (', 1)[1].rsplit(')', 1)[0]}),
real AS (SELECT * EXCLUDE (src) FROM base WHERE src = 0),
st0 AS (SELECT {', '.join(f"stddev_pop({c}) AS sd_{c}, min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in _NUMS3)} FROM real),
idx AS (SELECT *, row_number() OVER (ORDER BY {_md5u('42:bootstrap_index', _FLAG_KEY)}) - 1 AS i FROM real),
draws AS (SELECT range AS d, CAST(floor({_md5u('42:draw', 'CAST(range AS VARCHAR)')} / 4503599627370496.0
                 * (SELECT count(*) FROM real)) AS BIGINT) AS i FROM range((SELECT count(*) FROM real) // 2)),
z AS (SELECT d, i, {', '.join(f"{_noise(c)} AS z_{c}" for c in _NUMS3)} FROM draws),
boot AS (SELECT {', '.join(f"least(greatest({c} + z_{c} * 0.01 * sd_{c}, mn_{c}), mx_{c}) AS {c}" for c in _NUMS3)},
                l_discount, l_tax, l_linenumber, l_returnflag, l_linestatus FROM z JOIN idx USING (i), st0),
li AS (SELECT *, 0 AS src FROM real UNION ALL SELECT *, 1 AS src FROM boot)"""


def _body(sql: str) -> str:
    """A full statement that starts with 'WITH <PAIR>,' minus the PAIR CTE (it reads our li)."""
    head = f"WITH {PAIR},"
    assert sql.startswith(head)
    return "WITH " + sql[len(head):]


FLAGSHIP = f"""WITH {_BOOT}, {NUM_CDF}, {CAT_SHARES},
ksw AS (SELECT col, {_py('max(abs(F - G))', 6)} AS ks,
               {_py("sum(abs(F - G) * coalesce(next_v - v, 0.0)) / CASE WHEN max(std_real) IS NULL OR max(std_real) = 0 THEN 1.0 ELSE max(std_real) END", 6)} AS nw
        FROM cdf2 JOIN rstd USING (col) GROUP BY col HAVING max(na) >= 2 AND max(nb) >= 2),
tvs AS (SELECT col, {_py('0.5 * sum(abs(p - q))', 6)} AS tv FROM csh GROUP BY col),
fparts AS (SELECT {_py('least(greatest(1.0 - ks, 0.0), 1.0)', 6)} AS f, 1.0 / (1.0 + nw) AS dd FROM ksw
           UNION ALL SELECT {_py('least(greatest(1.0 - tv, 0.0), 1.0)', 6)}, least(greatest(1.0 - tv, 0.0), 1.0) FROM tvs),
marg AS (SELECT {_py('avg(f)', 6)} AS fidelity_score, {_py('avg(dd)', 6)} AS distribution_score FROM fparts),
cor AS ({_body(CORRELATION_SCORE)}),
div AS ({_body(DIVERSITY)}),
prv AS ({_body(PRIVACY_SCORE)}),
vld AS ({op.validity_sql('flag_real', 'flag_boot')}),
core AS (SELECT 1 AS o, 'fidelity_score' AS metric, {_py('fidelity_score', 4)} AS value FROM marg
         UNION ALL SELECT 2, 'distribution_score', {_py('distribution_score', 4)} FROM marg
         UNION ALL SELECT 3, 'correlation_score', {_py('correlation_score', 4)} FROM cor
         UNION ALL SELECT 4, 'diversity_score', {_py('diversity_score', 4)} FROM div
         UNION ALL SELECT 5, 'privacy_score', {_py('privacy_score', 4)} FROM prv)
SELECT metric, value FROM core
UNION ALL SELECT 'overall_score', {_py('avg(value)', 4)} FROM core
UNION ALL SELECT 'passed', CASE WHEN {_py('avg(value)', 4)} >= 0.55 THEN 1.0 ELSE 0.0 END FROM core
UNION ALL SELECT 'validity_score', validity_score FROM vld"""

ORACLE["f10_validation_summary_bootstrap"] = FLAGSHIP
# The whole of lineitem as the real table, every row in the privacy part.
ORACLE["f10_validation_summary_all"] = FLAGSHIP.replace("FROM base WHERE src = 0)", "FROM base)").replace(_body(PRIVACY_SCORE), _body(PRIVACY_SCORE_ALL))


# ---- V5: sequence distance privacy over the hourly grid windows ----------------

_SEQ_PRIV = f"""WITH {SCALE},
flat AS (SELECT wid, split, t * 2 + 0 AS pos, f0 AS v FROM win UNION ALL SELECT wid, split, t * 2 + 1, f1 FROM win),
ids AS (SELECT DISTINCT wid, split FROM win),
tr_ix AS (SELECT wid, row_number() OVER (ORDER BY {_md5u('42:window_index', 'wid')}, wid) - 1 AS i FROM ids WHERE split = 'train'),
draws AS (SELECT range AS draw, CAST(floor({_md5u('42:draw', 'CAST(range AS VARCHAR)')} / 4503599627370496.0
                 * (SELECT count(*) FROM tr_ix)) AS BIGINT) AS i FROM range((SELECT count(*) FROM ids WHERE split = 'test'))),
boot AS (SELECT 'bootstrap_' || CAST(draw AS VARCHAR) AS wid, tr_ix.wid AS src_wid FROM draws JOIN tr_ix USING (i)),
bflat AS (SELECT b.wid, f.pos, f.v FROM boot b JOIN flat f ON f.wid = b.src_wid),
tr_s AS (SELECT wid FROM ids WHERE split = 'train' ORDER BY {_md5u('42:sdp_train', 'wid')}, wid LIMIT 128),
ho_s AS (SELECT wid FROM ids WHERE split = 'validation' ORDER BY {_md5u('42:sdp_holdout', 'wid')}, wid LIMIT 128),
ge_s AS (SELECT wid FROM boot ORDER BY {_md5u('42:sdp_syn', 'wid')}, wid LIMIT 128),
trv AS (SELECT f.wid, f.pos, f.v FROM flat f JOIN tr_s USING (wid)),
hov AS (SELECT f.wid, f.pos, f.v FROM flat f JOIN ho_s USING (wid)),
gev AS (SELECT f.wid, f.pos, f.v FROM bflat f JOIN ge_s USING (wid)),
dsc AS (SELECT pos, CASE WHEN stddev_pop(v) > 1e-8 THEN stddev_pop(v) ELSE 1.0 END AS s FROM trv GROUP BY pos),
d_gt AS (SELECT a.wid AS a, b.wid AS b, sqrt(sum(pow(a.v / dsc.s - b.v / dsc.s, 2))) / sqrt(48.0) AS d
         FROM gev a JOIN trv b USING (pos) JOIN dsc USING (pos) GROUP BY 1, 2),
d_gh AS (SELECT a.wid AS a, b.wid AS b, sqrt(sum(pow(a.v / dsc.s - b.v / dsc.s, 2))) / sqrt(48.0) AS d
         FROM gev a JOIN hov b USING (pos) JOIN dsc USING (pos) GROUP BY 1, 2),
to_train AS (SELECT a, min(d) AS d FROM d_gt GROUP BY a),
to_hold AS (SELECT a, min(d) AS d FROM d_gh GROUP BY a),
att AS (SELECT 1 AS label, -min(d) AS score FROM d_gt GROUP BY b UNION ALL SELECT 0, -min(d) FROM d_gh GROUP BY b),
rk AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM att),
auc AS (SELECT round((sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
              / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)), 6) + 0.0 AS distance_attack_auc FROM rk),
tlist AS (SELECT DISTINCT list(v ORDER BY pos) AS vals FROM flat WHERE split = 'train' GROUP BY wid),
blist AS (SELECT wid, list(v ORDER BY pos) AS vals FROM bflat GROUP BY wid),
ex AS (SELECT round(count(*) FILTER (WHERE vals IN (SELECT vals FROM tlist)) / count(*), 6) + 0.0 AS exact_training_match_rate FROM blist)
SELECT exact_training_match_rate,
       (SELECT round(avg(CASE WHEN d < 0.01 THEN 1.0 ELSE 0.0 END), 6) + 0.0 FROM to_train) AS near_training_match_rate,
       (SELECT round(median(d), 6) + 0.0 FROM to_train) AS median_distance_to_train,
       (SELECT round(median(d), 6) + 0.0 FROM to_hold) AS median_distance_to_holdout,
       distance_attack_auc, CAST(128 AS BIGINT) AS sample_cap
FROM ex, auc"""

ORACLE["v5_sequence_distance_privacy"] = _SEQ_PRIV
# Every window instead of 128 of each set.
_SEQ_PRIV_ALL = _SEQ_PRIV.replace(" LIMIT 128)", ")").replace("CAST(128 AS BIGINT) AS sample_cap", """
       (SELECT count(*) FROM ids WHERE split = 'train') AS train_rows, (SELECT count(*) FROM ids WHERE split = 'validation') AS holdout_rows""")
ORACLE["v5_sequence_distance_privacy_all"] = _SEQ_PRIV_ALL


# ---- T18: temporal gates on validation windows vs bootstrapped training windows ----

def _metrics_from(lv_sql: str) -> str:
    """Per-feature temporal metrics (same columns as SEQ_METRICS) over a given lv(src, wid, t, f, v)."""
    body = SEQ_METRICS.split("vc AS (SELECT f, v, sum(1 - src)", 1)[1]
    return f"""lv AS ({lv_sql}),
wm AS (SELECT src, wid, f, avg(v) AS m FROM lv GROUP BY 1, 2, 3),
c AS (SELECT lv.*, v - m AS c FROM lv JOIN wm USING (src, wid, f)),
den AS (SELECT src, wid, f, sum(c * c) AS den FROM c GROUP BY 1, 2, 3),
vc AS (SELECT f, v, sum(1 - src){body}"""


_GATE_LV = """SELECT 0 AS src, wid, t, 0 AS f, f0 AS v FROM win WHERE split = 'validation'
              UNION ALL SELECT 0, wid, t, 1, f1 FROM win WHERE split = 'validation'
              UNION ALL SELECT 1, wid, CAST(pos // 2 AS BIGINT), CAST(pos % 2 AS INTEGER), v FROM bflat"""

def _gates_sql(privacy: str) -> str:
    _PRIV_CTES = privacy.split("WITH " + SCALE + ",", 1)[1].rsplit("\nSELECT exact_training_match_rate,", 1)[0]
    _TAIL = privacy.rsplit("\nSELECT exact_training_match_rate,", 1)[1]
    return f"""WITH {SCALE}, {_PRIV_CTES},
privacy AS (SELECT exact_training_match_rate,{_TAIL}),
per AS (WITH {_metrics_from(_GATE_LV)}),
f AS (SELECT avg(ks_statistic) AS ks, avg(acf_error) AS acf, count(acf_error) AS n_acf, sum(ks_statistic) AS sks,
             sum(acf_error) AS sacf, count(ks_statistic) AS n_ks FROM per),
g AS (SELECT list_filter([CASE WHEN exact_training_match_rate > 0.05 THEN 'exact_match' END,
                          CASE WHEN near_training_match_rate > 0.1 THEN 'near_match' END,
                          CASE WHEN ks > 0.4 THEN 'marginal_ks' END,
                          CASE WHEN n_acf = 0 OR acf > 0.3 THEN 'autocorrelation' END], lambda x: x IS NOT NULL) AS failed_gates,
             round(1.0 / (1.0 + (sks + coalesce(sacf, 0.0)) / (n_ks + n_acf)), 6) + 0.0 AS validation_score
      FROM f, privacy)
SELECT failed_gates, len(failed_gates) = 0 AS eligible, validation_score FROM g"""

ORACLE["t18_temporal_gates"] = _gates_sql(_SEQ_PRIV)
ORACLE["t18_temporal_gates_all"] = _gates_sql(_SEQ_PRIV_ALL)

_CODES = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(dense_rank() OVER (ORDER BY {c} NULLS LAST) - 1 AS BIGINT) AS code FROM orders"
    for c in ("o_orderstatus", "o_orderdate", "o_orderpriority"))
ORACLE.update({
    "g9_mixed_encode_orders": f"SELECT column_name, code, count(*) AS n FROM ({_CODES}) GROUP BY ALL",
    "g10_codec_round_trip_orders": "SELECT * REPLACE (round(o_totalprice, 6) + 0.0 AS o_totalprice) FROM orders",
})


# ---- T17: ridge with a free intercept, its normal equations solved by elimination ----

_T17_KEEP, _T17_P = 22, 45  # prefix steps of two features, and the intercept
FORECAST = f"""WITH RECURSIVE {SCALE},
flat AS (SELECT wid, split, t * 2 + 0 AS pos, f0 AS v FROM win UNION ALL SELECT wid, split, t * 2 + 1, f1 FROM win),
ids AS (SELECT DISTINCT wid, split FROM win),
tr_ix AS (SELECT wid, row_number() OVER (ORDER BY {_md5u('42:window_index', 'wid')}, wid) - 1 AS i FROM ids WHERE split = 'train'),
draws AS (SELECT range AS draw, CAST(floor({_md5u('42:draw', 'CAST(range AS VARCHAR)')} / 4503599627370496.0
                * (SELECT count(*) FROM tr_ix)) AS BIGINT) AS i FROM range((SELECT count(*) FROM tr_ix))),
rows AS (SELECT 0 AS tag, wid AS id, wid FROM ids WHERE split = 'train' UNION ALL SELECT 2, wid, wid FROM ids WHERE split = 'test'
         UNION ALL SELECT 1, 'b' || CAST(draw AS VARCHAR), wid FROM draws JOIN tr_ix USING (i)),
z AS (SELECT tag, id, CAST(CASE WHEN pos < 44 THEN pos WHEN pos = 44 THEN 45 ELSE 46 END AS INTEGER) AS j, v
      FROM rows JOIN flat USING (wid) WHERE pos < 44 OR pos IN (44, 46)
      UNION ALL SELECT tag, id, 44, 1.0 FROM rows),
g AS (SELECT a.tag, a.j AS i, b.j, sum(a.v * b.v) AS v FROM z a JOIN z b ON a.tag = b.tag AND a.id = b.id WHERE a.tag < 2 AND a.j < 45 GROUP BY 1, 2, 3),
sets AS (SELECT 'real_only' AS training, 0 AS tag UNION ALL SELECT 'synthetic_only', 1 UNION ALL SELECT 'augmented', 0 UNION ALL SELECT 'augmented', 1),
sys AS (SELECT training, i, j, sum(v) + CASE WHEN i = j AND i < 44 THEN 1.0 ELSE 0.0 END AS v FROM sets JOIN g USING (tag) GROUP BY training, i, j),
line AS (SELECT training, i, list(v ORDER BY j) AS r FROM sys GROUP BY training, i),
elim(training, k, m) AS (
    SELECT training, 0, list(r ORDER BY i) FROM line GROUP BY training
    UNION ALL
    SELECT training, k + 1, list_transform(range(1, 46), lambda i: CASE WHEN i = k + 1 THEN list_transform(m[k + 1], lambda x: x / m[k + 1][k + 1])
               ELSE list_transform(range(1, 48), lambda j: m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END)
    FROM elim WHERE k < 45),
coef AS (SELECT training, i - 1 AS j, m[i][46] AS c0, m[i][47] AS c1 FROM elim, unnest(range(1, 46)) AS u(i) WHERE k = 45),
pred AS (SELECT training, id, sum(v * c0) AS p0, sum(v * c1) AS p1 FROM z JOIN coef USING (j) WHERE tag = 2 GROUP BY 1, 2),
act AS (SELECT id, max(v) FILTER (WHERE j = 45) AS y0, max(v) FILTER (WHERE j = 46) AS y1 FROM z WHERE tag = 2 GROUP BY 1),
e AS (SELECT training, p0 - y0 AS e FROM pred JOIN act USING (id) UNION ALL SELECT training, p1 - y1 FROM pred JOIN act USING (id))
SELECT training, round(avg(abs(e)) * max(s) / 2, 6) + 0.0 AS mae, round(sqrt(avg(e * e)) * max(s) / 2, 6) + 0.0 AS rmse,
       2 AS horizon, 0 AS target_index
FROM e, (SELECT CASE WHEN hi0 > lo0 THEN hi0 - lo0 ELSE 1.0 END AS s FROM st) GROUP BY training"""

ORACLE["t17_forecast_utility"] = FORECAST


# ---- reports, records, generator inputs ----

_NUMBERS = "ks_statistic, normalized_wasserstein, quantile_error, histogram_overlap"
_CLASSES = "total_variation_distance, jensen_shannon_divergence, category_coverage"
_NO_NUMBERS, _NO_CLASSES = (", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in names.split(", ")) for names in (_NUMBERS, _CLASSES))
DISTRIBUTION_REPORT = f"""
SELECT column_name, 'numerical' AS kind, 'computed' AS status, {_NUMBERS}, {_NO_CLASSES}
FROM ({KS}) JOIN ({WASSERSTEIN}) USING (column_name) JOIN ({QUANTILE_ERROR}) USING (column_name) JOIN ({HISTOGRAM_OVERLAP}) USING (column_name)
WHERE column_name <> 'net_price'
UNION ALL SELECT column_name, 'categorical', 'computed', {_NO_NUMBERS}, {_CLASSES} FROM ({JS}) WHERE column_name NOT IN ('l_tax', 'l_linestatus')
UNION ALL SELECT column_name, kind, status, {_NO_NUMBERS}, {_NO_CLASSES}
FROM (VALUES ('net_price', 'numerical', 'not_applicable'), ('l_linestatus', 'categorical', 'not_applicable'),
             ('l_tax', 'categorical', 'missing_in_synthetic')) AS t(column_name, kind, status)"""

CLASS_SHARES = f"""WITH {PAIR}, {CAT_SHARES}
SELECT v AS class, {r6('p')} AS original_share, {r6('q')} AS synthetic_share FROM csh WHERE col = 'l_returnflag'"""

HISTOGRAMS = f"""WITH {PAIR}, lnum AS ({_long_num()}),
rng AS (SELECT col, min(v) AS lo, max(v) AS hi, sum(1 - src) AS na, sum(src) AS nb FROM lnum GROUP BY col),
c AS (SELECT col, CASE WHEN hi > lo THEN CAST(least(floor((v - lo) * (10.0 / (hi - lo))), 9) AS BIGINT) ELSE 0 END AS bin,
             sum(1 - src) AS a, sum(src) AS b FROM lnum JOIN rng USING (col) GROUP BY 1, 2),
every AS (SELECT *, unnest(range(CASE WHEN hi > lo THEN 10 ELSE 1 END)) AS bin FROM rng)
SELECT col AS column_name, bin, {r6('lo + bin * ((hi - lo) / 10.0)')} AS lower, {r6('lo + (bin + 1) * ((hi - lo) / 10.0)')} AS upper,
       CAST(coalesce(a, 0) AS BIGINT) AS original_rows, CAST(coalesce(b, 0) AS BIGINT) AS synthetic_rows,
       {r6('coalesce(a, 0) / na')} AS original_share, {r6('coalesce(b, 0) / nb')} AS synthetic_share
FROM every LEFT JOIN c USING (col, bin)"""

_DIAGONAL = " UNION ALL ".join(
    f"SELECT '{c}' AS a, '{c}' AS b, CASE WHEN max({c}) > min({c}) THEN 1.0 ELSE 0.0 END AS rho, src FROM li GROUP BY src" for c in NUM_COLS)
MATRICES = f"""WITH {PAIR},
half AS (SELECT a, b, CASE WHEN sx * sy > 0 THEN c / (sx * sy) ELSE 0.0 END AS rho, 0 AS src FROM ({_pearson_pairs('li', NUM_COLS, 'WHERE src = 0')})
         UNION ALL SELECT a, b, CASE WHEN sx * sy > 0 THEN c / (sx * sy) ELSE 0.0 END, 1 FROM ({_pearson_pairs('li', NUM_COLS, 'WHERE src = 1')})),
m AS (SELECT a, b, rho, src FROM half UNION ALL SELECT b, a, rho, src FROM half UNION ALL {_DIAGONAL}),
w AS (SELECT a, b, {r6('max(rho) FILTER (WHERE src = 0)')} AS original, {r6('max(rho) FILTER (WHERE src = 1)')} AS synthetic FROM m GROUP BY a, b)
SELECT a AS row_column, b AS column_name, original, synthetic, {r6('synthetic - original')} AS difference FROM w"""

RUN_LOG = """log AS (
  SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS event, props AS payload, ts AS "at",
         CASE event_type WHEN 'signup' THEN 'queued' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'running' END AS status
  FROM events),
latest AS (
  SELECT run_id, event, status, payload, "at", min("at") OVER (PARTITION BY run_id) AS created_at, count(*) OVER (PARTITION BY run_id) AS n_events
  FROM log QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY "at" DESC, event DESC, status DESC, payload DESC) = 1)"""


def _range_draw(c: str) -> str:
    u = _md5u(f"42:range:{c}", "CAST(d AS VARCHAR)") + " / 4503599627370496.0"
    return f"(SELECT CAST(min({c}) AS DOUBLE) FROM orders) + {u} * (SELECT CAST(max({c}) AS DOUBLE) - CAST(min({c}) AS DOUBLE) FROM orders)"


def _jitter(k: int) -> str:
    key = f"CAST(draw AS VARCHAR) || ':' || CAST(t AS VARCHAR) || ':{k}'"
    u1, u2 = (f"{_md5u(f'42:jitter_{i}', key)} / 4503599627370496.0" for i in (1, 2))
    return f"least(greatest(f{k} + sqrt(-2 * ln(greatest({u1}, 1e-300))) * cos(2 * pi() * {u2}) * 0.05, -1.0), 1.0)"


_FORECAST_VALIDATION = FORECAST.replace("wid, wid FROM ids WHERE split = 'test'", "wid, wid FROM ids WHERE split = 'validation'").replace(
    "FROM range((SELECT count(*) FROM tr_ix)))", "FROM range((SELECT count(*) FROM ids WHERE split = 'test')))")

ORACLE.update({
    "f7_distribution_report": DISTRIBUTION_REPORT,
    "f11_class_shares": CLASS_SHARES,
    "f11_histograms": HISTOGRAMS,
    "f11_correlation_matrices": MATRICES,
    "s4_csv_round_trip_orders": "SELECT * FROM orders",
    "s5_run_record_lineitem": f"""SELECT 'run-1' AS run_id, 'completed' AS status, '{{"rows": ' || num_rows || ', "table": "lineitem"}}' AS config,
                                         CAST(dataset_hash AS VARCHAR) AS dataset_hash FROM ({FINGERPRINT})""",
    "s5_split_ids_labeled": ORACLE["u1_three_way_split_labeled"],
    "s12_run_log_latest": f"WITH {RUN_LOG} SELECT * FROM latest",
    "s12_run_log_list": f"WITH {RUN_LOG} SELECT * FROM latest ORDER BY created_at DESC, run_id LIMIT 50",
    "s12_run_log_recovered": f"""WITH {RUN_LOG} SELECT CASE WHEN status IN ('queued', 'running') THEN 'failed' ELSE status END AS status,
                                        count(*) AS runs FROM latest GROUP BY 1""",
    "p16_generator_input_lineitem": "SELECT * FROM lineitem",
    "g6_align_output_orders": "SELECT * FROM orders",
    "g11_registered_generator_orders": f"""SELECT CAST(round_even({_range_draw('o_custkey')}, 0) AS BIGINT) AS o_custkey, {_range_draw('o_totalprice')} AS o_totalprice
                                           FROM range((SELECT count(*) FROM orders)) AS r(d)""",
    "t5_fill_missing": f"""WITH {SPLIT_GRID.replace('coalesce(h.value_sum, 0.0) AS value_sum', 'h.value_sum')},
                           md AS (SELECT quantile_cont(value_sum, 0.5) AS md FROM sp WHERE split = 'train')
                           SELECT event_type AS entity, hour, split, n_events, coalesce(value_sum, md) AS value_sum FROM sp, md""",
    "t8_inverse_scale": f"""WITH {SCALE}
        SELECT split, event_type AS entity, CAST(s AS BIGINT) AS start,
               round(sum((f0 + 1) / 2 * CASE WHEN hi0 > lo0 THEN hi0 - lo0 ELSE 1.0 END + lo0), 4) + 0.0 AS events_total,
               round(sum((f1 + 1) / 2 * CASE WHEN hi1 > lo1 THEN hi1 - lo1 ELSE 1.0 END + lo1), 4) + 0.0 AS value_total
        FROM win, st GROUP BY split, event_type, s""",
    "t10_jittered_bootstrap": f"""SELECT draw, source_window_id, round(sum({_jitter(0)} + {_jitter(1)}), 4) + 0.0 AS value_total
        FROM ({WINDOW_BOOTSTRAP}) JOIN (WITH {SCALE} SELECT wid AS source_window_id, t, f0, f1 FROM win) USING (source_window_id)
        GROUP BY draw, source_window_id""",
    "t18_temporal_gates_forecast": f"""SELECT failed_gates, eligible, round(1.0 / (1.0 + mae), 6) + 0.0 AS validation_score
        FROM ({ORACLE['t18_temporal_gates_all']}), ({_FORECAST_VALIDATION}) WHERE training = 'synthetic_only'""",
})
