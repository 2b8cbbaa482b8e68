"""ANSI SQL (DuckDB dialect) re-statements of the registered queries, for value checks.

Written independently of the Spark plans: plain window functions where the Spark side avoids
them for scale (e.g. a per-class row_number instead of bucketed ranks), direct formulas where
the Spark side uses algebraic rewrites (e.g. MI as sum p ln(p / (px py))).
Portability rules: regexp_replace(..., 'g'); text to integer via trunc(try_cast(x AS DOUBLE));
x / 0 spelled as NULL; doubles rounded to 6 decimals on both sides; floats widened to DOUBLE.
"""

from __future__ import annotations

from foldwise.plans import tables as tb

TWO32 = "4294967296.0"


def u32(seed, *parts: str) -> str:
    inner = " || '|' || ".join([f"'{seed}'"] + [p if p.startswith("'") else f"CAST({p} AS VARCHAR)" for p in parts])
    return f"CAST(('0x' || substr(md5({inner}), 1, 8)) AS BIGINT)"


def uni(seed, *parts: str) -> str:
    return f"({u32(seed, *parts)} / {TWO32})"


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


def to_int(x: str) -> str:
    return f"CAST(trunc(TRY_CAST({x} AS DOUBLE)) AS INTEGER)"


def case_codes(col: str, labels) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{l}' THEN {i}" for i, l in enumerate(labels)) + " END"


def regex_chain(expr: str, pairs) -> str:
    for p, r in pairs:
        expr = f"regexp_replace({expr}, '{p}', '{r}', 'g')"
    return expr


SEG_PAIRS = [("AUTOMOBILE", "0"), ("BUILDING", "1"), ("FURNITURE", "2"), ("HOUSEHOLD", "3"), ("MACHINERY", "4")]

CUST_RAW = f"""cust_raw AS (
  SELECT c_custkey, c_name,
    CASE WHEN c_custkey % 17 = 0 THEN 'None' WHEN c_acctbal > 9000 THEN '>9000' WHEN c_acctbal < 0 THEN '-4'
         ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END AS acctbal_txt,
    CAST(CASE WHEN c_custkey % 11 = 0 THEN -4 ELSE c_nationkey END AS INTEGER) AS nation_code,
    CAST(CASE WHEN c_custkey % 19 = 0 THEN -4.0 WHEN c_custkey % 23 = 0 THEN NULL ELSE c_acctbal END AS DOUBLE) AS acctbal,
    CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 29 = 0 THEN 'None' ELSE c_mktsegment END AS segment_txt,
    c_mktsegment
  FROM customer),
cust AS (SELECT c_custkey AS row_id, c_name, acctbal_txt, nation_code, acctbal, segment_txt,
    {case_codes('c_mktsegment', tb.SEGMENT_LABELS)} AS DX FROM cust_raw)"""

LINE_AGG = """la AS (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS sum_qty, avg(l_discount + 0.0) AS avg_disc,
    avg(l_tax + 0.0) AS avg_tax, max(l_linenumber) AS max_linenumber FROM lineitem GROUP BY l_orderkey)"""

WIDE = f"""{CUST_RAW},
{LINE_AGG},
w AS (SELECT o.o_orderkey AS row_id, o.o_custkey, o.o_orderstatus, o.o_totalprice, CAST(year(o.o_orderdate) AS INTEGER) AS order_year,
    l.n_lines, l.sum_qty, l.avg_disc, l.avg_tax, l.max_linenumber,
    c.c_name, c.acctbal_txt, c.nation_code, c.acctbal, c.segment_txt,
    {case_codes('o.o_orderpriority', tb.PRIORITY_LABELS)} AS DX
  FROM orders o LEFT JOIN la l ON o.o_orderkey = l.l_orderkey LEFT JOIN cust_raw c ON o.o_custkey = c.c_custkey)"""

# cleaned modalities of the wide table: one projection, means over all wide rows
CLEAN_W = f"""{WIDE},
w1 AS (SELECT *,
    CASE WHEN acctbal_txt IN ('-1','-4','None') THEN NULL ELSE acctbal_txt END AS t1,
    CASE WHEN CAST(nation_code AS VARCHAR) IN ('-1','-4','None') THEN NULL ELSE nation_code END AS nc1,
    CASE WHEN CAST(acctbal AS VARCHAR) IN ('-4') THEN NULL ELSE acctbal END AS a1,
    CASE WHEN segment_txt IN ('None') THEN NULL ELSE segment_txt END AS s1 FROM w),
wm AS (SELECT avg(CAST(order_year AS DOUBLE)) AS m_year, avg(TRY_CAST(t1 AS DOUBLE)) AS m_t, avg(CAST(nc1 AS DOUBLE)) AS m_nc,
    avg(a1) AS m_a, avg(CAST(n_lines AS DOUBLE)) AS m_nl, avg(sum_qty) AS m_sq, avg(avg_disc) AS m_ad, avg(avg_tax) AS m_at,
    avg(CAST(max_linenumber AS DOUBLE)) AS m_ml FROM w1),
w2 AS (SELECT row_id, DX,
    CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) AS o_totalprice,
    {to_int(regex_chain('o_orderstatus', [('F', '0'), ('O', '1'), ('P', '2')]))} AS o_orderstatus,
    CAST(trunc(coalesce(CAST(order_year AS DOUBLE), m_year)) AS INTEGER) AS order_year,
    CAST(TRY_CAST(regexp_replace(coalesce(t1, CAST(m_t AS VARCHAR)), '>9000', '9000', 'g') AS FLOAT) AS DOUBLE) AS acctbal_txt,
    CAST(CAST(coalesce(a1, m_a) AS FLOAT) AS DOUBLE) AS "ACCTBAL",
    CAST(trunc(coalesce(CAST(nc1 AS DOUBLE), m_nc)) AS INTEGER) AS nation_code,
    {to_int(regex_chain("coalesce(s1, '5')", SEG_PAIRS))} AS segment_txt,
    CAST(trunc(coalesce(CAST(n_lines AS DOUBLE), m_nl)) AS INTEGER) AS n_lines,
    CAST(CAST(coalesce(sum_qty, m_sq) AS FLOAT) AS DOUBLE) AS sq_f,
    CAST(CAST(coalesce(avg_disc, m_ad) AS FLOAT) AS DOUBLE) AS avg_disc,
    CAST(CAST(coalesce(avg_tax, m_at) AS FLOAT) AS DOUBLE) AS avg_tax,
    CAST(trunc(coalesce(CAST(max_linenumber AS DOUBLE), m_ml)) AS INTEGER) AS max_linenumber
  FROM w1, wm),
cw AS (SELECT *, CASE WHEN n_lines = 0 OR n_lines IS NULL THEN NULL ELSE sq_f / CAST(n_lines AS DOUBLE) END AS sum_qty FROM w2)"""

MOD_COLS = {
    "order": ["o_totalprice", "o_orderstatus", "order_year"],
    "customer": ["acctbal_txt", "ACCTBAL", "nation_code", "segment_txt"],
    "lines": ["n_lines", "sum_qty", "avg_disc", "avg_tax", "max_linenumber"],
}
VIEW_COLS = {v: [c for part in parts for c in MOD_COLS[part]] for v, parts in tb.VIEWS.items()}


def q(name: str) -> str:
    return f'"{name}"' if name != name.lower() else name


def moments_sql(tag_col: str, groups: dict) -> str:
    parts = []
    for g, cols in groups.items():
        for i, c in enumerate(cols):
            parts.append(f"SELECT '{g}' AS {tag_col}, '{c}' AS feature, {i} AS position, count({q(c)}) AS n_nonnull, "
                         f"{r6(f'avg(CAST({q(c)} AS DOUBLE))')} AS mean FROM cw")
    return f"WITH {CLEAN_W}\n" + "\nUNION ALL\n".join(parts)


def long_sql(src: str, cols: list[str], label: str = "DX") -> str:
    return "\nUNION ALL\n".join(
        f"SELECT row_id, {label} AS DX, '{c}' AS feature, CAST({q(c)} AS DOUBLE) AS value FROM {src}" for c in cols)


def pos_case(cols: list[str]) -> str:
    return "CASE feature " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(cols)) + " END"


def mi_ctes(long_cte: str, sfx: str = "") -> str:
    x = sfx
    return f"""nxy{x} AS (SELECT feature, value, DX, CAST(count(*) AS DOUBLE) AS n FROM {long_cte}
    WHERE value IS NOT NULL AND DX IS NOT NULL GROUP BY feature, value, DX),
nx{x} AS (SELECT feature, value, sum(n) AS nx FROM nxy{x} GROUP BY feature, value),
ny{x} AS (SELECT feature, DX, sum(n) AS ny FROM nxy{x} GROUP BY feature, DX),
nt{x} AS (SELECT feature, sum(n) AS nt FROM nxy{x} GROUP BY feature),
mi{x} AS (SELECT feature, sum(n / nt * ln(n * nt / (nx * ny))) AS mi
    FROM nxy{x} JOIN nx{x} USING (feature, value) JOIN ny{x} USING (feature, DX) JOIN nt{x} USING (feature) GROUP BY feature)"""


def anova_ctes(long_cte: str, sfx: str = "") -> str:
    x = sfx
    return f"""g{x} AS (SELECT feature, DX, count(*) AS n, avg(value) AS mean, var_pop(value) * count(*) AS m2 FROM {long_cte}
    WHERE value IS NOT NULL AND DX IS NOT NULL GROUP BY feature, DX),
gt{x} AS (SELECT feature, sum(n) AS nn, count(*) AS k, sum(n * mean) / sum(n) AS grand FROM g{x} GROUP BY feature),
fs{x} AS (SELECT feature, sum(n * (mean - grand) * (mean - grand)) AS ssb, sum(m2) AS ssw, any_value(nn) AS nn, any_value(k) AS k
    FROM g{x} JOIN gt{x} USING (feature) GROUP BY feature),
fa{x} AS (SELECT feature, CASE WHEN k < 2 OR (ssw = 0 AND ssb = 0) THEN NULL WHEN ssw = 0 THEN CAST('Infinity' AS DOUBLE) ELSE (ssb / (k - 1)) / (ssw / (nn - k)) END AS score FROM fs{x})"""


LINE_FEATS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
LI = """li AS (SELECT l_orderkey * 8 + l_linenumber AS row_id, l_quantity, l_discount + 0.0 AS l_discount,
    l_tax + 0.0 AS l_tax, l_linenumber, l_returnflag AS DX FROM lineitem)"""
LI_LONG = f"{LI},\nlg AS ({long_sql('li', LINE_FEATS)})"

ORDERS_FOLDS = f"""{WIDE},
fo AS (SELECT row_id, DX, CAST((row_number() OVER (PARTITION BY DX ORDER BY {u32(1, 'row_id')}, row_id) - 1) % 3 AS INTEGER) AS fold FROM w)"""


def pred_ctes(seed=7, p_ok=0.6, k=3, src="w", name="pr") -> str:
    return f"""{name}_f AS (SELECT row_id, DX, CAST((row_number() OVER (PARTITION BY DX ORDER BY {u32(1, 'row_id')}, row_id) - 1) % {k} AS INTEGER) AS fold FROM {src}),
{name} AS (SELECT row_id, DX, fold, CAST(CASE WHEN {uni(seed, "'ok'", 'row_id')} < {p_ok} THEN DX
    ELSE CAST(floor({uni(seed, "'guess'", 'row_id')} * 5) AS INTEGER) END AS INTEGER) AS pred FROM {name}_f)"""


def fold_metric_ctes(pred: str, n_classes: int = 5, extra: str = "") -> str:
    """(extra..., fold, metric, class, value) as CTE {pred}_m."""
    ex = f"{extra}, " if extra else ""
    return f"""{pred}_acc AS (SELECT {ex}fold, avg(CASE WHEN DX = pred THEN 1.0 ELSE 0.0 END) AS acc FROM {pred} GROUP BY {ex}fold),
{pred}_cm AS (SELECT {ex}fold, DX AS actual, pred AS predicted, count(*) AS n FROM {pred} GROUP BY {ex}fold, DX, pred),
{pred}_r AS (SELECT {ex}fold, actual AS class, sum(n) AS row_n, sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS tp FROM {pred}_cm GROUP BY {ex}fold, actual),
{pred}_c AS (SELECT {ex}fold, predicted AS class, sum(n) AS col_n FROM {pred}_cm GROUP BY {ex}fold, predicted),
{pred}_t AS (SELECT {ex}fold, sum(n) AS total FROM {pred}_cm GROUP BY {ex}fold),
{pred}_labs AS (SELECT DISTINCT {ex}fold, actual AS class FROM {pred}_cm UNION SELECT DISTINCT {ex}fold, predicted FROM {pred}_cm),
{pred}_rates AS (SELECT {ex}fold, class, coalesce(tp, 0) AS tp, coalesce(row_n, 0) - coalesce(tp, 0) AS fn,
    coalesce(col_n, 0) - coalesce(tp, 0) AS fp, total - coalesce(row_n, 0) - coalesce(col_n, 0) + coalesce(tp, 0) AS tn
    FROM {pred}_labs LEFT JOIN {pred}_r USING ({ex}fold, class) LEFT JOIN {pred}_c USING ({ex}fold, class) JOIN {pred}_t USING ({ex}fold)),
{pred}_m AS (
  SELECT {ex}fold, 'accuracy' AS metric, -1 AS class, acc AS value FROM {pred}_acc
  UNION ALL SELECT {ex}fold, 'auc', -1, (1 + acc - (1 - acc) / {n_classes - 1}.0) / 2 FROM {pred}_acc
  UNION ALL SELECT {ex}fold, 'sensitivity', class, CASE WHEN tp + fn = 0 THEN NULL ELSE tp / (tp + fn) END FROM {pred}_rates
  UNION ALL SELECT {ex}fold, 'specificity', class, CASE WHEN tn + fp = 0 THEN NULL ELSE tn / (tn + fp) END FROM {pred}_rates)"""


def metric_runs_sql(repetitions=tuple(range(1, 21)), levels=(0.5, 0.6, 0.7, 0.8), k=5) -> str:
    ctes, unions = [], []
    for rep in repetitions:
        for lv in levels:
            nm = f"p{rep}_{int(lv * 10)}"
            ctes.append(pred_ctes(rep * 100 + int(lv * 10), lv, k, "w", nm))
            ctes.append(fold_metric_ctes(nm))
            unions.append(f"SELECT {rep} AS repetition, 'noise_{lv}' AS config, fold, metric, class, value FROM {nm}_m")
    return ",\n".join(ctes) + ",\nruns AS (" + "\nUNION ALL\n".join(unions) + ")"


EMB_WIDE = lambda dims, start=0: "ew AS (SELECT vec_id AS row_id, " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i:02d}" for i in range(start, start + dims)) + ", label AS DX FROM embeddings)"

EMB = [f"e{i:02d}" for i in range(64)]

EMB_SPLIT = f"""ef AS (SELECT vec_id AS row_id, label AS DX, CAST(embedding AS DOUBLE[]) AS v,
    CAST((row_number() OVER (PARTITION BY label ORDER BY {u32(1, 'vec_id')}, vec_id) - 1) % 3 AS INTEGER) AS fold FROM embeddings),
etr AS (SELECT * FROM ef WHERE fold <> 0), ete AS (SELECT * FROM ef WHERE fold = 0)"""

DOCS = """d AS (SELECT dd.doc_id AS row_id, CAST(dd.n_chars AS DOUBLE) AS n_chars,
    CAST(length(dd.text) - length(replace(dd.text, ' ', '')) AS DOUBLE) AS n_spaces,
    CAST(length(dd.text) - length(replace(dd.text, chr(10), '')) AS DOUBLE) AS n_newlines,
    CAST(l.toxic AS INTEGER) AS DX FROM documents dd JOIN labels l ON dd.doc_id = l.doc_id)"""

CUST_NT = """c1 AS (SELECT row_id,
    CASE WHEN acctbal_txt IN ('-1','-4','None') THEN NULL ELSE acctbal_txt END AS t,
    CASE WHEN CAST(nation_code AS VARCHAR) IN ('-1','-4','None') THEN NULL ELSE nation_code END AS nc,
    CASE WHEN CAST(acctbal AS VARCHAR) IN ('-4') THEN NULL ELSE acctbal END AS a,
    CASE WHEN segment_txt IN ('None') THEN NULL ELSE segment_txt END AS s, nation_code AS nc_raw, DX FROM cust),
m1 AS (SELECT avg(TRY_CAST(t AS DOUBLE)) AS mt, avg(CAST(nc AS DOUBLE)) AS mn, avg(a) AS ma FROM c1)"""


def _sql() -> dict[str, str]:
    S = {}
    S["scan_alias"] = "SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM orders"
    S["drop_columns"] = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"
    S["rename_columns"] = "SELECT o_orderkey AS row_id, o_custkey, o_orderstatus, o_totalprice, o_orderpriority AS priority FROM orders"
    S["label_encode"] = f"SELECT o_orderkey AS row_id, {case_codes('o_orderpriority', tb.PRIORITY_LABELS)} AS DX FROM orders"
    S["left_join_enrich"] = f"""WITH {WIDE}
SELECT row_id, o_custkey, o_orderstatus, {r6('o_totalprice')} AS o_totalprice, order_year, n_lines, {r6('sum_qty')} AS sum_qty,
  {r6('avg_disc')} AS avg_disc, {r6('avg_tax')} AS avg_tax, max_linenumber, c_name, acctbal_txt, nation_code,
  {r6('acctbal')} AS acctbal, segment_txt, DX FROM w"""
    S["left_join_enrich_variant"] = f"""WITH {LINE_AGG}
SELECT o.o_orderkey, o.o_custkey, o.o_orderpriority, o.o_totalprice, l.n_lines, c.c_mktsegment, c.c_acctbal
FROM orders o LEFT JOIN la l ON o.o_orderkey = l.l_orderkey LEFT JOIN customer c ON o.o_custkey = c.c_custkey"""
    feats = sorted({f for f, _ in tb.CATALOG_ORDER_SIDE + tb.CATALOG_LINE_SIDE})
    prof = "\nUNION ALL\n".join(f"SELECT '{f}' AS Feature, count({f}) AS n_nonnull FROM w" for f in feats)
    cat_rows = ([f"('{f}', '{g}', 'order_side')" for f, g in tb.CATALOG_ORDER_SIDE] +
                [f"('{f}', '{g}', 'line_side')" for f, g in tb.CATALOG_LINE_SIDE])
    cat = f"cat(Feature, Grouping, source) AS (VALUES {', '.join(cat_rows)})"
    S["feature_catalog_union"] = f"""WITH {WIDE}, prof AS ({prof}), {cat}
SELECT Feature, Grouping, source, CAST(n_nonnull AS BIGINT) AS n_nonnull FROM cat LEFT JOIN prof USING (Feature)"""
    S["filter_in_list"] = S["feature_catalog_union"] + " WHERE Grouping IN ('Customer Account', 'Customer Profile')"
    S["feature_subset"] = f"WITH {WIDE} SELECT row_id, acctbal_txt, {r6('acctbal')} AS acctbal, nation_code, segment_txt, DX FROM w"
    raw_mod = {"order": ["o_totalprice", "o_orderstatus", "order_year"],
               "customer": ["acctbal_txt", "acctbal", "nation_code", "segment_txt"],
               "lines": ["n_lines", "sum_qty", "avg_disc", "avg_tax", "max_linenumber"]}
    S["modality_datasets"] = f"WITH {WIDE}\n" + "\nUNION ALL\n".join(
        f"SELECT '{g}' AS dataset, '{c}' AS feature, CAST(count({c}) AS BIGINT) AS n_nonnull, CAST(count(*) AS BIGINT) AS n_rows FROM w"
        for g, cols in raw_mod.items() for c in cols)
    S["clean_all"] = moments_sql("dataset", MOD_COLS)
    S["dataset_views"] = moments_sql("view", VIEW_COLS)
    full = VIEW_COLS["full"]
    S["align_by_row"] = f"WITH {CLEAN_W}\nSELECT row_id, " + ", ".join(
        f"{r6(q(c))} AS {q(c)}" if c not in ("o_orderstatus", "order_year", "nation_code", "segment_txt", "n_lines", "max_linenumber")
        else q(c) for c in full) + ", DX FROM cw"
    S["choose_datasets"] = f"WITH {CLEAN_W}\n" + "\nUNION ALL\n".join(
        f"SELECT {i} AS slot, '{v}' AS dataset, count(*) AS n_rows, {len(VIEW_COLS[v])} AS n_features FROM cw"
        for i, v in enumerate(["buyer", "basket", "buyer"]))
    S["materialize_datasets"] = f"WITH {CLEAN_W}\n" + "\nUNION ALL\n".join(
        f"SELECT '{g}' AS dataset, count(*) AS n_rows, CAST(sum(row_id) AS BIGINT) AS key_sum, {len(cols)} AS n_features FROM cw"
        for g, cols in MOD_COLS.items())

    # cleansing rules on the customer table
    S["null_tokens"] = f"WITH {CUST_RAW}, {CUST_NT}\nSELECT row_id, t AS acctbal_txt, nc AS nation_code, {r6('a')} AS \"ACCTBAL\", s AS segment_txt FROM c1"
    S["mean_impute"] = f"""WITH {CUST_RAW}, {CUST_NT}
SELECT row_id, {r6("TRY_CAST(coalesce(t, CAST(mt AS VARCHAR)) AS DOUBLE)")} AS acctbal_txt,
  {r6('coalesce(CAST(nc AS DOUBLE), mn)')} AS nation_code, {r6('coalesce(a, ma)')} AS "ACCTBAL" FROM c1, m1"""
    S["remove_nulls"] = f"WITH {CUST_RAW}, {CUST_NT}\nSELECT row_id, s AS segment_txt FROM c1 WHERE s IS NOT NULL"
    S["replace_values"] = f"WITH {CUST_RAW}, {CUST_NT}\nSELECT row_id, {regex_chain(chr(39).join(['coalesce(s, ', '5', ')']), SEG_PAIRS)} AS segment_txt FROM c1"
    S["replace_values_literal"] = f"WITH {CUST_RAW}, {CUST_NT}\nSELECT row_id, {regex_chain('s', [('null', '5')] + SEG_PAIRS)} AS segment_txt FROM c1"
    S["cast_type"] = f"""WITH {CUST_RAW}
SELECT row_id, {r6('TRY_CAST(acctbal_txt AS FLOAT)')} AS acctbal_txt, {to_int('segment_txt')} AS segment_txt,
  {r6('CAST(nation_code AS FLOAT)')} AS nation_code FROM cust"""
    ratio_num = "CAST(TRY_CAST(regexp_replace(t, '>9000', '9000', 'g') AS FLOAT) AS DOUBLE)"
    S["ratio_normalize"] = f"""WITH {CUST_RAW}, {CUST_NT}
SELECT row_id, {r6(f'CASE WHEN nc_raw = 0 THEN NULL ELSE {ratio_num} / CAST(nc_raw AS DOUBLE) END')} AS acctbal_txt FROM c1"""
    S["clean_rules"] = f"""WITH {CUST_RAW}, {CUST_NT}
SELECT row_id,
  {r6("TRY_CAST(regexp_replace(coalesce(t, CAST(mt AS VARCHAR)), '>9000', '9000', 'g') AS FLOAT)")} AS acctbal_txt,
  CAST(trunc(coalesce(CAST(nc AS DOUBLE), mn)) AS INTEGER) AS nation_code,
  {r6('CAST(coalesce(a, ma) AS FLOAT)')} AS "ACCTBAL",
  {to_int(regex_chain(chr(39).join(['coalesce(s, ', '5', ')']), SEG_PAIRS))} AS segment_txt, DX FROM c1, m1"""
    S["clean_rules_preclean"] = f"""WITH {CUST_RAW}, {CUST_NT},
c2 AS (SELECT c1.*, cust.acctbal AS a_raw FROM c1 JOIN cust USING (row_id) WHERE s IS NOT NULL),
m2 AS (SELECT avg(a_raw) AS ma2 FROM c2)
SELECT row_id, {r6(f'CASE WHEN nc_raw = 0 THEN NULL ELSE {ratio_num} / CAST(nc_raw AS DOUBLE) END')} AS acctbal_txt,
  {to_int('nc')} AS nation_code, {r6('CAST(coalesce(a_raw, ma2) AS FLOAT)')} AS acctbal,
  {to_int(regex_chain('s', SEG_PAIRS))} AS segment_txt, DX FROM c2, m2"""
    S["agg_mean"] = f"""WITH {CUST_RAW}
SELECT {r6('avg(TRY_CAST(acctbal_txt AS DOUBLE))')} AS mean_acctbal_txt, {r6('avg(nation_code)')} AS mean_nation_code,
  {r6('avg(acctbal)')} AS mean_acctbal FROM cust_raw"""

    # selection
    S["info_gain"] = f"WITH {LI_LONG},\n{mi_ctes('lg')}\nSELECT feature, {pos_case(LINE_FEATS)} AS position, {r6('mi')} AS score FROM mi"
    S["rank_topk"] = f"""WITH {LI_LONG},\n{mi_ctes('lg')}
SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY mi DESC, {pos_case(LINE_FEATS)}) AS INTEGER) AS rank, feature, {r6('mi')} AS score FROM mi) WHERE rank <= 3"""
    pos = pos_case(LINE_FEATS)
    S["mrmr_miq"] = f"""WITH {LI_LONG},\n{mi_ctes('lg')},
pxy AS ({' UNION ALL '.join(f"SELECT '{a}' AS f, '{b}' AS g, CAST({a} AS DOUBLE) AS fv, CAST({b} AS DOUBLE) AS gv, CAST(count(*) AS DOUBLE) AS n FROM li GROUP BY ALL" for a in LINE_FEATS for b in LINE_FEATS if a != b)}),
pfx AS (SELECT f, g, fv, sum(n) AS nf FROM pxy GROUP BY ALL),
pgx AS (SELECT f, g, gv, sum(n) AS ng FROM pxy GROUP BY ALL),
pnt AS (SELECT f, g, sum(n) AS nt FROM pxy GROUP BY ALL),
red AS (SELECT f, g, sum(n / nt * ln(n * nt / (nf * ng))) AS r FROM pxy JOIN pfx USING (f, g, fv) JOIN pgx USING (f, g, gv) JOIN pnt USING (f, g) GROUP BY f, g),
rel AS (SELECT feature, mi, {pos} AS position FROM mi),
p1 AS (SELECT feature, position, mi AS score FROM rel ORDER BY mi DESC, position LIMIT 1),
s2 AS (SELECT rel.feature, rel.position, rel.mi / (red.r + 0.0001) AS score FROM rel JOIN red ON red.f = rel.feature AND red.g = (SELECT feature FROM p1)
  WHERE rel.feature <> (SELECT feature FROM p1)),
p2 AS (SELECT feature, position, score FROM s2 ORDER BY score DESC, position LIMIT 1),
s3 AS (SELECT rel.feature, rel.position, rel.mi / ((ra.r + rb.r) / 2 + 0.0001) AS score FROM rel
  JOIN red ra ON ra.f = rel.feature AND ra.g = (SELECT feature FROM p1)
  JOIN red rb ON rb.f = rel.feature AND rb.g = (SELECT feature FROM p2)
  WHERE rel.feature NOT IN ((SELECT feature FROM p1), (SELECT feature FROM p2))),
p3 AS (SELECT feature, position, score FROM s3 ORDER BY score DESC, position LIMIT 1)
SELECT 1 AS rank, p1.feature, p1.position, {r6('rel.mi')} AS relevance, {r6('p1.score')} AS score FROM p1 JOIN rel USING (feature)
UNION ALL SELECT 2, p2.feature, p2.position, {r6('rel.mi')}, {r6('p2.score')} FROM p2 JOIN rel USING (feature)
UNION ALL SELECT 3, p3.feature, p3.position, {r6('rel.mi')}, {r6('p3.score')} FROM p3 JOIN rel USING (feature)"""
    ccols = ["c_acctbal", "c_nationkey"]
    cust_an = f"ca AS (SELECT c_custkey AS row_id, c_acctbal, c_nationkey, {case_codes('c_mktsegment', tb.SEGMENT_LABELS)} AS DX FROM customer)"
    S["anova_f"] = f"WITH {cust_an}, lg AS ({long_sql('ca', ccols)}),\n{anova_ctes('lg')}\nSELECT feature, {pos_case(ccols)} AS position, {r6('score')} AS score FROM fa"
    S["kbest_mask"] = f"""WITH {CLEAN_W}, lg AS ({long_sql('cw', full)}),\n{anova_ctes('lg')}
SELECT feature, position, {r6('score')} AS score FROM (SELECT feature, {pos_case(full)} AS position, score,
  row_number() OVER (ORDER BY score DESC NULLS LAST, {pos_case(full)} DESC) AS rk FROM fa) WHERE rk <= 5"""
    basket = VIEW_COLS["basket"]
    S["label_append"] = f"""WITH {CLEAN_W}, lg AS ({long_sql('cw', basket)}),\n{mi_ctes('lg')},
top AS (SELECT feature, CAST(row_number() OVER (ORDER BY mi DESC, {pos_case(basket)}) AS INTEGER) AS rank FROM mi)
SELECT lg.row_id, top.rank, lg.feature, {r6('lg.value')} AS value, lg.DX FROM lg JOIN top USING (feature) WHERE top.rank <= 2"""
    S["select_none"] = f"WITH {CLEAN_W}\nSELECT row_id, " + ", ".join(
        f"{r6(c)} AS {c}" if c not in ("n_lines", "max_linenumber", "o_orderstatus", "order_year") else c for c in basket) + ", DX FROM cw"
    per_view = []
    for v in ("buyer", "basket"):
        per_view.append(f"lg_{v} AS ({long_sql('cw', VIEW_COLS[v])})")
        per_view.append(mi_ctes(f"lg_{v}", f"_{v}"))
        per_view.append(anova_ctes(f"lg_{v}", f"_{v}"))
    S["ranking_grid"] = grid_sql()

    # split / scale / weights
    S["standard_scale"] = f"""WITH st AS (SELECT avg(c_acctbal) AS m1, stddev_pop(c_acctbal) AS s1, avg(CAST(c_nationkey AS DOUBLE)) AS m2,
  stddev_pop(c_nationkey) AS s2 FROM customer)
SELECT c_custkey AS row_id, {r6('(c_acctbal - m1) / CASE WHEN s1 < 2.220446049250313e-15 THEN 1 ELSE s1 END')} AS c_acctbal,
  {r6('(c_nationkey - m2) / CASE WHEN s2 < 2.220446049250313e-15 THEN 1 ELSE s2 END')} AS c_nationkey FROM customer, st"""
    S["stratified_folds"] = f"WITH {ORDERS_FOLDS}\nSELECT row_id, DX, fold FROM fo"
    S["ordered_holdout"] = """WITH n AS (SELECT count(*) AS n FROM orders)
SELECT o_orderkey AS row_id, (row_number() OVER (ORDER BY o_orderkey) - 1) >= (n - CAST(ceil(CAST(0.33 AS DOUBLE) * n) AS BIGINT)) AS is_test
FROM orders, n"""
    S["class_weights"] = f"""WITH {DOCS}, c AS (SELECT DX, count(*) AS n FROM d GROUP BY DX)
SELECT DX AS class, CAST(n AS BIGINT) AS n, {r6('(SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n)')} AS weight FROM c"""
    feats3 = ["n_chars", "n_spaces", "n_newlines"]
    dist = "sqrt(" + " + ".join(f"(a.{f} - b.{f}) * (a.{f} - b.{f})" for f in feats3) + ")"
    S["smote"] = f"""WITH {DOCS},
cnt AS (SELECT DX, count(*) AS n FROM d GROUP BY DX),
ci AS (SELECT DX, CAST(dense_rank() OVER (ORDER BY DX) - 1 AS BIGINT) AS cidx, (SELECT count(*) FROM cnt) AS nclass FROM cnt),
need AS (SELECT DX, n AS nc, (SELECT max(n) FROM cnt) - n AS need FROM cnt WHERE (SELECT max(n) FROM cnt) - n > 0 AND n > 1),
base AS (SELECT d.row_id, d.DX, nc, need, row_number() OVER (PARTITION BY d.DX ORDER BY {u32(3, "'base'", 'd.row_id')}, d.row_id) - 1 AS p
  FROM d JOIN need USING (DX)),
syn0 AS (SELECT row_id AS base_id, DX, nc, p, unnest(range(0, CAST(greatest(0, ceil((need - p) / nc)) AS BIGINT))) AS t FROM base),
syn AS (SELECT base_id, DX, nc, p + t * nc AS j FROM syn0),
syn2 AS (SELECT base_id, DX, j, CAST(floor({uni(3, "'nn'", 'DX', 'j')} * least(5, nc - 1)) + 1 AS INTEGER) AS nn_rank,
  {uni(3, "'step'", 'DX', 'j')} AS u FROM syn),
nn AS (SELECT a.row_id AS left_id, b.row_id AS right_id,
  row_number() OVER (PARTITION BY a.row_id ORDER BY {dist}, b.row_id) AS rk FROM d a JOIN d b ON a.DX = b.DX AND a.row_id <> b.row_id
  WHERE a.DX IN (SELECT DX FROM need)),
sy AS (SELECT -(1 + s.j * ci.nclass + ci.cidx) AS row_id, s.DX,
  {', '.join(f"x.{f} + s.u * (y.{f} - x.{f}) AS {f}" for f in feats3)}
  FROM syn2 s JOIN nn ON nn.left_id = s.base_id AND nn.rk = s.nn_rank JOIN d x ON x.row_id = s.base_id JOIN d y ON y.row_id = nn.right_id
  JOIN ci ON ci.DX = s.DX)
SELECT row_id, DX, {', '.join(f'{r6(f)} AS {f}' for f in feats3)}, 0 AS synthetic FROM d
UNION ALL SELECT row_id, DX, {', '.join(f'{r6(f)} AS {f}' for f in feats3)}, 1 FROM sy"""

    # neighbours / classifiers
    S["knn_join"] = f"""WITH e AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pd AS (SELECT a.row_id AS left_id, b.row_id AS right_id, list_distance(a.v, b.v) AS dist FROM e a JOIN e b ON a.row_id <> b.row_id),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY left_id ORDER BY dist, right_id) AS INTEGER) AS rank FROM pd)
SELECT left_id, rank, right_id, {r6('dist')} AS dist FROM rk WHERE rank <= 3"""
    S["knn_predict"] = f"""WITH {EMB_SPLIT},
nn AS (SELECT a.row_id, a.DX, b.DX AS c, row_number() OVER (PARTITION BY a.row_id ORDER BY list_distance(a.v, b.v), b.row_id) AS rk
  FROM ete a, etr b),
votes AS (SELECT row_id, DX, c, count(*) AS n FROM nn WHERE rk <= 2 GROUP BY ALL)
SELECT row_id, DX, CAST(c AS INTEGER) AS pred FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY n DESC, c) AS r FROM votes) WHERE r = 1"""
    S["gaussian_nb"] = f"""WITH {EMB_SPLIT},
trl AS (SELECT row_id, DX, i, v[i] AS x FROM etr, range(1, 65) r(i)),
tel AS (SELECT row_id, DX, i, v[i] AS x FROM ete, range(1, 65) r(i)),
eps AS (SELECT 1e-9 * max(vp) AS eps FROM (SELECT i, var_pop(x) AS vp FROM trl GROUP BY i)),
cs AS (SELECT DX AS c, i, avg(x) AS mu, var_pop(x) + (SELECT eps FROM eps) AS var FROM trl GROUP BY DX, i),
pri AS (SELECT DX AS c, count(*) / (SELECT count(*) FROM etr) AS prior FROM etr GROUP BY DX),
jll AS (SELECT t.row_id, t.DX, cs.c, sum(-0.5 * ln(2 * pi() * cs.var) - (t.x - cs.mu) * (t.x - cs.mu) / (2 * cs.var)) AS s
  FROM tel t JOIN cs ON cs.i = t.i GROUP BY t.row_id, t.DX, cs.c),
tot AS (SELECT row_id, DX, jll.c, s + ln(prior) AS j FROM jll JOIN pri USING (c))
SELECT row_id, DX, CAST(c AS INTEGER) AS pred FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY j DESC, c) AS r FROM tot) WHERE r = 1"""
    S["relieff"] = f"""WITH e64 AS (SELECT vec_id AS row_id, label AS DX, {', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}' for i in range(64))} FROM embeddings),
rg AS (SELECT {', '.join(f'CASE WHEN max(f{i}) - min(f{i}) = 0 THEN 1.0 ELSE max(f{i}) - min(f{i}) END AS r{i}' for i in range(64))} FROM e64),
x AS (SELECT row_id, DX, {', '.join(f'f{i} / r{i} AS x{i}' for i in range(64))} FROM e64, rg),
pr AS (SELECT a.row_id AS aid, a.DX AS ac, b.row_id AS bid, b.DX AS bc, {', '.join(f'abs(a.x{i} - b.x{i}) AS d{i}' for i in range(64))},
  {' + '.join(f'abs(a.x{i} - b.x{i})' for i in range(64))} AS dist FROM x a JOIN x b ON a.row_id <> b.row_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY aid, bc ORDER BY dist, bid) AS rn FROM pr),
nb AS (SELECT * FROM rk WHERE rn <= 10),
nf AS (SELECT aid, bc, count(*) AS nf FROM nb GROUP BY aid, bc),
cnt AS (SELECT DX, count(*) AS n FROM x GROUP BY DX), tot AS (SELECT count(*) AS m FROM x),
wt AS (SELECT nb.*, (CASE WHEN ac = bc THEN -1.0 ELSE (cb.n * 1.0 / m) / (1 - ca.n * 1.0 / m) END) / nf AS w
  FROM nb JOIN nf USING (aid, bc) JOIN cnt ca ON ca.DX = ac JOIN cnt cb ON cb.DX = bc, tot)
""" + "\nUNION ALL\n".join(f"SELECT '{f}' AS feature, {i} AS position, {r6(f'sum(w * d{i}) / any_value(m)')} AS score FROM wt, tot"
                             for i, f in enumerate(EMB))

    mixed = ["acctbal", "cycle", "nation", "third"]  # the last two are discrete
    S["relieff_mixed"] = f"""WITH c AS (SELECT c_custkey AS row_id, CAST(c_acctbal AS DOUBLE) AS acctbal, CAST(c_custkey % 97 AS DOUBLE) AS cycle,
  CAST(c_nationkey AS DOUBLE) AS nation, CAST(c_custkey % 3 AS DOUBLE) AS third, {case_codes('c_mktsegment', tb.SEGMENT_LABELS)} AS DX FROM customer),
rg AS (SELECT max(acctbal) - min(acctbal) AS r0, max(cycle) - min(cycle) AS r1 FROM c),
x AS (SELECT row_id, DX, acctbal / r0 AS x0, cycle / r1 AS x1, nation AS x2, third AS x3 FROM c, rg),
pr AS (SELECT a.row_id AS aid, a.DX AS ac, b.row_id AS bid, b.DX AS bc, abs(a.x0 - b.x0) AS d0, abs(a.x1 - b.x1) AS d1,
  CAST(a.x2 <> b.x2 AS DOUBLE) AS d2, CAST(a.x3 <> b.x3 AS DOUBLE) AS d3 FROM x a JOIN x b ON a.row_id <> b.row_id),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY aid, bc ORDER BY d0 + d1 + d2 + d3, bid) AS rn FROM pr) WHERE rn <= 10),
nf AS (SELECT aid, bc, count(*) AS nf FROM nb GROUP BY aid, bc),
cnt AS (SELECT DX, count(*) AS n FROM x GROUP BY DX), tot AS (SELECT count(*) AS m FROM x),
wt AS (SELECT nb.*, m, (CASE WHEN ac = bc THEN -1.0 ELSE (cb.n * 1.0 / m) / (1 - ca.n * 1.0 / m) END) / nf AS w
  FROM nb JOIN nf USING (aid, bc) JOIN cnt ca ON ca.DX = ac JOIN cnt cb ON cb.DX = bc, tot)
""" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {i} AS position, {r6(f'sum(w * d{i}) / any_value(m)')} AS score FROM wt" for i, f in enumerate(mixed))

    # ensemble / metrics
    S["one_hot"] = f"""WITH {WIDE} SELECT row_id, CAST(c AS INTEGER) AS class, CAST(CASE WHEN DX = c THEN 1.0 ELSE 0.0 END AS DOUBLE) AS y FROM w, range(0, 5) r(c)"""
    S["label_inverse"] = """SELECT o_orderkey AS row_id, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS idx, o_orderpriority AS label FROM orders"""
    S["soft_vote"] = f"""WITH {WIDE},
sc AS (SELECT row_id, c, sum(floor({uni(5, 's', 'row_id', 'c')} * 4) / 4.0) / 3.0 AS pm FROM w, range(0, 3) a(s), range(0, 5) b(c) GROUP BY row_id, c)
SELECT row_id, CAST(c AS INTEGER) AS pred, {r6('pm')} AS p_mean FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY pm DESC, c) AS r FROM sc) WHERE r = 1"""
    P = f"WITH {WIDE},\n{pred_ctes()},\n{fold_metric_ctes('pr')}\n"
    S["confusion_matrix"] = P + """, labs AS (SELECT DISTINCT fold, actual AS l FROM pr_cm UNION SELECT DISTINCT fold, predicted FROM pr_cm)
SELECT a.fold, a.l AS actual, b.l AS predicted, CAST(coalesce(cm.n, 0) AS BIGINT) AS n FROM labs a JOIN labs b ON a.fold = b.fold
LEFT JOIN pr_cm cm ON cm.fold = a.fold AND cm.actual = a.l AND cm.predicted = b.l"""
    S["accuracy"] = P + f"SELECT fold, {r6('avg(CASE WHEN DX = pred THEN 1.0 ELSE 0.0 END)')} AS accuracy, count(*) AS n FROM pr GROUP BY fold"
    S["auc_micro"] = P + f"SELECT fold, {r6('value')} AS auc FROM pr_m WHERE metric = 'auc'"
    # what must hold for projections onto all axes, whatever their signs
    S["pca_axes"] = """SELECT count(*) AS n_rows, CAST(64 AS DOUBLE) AS total_variance, CAST(0 AS DOUBLE) AS largest_covariance FROM embeddings"""
    S["lda_axes"] = """SELECT count(*) AS n_rows, CAST(0 AS DOUBLE) AS largest_correlation FROM embeddings"""
    S["csv_round_trip"] = """SELECT c_custkey, c_name, CAST(c_nationkey AS INTEGER) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"""
    S["csv_inferred"] = f"""SELECT c_mktsegment, CAST(sum(c_custkey) AS BIGINT) AS key_sum, {r6('avg(c_acctbal)')} AS mean_acctbal
FROM customer GROUP BY c_mktsegment"""
    S["left_join_composite"] = """SELECT a.l_orderkey, a.l_linenumber, round(CAST(a.l_quantity AS DOUBLE), 6) AS l_quantity,
    round(CAST(b.l_quantity AS DOUBLE), 6) AS returned_qty
FROM lineitem a LEFT JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND b.l_returnflag = 'R'"""
    S["left_join_duplicates"] = """SELECT o_orderkey AS row_id, o_orderpriority, l_linenumber, round(CAST(l_quantity AS DOUBLE), 6) AS l_quantity
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey"""
    nulls = f"""{CUST_RAW}, nb AS (SELECT c_custkey AS row_id, acctbal, CAST(nation_code AS DOUBLE) AS nation_code, CAST(NULL AS DOUBLE) AS nothing,
    CAST({case_codes('c_mktsegment', tb.SEGMENT_LABELS)} AS DOUBLE) AS exact,
    CASE WHEN c_custkey % 13 <> 0 THEN {case_codes('c_mktsegment', tb.SEGMENT_LABELS)} END AS DX FROM cust_raw)"""
    nfeats = ["acctbal", "nation_code", "nothing", "exact"]
    nlong = " UNION ALL ".join(f"SELECT row_id, DX, '{f}' AS feature, {f} AS value FROM nb" for f in nfeats)
    names = ", ".join(f"('{f}', {i})" for i, f in enumerate(nfeats))
    S["anova_nulls"] = f"""WITH {nulls}, lg AS ({nlong}),\n{anova_ctes('lg')},
ft AS (SELECT * FROM (VALUES {names}) t(feature, position))
SELECT feature, CAST(position AS INTEGER) AS position, {r6("CASE WHEN score = CAST('Infinity' AS DOUBLE) THEN -1.0 ELSE score END")} AS score
FROM ft LEFT JOIN fa USING (feature)"""
    S["info_gain_nulls"] = f"""WITH {nulls}, lg AS ({nlong}),\n{mi_ctes('lg')},
ft AS (SELECT * FROM (VALUES {names}) t(feature, position))
SELECT feature, CAST(position AS INTEGER) AS position, {r6('mi')} AS score FROM ft LEFT JOIN mi USING (feature)"""
    S["folds_null_labels"] = f"""WITH {nulls} SELECT row_id, DX,
    CAST((row_number() OVER (PARTITION BY DX ORDER BY {u32(1, 'row_id')}, row_id) - 1) % 4 AS INTEGER) AS fold FROM nb"""
    S["auc_micro_soft"] = f"""WITH {WIDE}, x AS (SELECT row_id, DX, c.class FROM w, (SELECT unnest(range(5)) AS class) c),
sc AS (SELECT CAST(DX = class AS INTEGER) AS y, floor({uni(9, 'row_id', 'class')} * 3 + CAST(DX = class AS INTEGER)) / 3.0 AS p FROM x),
h AS (SELECT y, p, count(*) AS n FROM sc GROUP BY y, p),
t AS (SELECT CAST(i AS INTEGER) AS i, CASE WHEN i = 0 THEN -1e-7 WHEN i = 199 THEN 1 + 1e-7 ELSE i / 199.0 END AS t FROM (SELECT unnest(range(200)) AS i)),
r AS (SELECT i, sum(CASE WHEN y = 1 AND p > t THEN n ELSE 0 END) / sum(CASE WHEN y = 1 THEN n ELSE 0 END) AS tpr,
    sum(CASE WHEN y = 0 AND p > t THEN n ELSE 0 END) / sum(CASE WHEN y = 0 THEN n ELSE 0 END) AS fpr FROM t, h GROUP BY i),
l AS (SELECT tpr, fpr, lead(tpr) OVER (ORDER BY i) AS tpr2, lead(fpr) OVER (ORDER BY i) AS fpr2 FROM r)
SELECT {r6('sum((fpr - fpr2) * (tpr + tpr2) / 2)')} AS auc FROM l WHERE tpr2 IS NOT NULL"""
    S["class_rates"] = P + f"""SELECT a.fold, a.class, {r6('a.value')} AS sensitivity, {r6('b.value')} AS specificity FROM pr_m a JOIN pr_m b
  ON a.fold = b.fold AND a.class = b.class AND a.metric = 'sensitivity' AND b.metric = 'specificity'"""
    S["fold_average"] = P + f"SELECT metric, class, {r6('avg(value)')} AS value, count(value) AS n_folds FROM pr_m GROUP BY metric, class"
    S["metrics_sink"] = f"WITH {WIDE},\n{metric_runs_sql()}\nSELECT repetition, config, fold, metric, class, {r6('value')} AS value FROM runs"
    S["boxplot_stats"] = f"""WITH {WIDE},\n{metric_runs_sql((1,))},
v AS (SELECT config, metric, value FROM runs WHERE metric IN ('accuracy', 'auc')),
qq AS (SELECT config, metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM v GROUP BY ALL)
SELECT config, metric, {r6('q1')} AS q1, {r6('median')} AS median, {r6('q3')} AS q3,
  {r6('min(CASE WHEN value >= q1 - 1.5 * (q3 - q1) THEN value END)')} AS whisker_lo,
  {r6('max(CASE WHEN value <= q3 + 1.5 * (q3 - q1) THEN value END)')} AS whisker_hi,
  count(CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 1 END) AS n_outliers, count(value) AS n
FROM v JOIN qq USING (config, metric) GROUP BY config, metric, q1, median, q3"""
    S["metric_scatter"] = f"""WITH {WIDE},\n{metric_runs_sql((1,))},
av AS (SELECT config, avg(CASE WHEN metric = 'accuracy' THEN value END) AS accuracy, avg(CASE WHEN metric = 'auc' THEN value END) AS auc FROM runs GROUP BY config)
SELECT CAST(row_number() OVER (ORDER BY config) - 1 AS INTEGER) AS config_index, config, {r6('accuracy')} AS accuracy, {r6('auc')} AS auc FROM av"""
    S["feature_rank_report"] = f"""WITH {CLEAN_W}, {', '.join(per_view)}
SELECT 'ORDERS_NB_IG' AS config, 0 AS slot, 'buyer' AS dataset, 'ig' AS method, rank, feature, {r6('mi')} AS score FROM (
  SELECT feature, mi, CAST(row_number() OVER (ORDER BY mi DESC, {pos_case(VIEW_COLS['buyer'])}) AS INTEGER) AS rank FROM mi_buyer) WHERE rank <= 3
UNION ALL
SELECT 'ORDERS_NB_IG', 1, 'basket', 'univariate', rank, feature, {r6('score')} FROM (
  SELECT feature, score, CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, {pos_case(VIEW_COLS['basket'])} DESC) AS INTEGER) AS rank
  FROM fa_basket) WHERE rank <= 2"""
    S["train_slots"] = f"""WITH {EMB_SPLIT},
nn AS (SELECT a.row_id, b.DX AS c, row_number() OVER (PARTITION BY a.row_id ORDER BY list_distance(a.v[1:32], b.v[1:32]), b.row_id) AS rk
  FROM ete a, etr b),
knn AS (SELECT row_id, c, count(*) / 2.0 AS p FROM nn WHERE rk <= 2 GROUP BY row_id, c),
trl AS (SELECT row_id, DX, i, v[i] AS x FROM etr, range(33, 65) r(i)),
tel AS (SELECT row_id, i, v[i] AS x FROM ete, range(33, 65) r(i)),
cs0 AS (SELECT DX AS c, i, count(*) AS n, avg(x) AS mu, var_pop(x) AS vp FROM trl GROUP BY DX, i),
eps AS (SELECT 1e-9 * max(v) AS eps FROM (SELECT i, var_pop(x) AS v FROM trl GROUP BY i)),
pri AS (SELECT DX AS c, count(*) / (SELECT count(*) FROM etr) AS prior FROM etr GROUP BY DX),
jl AS (SELECT t.row_id, cs0.c, sum(-0.5 * ln(2 * pi() * (cs0.vp + eps.eps)) - (t.x - cs0.mu) * (t.x - cs0.mu) / (2 * (cs0.vp + eps.eps))) AS s
  FROM tel t JOIN cs0 ON cs0.i = t.i, eps GROUP BY t.row_id, cs0.c),
jt AS (SELECT row_id, c, s + ln(prior) AS j FROM jl JOIN pri USING (c)),
jm AS (SELECT row_id, max(j) AS m FROM jt GROUP BY row_id),
js AS (SELECT row_id, sum(exp(j - m)) AS z FROM jt JOIN jm USING (row_id) GROUP BY row_id)
SELECT row_id, CAST(c AS INTEGER) AS class, {r6('p')} AS p, 0 AS slot FROM knn
UNION ALL
SELECT row_id, CAST(c AS INTEGER), {r6('exp(j - m) / z')}, 1 FROM jt JOIN jm USING (row_id) JOIN js USING (row_id)"""
    S["boosted_stumps"] = stumps_sql()
    S["forest_splits"] = forest_sql()
    S["gmm_single"] = f"""WITH {DOCS}, x AS (SELECT ln(1 + n_chars) AS a, ln(1 + n_spaces) AS b, ln(1 + n_newlines) AS c FROM d),
s AS (SELECT count(*) AS n, var_pop(a) AS aa, var_pop(b) AS bb, var_pop(c) AS cc, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac,
  covar_pop(b, c) AS bc FROM x),
l AS (SELECT n, -0.5 * n * (3 * ln(2 * pi()) + 3 + ln(aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac))) AS ll FROM s)
SELECT 1 AS k, round(ll, 3) AS log_likelihood, 9 AS n_params, round(18 - 2 * ll, 3) AS aic, round(9 * ln(n) - 2 * ll, 3) AS bic, true AS chosen FROM l"""
    S["cross_validate"] = cv_sql()
    S["repeat_experiments"] = " UNION ALL ".join(
        f"SELECT config, fold, metric, class, value, {rep} AS repetition FROM ({cv_sql(seed=rep)})" for rep in range(1, 21))
    S["order_ig_top3"] = f"""WITH {CLEAN_W}, lg AS ({long_sql('cw', VIEW_COLS['buyer'])}),\n{mi_ctes('lg')}
SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY mi DESC, {pos_case(VIEW_COLS['buyer'])}) AS INTEGER) AS rank, feature, {r6('mi')} AS score FROM mi) WHERE rank <= 3"""
    return S


def oracle_sql() -> dict[str, str]:
    return _sql()


def cv_sql(seed: int = 1, k: int = 3, name: str = "EMB_KNN_NB") -> str:
    """Cross-validation of the two-slot ensemble on the embeddings: slot a = k-NN (k=2) on
    dims 0-31, slot b = Gaussian NB on dims 32-63; SMOTE per slot before the split; folds on
    the shared keys; each fold's train and test rows z-scaled with their own statistics."""
    eps_sd = "2.220446049250313e-15"

    def slot(sfx: str, lo: int, hi: int) -> str:
        return f"""nn_{sfx} AS (SELECT a.row_id AS left_id, b.row_id AS right_id,
    row_number() OVER (PARTITION BY a.row_id ORDER BY list_distance(a.v[{lo}:{hi}], b.v[{lo}:{hi}]), b.row_id) AS rk
    FROM e a JOIN e b ON a.DX = b.DX AND a.row_id <> b.row_id WHERE a.DX IN (SELECT DX FROM need)),
sy_{sfx} AS (SELECT -(1 + s.j * ci.nclass + ci.cidx) AS row_id, s.DX, r.i, x.v[r.i] + s.u * (y.v[r.i] - x.v[r.i]) AS x
    FROM syn2 s JOIN nn_{sfx} ON nn_{sfx}.left_id = s.base_id AND nn_{sfx}.rk = s.nn_rank JOIN e x ON x.row_id = s.base_id
    JOIN e y ON y.row_id = nn_{sfx}.right_id JOIN ci ON ci.DX = s.DX, range({lo}, {hi + 1}) r(i)),
l_{sfx} AS (SELECT row_id, DX, i, v[i] AS x FROM e, range({lo}, {hi + 1}) r(i) UNION ALL SELECT row_id, DX, i, x FROM sy_{sfx})"""

    def scaled(sfx: str) -> str:
        return f"""lf_{sfx} AS (SELECT l_{sfx}.*, fo.fold FROM l_{sfx} JOIN fo USING (row_id)),
st_{sfx} AS (SELECT f.f AS tf, 'train' AS role, i, avg(x) AS m, stddev_pop(x) AS sd FROM lf_{sfx}, range(0, {k}) f(f)
    WHERE lf_{sfx}.fold <> f.f GROUP BY f.f, i
    UNION ALL SELECT fold, 'test', i, avg(x), stddev_pop(x) FROM lf_{sfx} GROUP BY fold, i),
z_{sfx} AS (SELECT st.tf, st.role, l.row_id, l.DX, l.i, (l.x - st.m) / CASE WHEN st.sd < {eps_sd} THEN 1 ELSE st.sd END AS z
    FROM lf_{sfx} l JOIN st_{sfx} st ON st.i = l.i AND ((st.role = 'train' AND l.fold <> st.tf) OR (st.role = 'test' AND l.fold = st.tf)))"""

    return f"""WITH e AS (SELECT vec_id AS row_id, label AS DX, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
cnt AS (SELECT DX, count(*) AS n FROM e GROUP BY DX),
ci AS (SELECT DX, CAST(dense_rank() OVER (ORDER BY DX) - 1 AS BIGINT) AS cidx, (SELECT count(*) FROM cnt) AS nclass FROM cnt),
need AS (SELECT DX, n AS nc, (SELECT max(n) FROM cnt) - n AS need FROM cnt WHERE (SELECT max(n) FROM cnt) - n > 0 AND n > 1),
base AS (SELECT e.row_id, e.DX, nc, need, row_number() OVER (PARTITION BY e.DX ORDER BY {u32(seed, "'base'", 'e.row_id')}, e.row_id) - 1 AS p
    FROM e JOIN need USING (DX)),
syn0 AS (SELECT row_id AS base_id, DX, nc, p, unnest(range(0, CAST(greatest(0, ceil((need - p) / nc)) AS BIGINT))) AS t FROM base),
syn AS (SELECT base_id, DX, nc, p + t * nc AS j FROM syn0),
syn2 AS (SELECT base_id, DX, j, CAST(floor({uni(seed, "'nn'", 'DX', 'j')} * least(5, nc - 1)) + 1 AS INTEGER) AS nn_rank,
    {uni(seed, "'step'", 'DX', 'j')} AS u FROM syn),
{slot("a", 1, 32)},
{slot("b", 33, 64)},
keys AS (SELECT DISTINCT row_id, DX FROM l_a),
fo AS (SELECT row_id, CAST((row_number() OVER (PARTITION BY DX ORDER BY {u32(seed, 'row_id')}, row_id) - 1) % {k} AS INTEGER) AS fold FROM keys),
{scaled("a")},
{scaled("b")},
da AS (SELECT t.tf, t.row_id AS tid, r.row_id AS rid, r.DX AS rc, sqrt(sum((t.z - r.z) * (t.z - r.z))) AS d
    FROM z_a t JOIN z_a r ON t.tf = r.tf AND t.i = r.i AND t.role = 'test' AND r.role = 'train' GROUP BY t.tf, t.row_id, r.row_id, r.DX),
ka AS (SELECT tf, tid AS row_id, rc AS c, count(*) / 2.0 AS p FROM (SELECT *, row_number() OVER (PARTITION BY tf, tid ORDER BY d, rid) AS rk FROM da)
    WHERE rk <= 2 GROUP BY tf, tid, rc),
trb AS (SELECT * FROM z_b WHERE role = 'train'), teb AS (SELECT * FROM z_b WHERE role = 'test'),
csb AS (SELECT tf, DX AS c, i, avg(z) AS mu, var_pop(z) AS vp FROM trb GROUP BY tf, DX, i),
epsb AS (SELECT tf, 1e-9 * max(vv) AS eps FROM (SELECT tf, i, var_pop(z) AS vv FROM trb GROUP BY tf, i) GROUP BY tf),
nb_n AS (SELECT tf, DX AS c, count(DISTINCT row_id) AS n FROM trb GROUP BY tf, DX),
prib AS (SELECT tf, c, n / sum(n) OVER (PARTITION BY tf) AS prior FROM nb_n),
jlb AS (SELECT t.tf, t.row_id, cs.c, sum(-0.5 * ln(2 * pi() * (cs.vp + ep.eps)) - (t.z - cs.mu) * (t.z - cs.mu) / (2 * (cs.vp + ep.eps))) AS s
    FROM teb t JOIN csb cs ON cs.tf = t.tf AND cs.i = t.i JOIN epsb ep ON ep.tf = t.tf GROUP BY t.tf, t.row_id, cs.c),
jtb AS (SELECT tf, row_id, c, s + ln(prior) AS j FROM jlb JOIN prib USING (tf, c)),
jmb AS (SELECT tf, row_id, max(j) AS m FROM jtb GROUP BY tf, row_id),
jzb AS (SELECT tf, row_id, sum(exp(j - m)) AS zz FROM jtb JOIN jmb USING (tf, row_id) GROUP BY tf, row_id),
pb AS (SELECT tf, row_id, c, exp(j - m) / zz AS p FROM jtb JOIN jmb USING (tf, row_id) JOIN jzb USING (tf, row_id)),
vote AS (SELECT tf, row_id, c, sum(p) / 2.0 AS pm FROM (SELECT tf, row_id, c, p FROM ka UNION ALL SELECT tf, row_id, c, p FROM pb) GROUP BY tf, row_id, c),
pr AS (SELECT v.tf AS fold, v.row_id, keys.DX, CAST(v.c AS INTEGER) AS pred FROM
    (SELECT *, row_number() OVER (PARTITION BY tf, row_id ORDER BY pm DESC, c) AS r FROM vote) v JOIN keys USING (row_id) WHERE r = 1),
{fold_metric_ctes('pr', 10)}
SELECT '{name}' AS config, CAST(fold AS INTEGER) AS fold, metric, CAST(class AS INTEGER) AS class, {r6('value')} AS value FROM pr_m
UNION ALL SELECT '{name}', -1, metric, CAST(class AS INTEGER), {r6('avg(value)')} FROM pr_m GROUP BY metric, class"""


def stumps_sql(rounds: int = 2, n_classes: int = 10, bins: int = 64, step: float = 0.1) -> str:
    """Softmax boosting with trees of depth 1: gradient p - y, hessian 2 p (1 - p), penalty 1, least child hessian 1."""
    parts = [f"""{EMB_SPLIT},
x AS (SELECT row_id, i, v[i] AS x FROM etr, range(1, 65) r(i)),
rk AS (SELECT i, x, row_number() OVER (PARTITION BY i ORDER BY x) AS rn, count(*) OVER (PARTITION BY i) AS n FROM x),
cuts AS (SELECT DISTINCT i, x AS cut FROM rk, range(1, {bins}) b(b) WHERE rn = greatest(1, CAST(ceil(b * n / {bins}.0) AS BIGINT))),
side AS (SELECT c.i, c.cut, x.row_id FROM cuts c JOIN x ON x.i = c.i AND x.x <= c.cut),
m0 AS (SELECT row_id, DX, CAST(k AS INTEGER) AS k, CAST(0 AS DOUBLE) AS m FROM etr, range(0, {n_classes}) c(k))"""]
    for t in range(rounds):
        parts.append(f"""z{t} AS (SELECT row_id, sum(exp(m)) AS z FROM m{t} GROUP BY row_id),
p{t} AS (SELECT row_id, k, exp(m) / z AS p, CAST(DX = k AS INTEGER) AS y FROM m{t} JOIN z{t} USING (row_id)),
g{t} AS (SELECT row_id, k, p - y AS g, 2 * p * (1 - p) AS h FROM p{t}),
s{t} AS (SELECT k, sum(g) AS g, sum(h) AS h FROM g{t} GROUP BY k),
l{t} AS (SELECT k, i, cut, sum(g) AS gl, sum(h) AS hl FROM side JOIN g{t} USING (row_id) GROUP BY k, i, cut),
c{t} AS (SELECT k, i, cut, gl, hl, s.g - gl AS gr, s.h - hl AS hr,
    round(gl * gl / (hl + 1) + (s.g - gl) * (s.g - gl) / (s.h - hl + 1) - s.g * s.g / (s.h + 1), 6) AS gain
    FROM l{t} JOIN s{t} s USING (k) WHERE hl >= 1 AND s.h - hl >= 1),
b{t} AS (SELECT k, i, cut, -{step} * gl / (hl + 1) AS wl, -{step} * gr / (hr + 1) AS wr
    FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY gain DESC, i, cut) AS r FROM c{t} WHERE gain > 0.000001) q WHERE r = 1),
m{t + 1} AS (SELECT m.row_id, m.DX, m.k, m.m + coalesce(CASE WHEN x.x <= b.cut THEN b.wl ELSE b.wr END, 0) AS m
    FROM m{t} m LEFT JOIN b{t} b ON b.k = m.k LEFT JOIN x ON x.row_id = m.row_id AND x.i = b.i)""")
    rows = " UNION ALL ".join(f"SELECT {t} AS round, k AS class, 'e' || lpad(CAST(i - 1 AS VARCHAR), 2, '0') AS feature, "
                              f"{r6('cut')} AS cut, {r6('wl')} AS left, {r6('wr')} AS right FROM b{t}" for t in range(rounds))
    return "WITH " + ",\n".join(parts) + "\n" + rows.replace("AS left", 'AS "left"').replace("AS right", 'AS "right"')


def forest_sql(trees: int = 6, levels: int = 2, most: int = 8, seed: int = 1) -> str:
    """Upper levels of extremely randomised trees on the embeddings; draws are md5(seed|tree|node|feature)."""
    parts = [f"""e AS (SELECT vec_id AS row_id, label AS DX, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
x AS (SELECT row_id, DX, i, v[i] AS x FROM e, range(1, 65) r(i)),
n0 AS (SELECT row_id, DX, CAST(t AS INTEGER) AS tree, '1' AS node FROM e, range(0, {trees}) r(t))"""]
    for t in range(levels):
        parts.append(f"""r{t} AS (SELECT tree, node, i, min(x) AS lo, max(x) AS hi, count(*) AS n, min(x.DX) <> max(x.DX) AS mixed
    FROM n{t} JOIN x USING (row_id) GROUP BY tree, node, i),
h{t} AS (SELECT *, md5('{seed}|' || CAST(tree AS VARCHAR) || '|' || node || '|' || CAST(i - 1 AS VARCHAR)) AS h FROM r{t} WHERE hi > lo AND mixed),
d{t} AS (SELECT tree, node, i, n, lo + CAST(('0x' || substr(h, 9, 8)) AS BIGINT) / 4294967296.0 * (hi - lo) AS cut,
    row_number() OVER (PARTITION BY tree, node ORDER BY CAST(('0x' || substr(h, 1, 8)) AS BIGINT), i) AS nth FROM h{t}),
k{t} AS (SELECT d.tree, d.node, d.i, d.n, d.cut, d.nth, x.DX, count(*) AS c, count(*) FILTER (x.x <= d.cut) AS l
    FROM d{t} d JOIN n{t} m ON m.tree = d.tree AND m.node = d.node JOIN x ON x.row_id = m.row_id AND x.i = d.i
    WHERE d.nth <= {most} GROUP BY d.tree, d.node, d.i, d.n, d.cut, d.nth, x.DX),
q{t} AS (SELECT tree, node, i, n, cut, nth, round(sum(l * l) / CAST(sum(l) AS DOUBLE) + sum((c - l) * (c - l)) / CAST(n - sum(l) AS DOUBLE)
    - sum(c * c) / CAST(n AS DOUBLE), 9) AS decrease FROM k{t} GROUP BY tree, node, i, n, cut, nth HAVING sum(l) > 0 AND sum(l) < n),
b{t} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY decrease DESC, nth) AS r FROM q{t}) WHERE r = 1),
n{t + 1} AS (SELECT n.row_id, n.DX, n.tree, n.node || CASE WHEN x.x <= b.cut THEN '0' ELSE '1' END AS node
    FROM n{t} n JOIN b{t} b USING (tree, node) JOIN x ON x.row_id = n.row_id AND x.i = b.i)""")
    rows = " UNION ALL ".join(f"SELECT tree, node, 'e' || lpad(CAST(i - 1 AS VARCHAR), 2, '0') AS feature, {r6('cut')} AS cut, n, {r6('decrease')} AS decrease "
                              f"FROM b{t}" for t in range(levels))
    return "WITH " + ",\n".join(parts) + "\n" + rows


def grid_sql() -> str:
    """Views at a quarter, half and three quarters of their features, by information gain, ANOVA F and greedy mRMR."""
    full = VIEW_COLS["full"]
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS f, '{b}' AS g, CAST({q(a)} AS DOUBLE) AS fv, CAST({q(b)} AS DOUBLE) AS gv, "
                               f"CAST(count(*) AS DOUBLE) AS n FROM cw WHERE {q(a)} IS NOT NULL AND {q(b)} IS NOT NULL GROUP BY ALL"
                               for i, a in enumerate(full) for b in full[i + 1:])
    parts = [f"""{CLEAN_W}, lg AS ({long_sql('cw', full)}),
{mi_ctes('lg')},
{anova_ctes('lg')},
pxy AS ({pairs}),
pfx AS (SELECT f, g, fv, sum(n) AS nf FROM pxy GROUP BY ALL),
pgx AS (SELECT f, g, gv, sum(n) AS ng FROM pxy GROUP BY ALL),
pnt AS (SELECT f, g, sum(n) AS nt FROM pxy GROUP BY ALL),
half AS (SELECT f, g, sum(n / nt * ln(n * nt / (nf * ng))) AS r FROM pxy JOIN pfx USING (f, g, fv) JOIN pgx USING (f, g, gv) JOIN pnt USING (f, g) GROUP BY f, g),
red AS (SELECT f, g, r FROM half UNION ALL SELECT g, f, r FROM half)"""]
    rows = []
    for v, cols in VIEW_COLS.items():
        names = ", ".join(f"'{c}'" for c in cols)
        sizes = {s: max(1, len(cols) * k // 4) for s, k in (("S", 1), ("M", 2), ("L", 3))}
        parts.append(f"rel_{v} AS (SELECT feature, mi, {pos_case(cols)} AS position FROM mi WHERE feature IN ({names}))")
        parts.append(f"p1_{v} AS (SELECT feature, mi AS score FROM rel_{v} ORDER BY mi DESC, position LIMIT 1)")
        for n in range(2, sizes["L"] + 1):
            chosen = " UNION ALL ".join(f"SELECT feature FROM p{i}_{v}" for i in range(1, n))
            parts.append(f"c{n}_{v} AS ({chosen})")
            parts.append(f"""p{n}_{v} AS (SELECT rel.feature, any_value(rel.mi) / (avg(red.r) + 0.0001) AS score FROM rel_{v} rel
  JOIN red ON red.f = rel.feature JOIN c{n}_{v} c ON c.feature = red.g WHERE rel.feature NOT IN (SELECT feature FROM c{n}_{v})
  GROUP BY rel.feature ORDER BY score DESC, any_value(rel.position) LIMIT 1)""")
        ranked = [f"SELECT 'ig' AS selector, feature, mi AS score, row_number() OVER (ORDER BY mi DESC, position) AS rank FROM rel_{v}",
                  f"SELECT 'univariate', feature, score, row_number() OVER (ORDER BY score DESC NULLS LAST, {pos_case(cols)} DESC) FROM fa WHERE feature IN ({names})",
                  *[f"SELECT 'mrmr', feature, score, {i} FROM p{i}_{v}" for i in range(1, sizes["L"] + 1)]]
        parts.append(f"rk_{v} AS ({' UNION ALL '.join(f'({r})' for r in ranked)})")
        values = ", ".join(f"('{s}', {n})" for s, n in sizes.items())
        rows.append(f"SELECT '{v}' AS dataset, selector, size, CAST(n AS INTEGER) AS n, CAST(rank AS INTEGER) AS rank, feature, {r6('score')} AS score "
                    f"FROM rk_{v}, (VALUES {values}) g(size, n) WHERE rank <= n")
    return "WITH " + ",\n".join(parts) + "\n" + " UNION ALL ".join(rows)
