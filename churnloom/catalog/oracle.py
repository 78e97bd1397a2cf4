"""SQL counterparts of the named queries, for DuckDB over the same tables."""

from __future__ import annotations

from churnloom.schema import COLUMNS, CUSTOMER_RULES, KIND_TYPES, NUMERIC_KINDS
from churnloom.sources.derived import CUTOFF, INTERNET_OPTION_PERIODS

NUMERIC = [r.name for r in CUSTOMER_RULES if r.kind in NUMERIC_KINDS]
TEXT = [r.name for r in CUSTOMER_RULES if r.kind not in NUMERIC_KINDS]

# Text columns to encode, with their values in order.
ONE_HOT_COLUMNS = {
    r.name: sorted(r.allowed) for r in CUSTOMER_RULES if r.allowed and r.name != "Churn"
}

_OPTIONS = {
    name: f"CASE WHEN k%5=0 THEN 'No internet service' WHEN k%{p}<2 THEN 'Yes' ELSE 'No' END"
    for name, p in INTERNET_OPTION_PERIODS.items()
}
_EXPR = {
    "customerID": "concat('C', lpad(CAST(k AS VARCHAR), 8, '0'))",
    "gender": "CASE WHEN k%2=0 THEN 'Female' ELSE 'Male' END",
    "SeniorCitizen": "CASE WHEN c_acctbal<0 THEN 1 ELSE 0 END",
    "Partner": "CASE WHEN k%50=7 THEN 'na' WHEN c_nationkey%2=0 THEN 'Yes' ELSE 'No' END",
    "Dependents": "CASE WHEN c_nationkey%3=0 THEN 'Yes' ELSE 'No' END",
    "tenure": f"CAST(floor(datediff('day', f, TIMESTAMP '{CUTOFF}')/30.0) AS INTEGER)",
    "PhoneService": "CASE WHEN k%10=0 THEN 'No' ELSE 'Yes' END",
    "MultipleLines": "CASE WHEN k%10=0 THEN 'No phone service' WHEN k%7<3 THEN 'Yes' ELSE 'No' END",
    "InternetService": "CASE WHEN k%5=0 THEN 'No' WHEN k%5=1 THEN 'DSL' ELSE 'Fiber optic' END",
    **_OPTIONS,
    "Contract": "CASE WHEN n<6 THEN 'Month-to-month' WHEN n<10 THEN 'One year' ELSE 'Two year' END",
    "PaperlessBilling": "CASE WHEN k%3=0 THEN 'Yes' ELSE 'No' END",
    "PaymentMethod": (
        "CASE k%4 WHEN 0 THEN 'Electronic check' WHEN 1 THEN 'Mailed check' "
        "WHEN 2 THEN 'Bank transfer (automatic)' ELSE 'Credit card (automatic)' END"
    ),
    "MonthlyCharges": "CASE WHEN k%41=3 THEN NULL ELSE round(tot/n/2500, 2) END",
    "TotalCharges": (
        "CASE WHEN k%37=5 THEN ' ' "
        "ELSE CAST(CAST(round(tot/1000, 2) AS DECIMAL(10,2)) AS VARCHAR) END"
    ),
    "Churn": "CASE WHEN n_later=0 THEN 'Yes' ELSE 'No' END",
}
_COLS = ", ".join(COLUMNS)

RAW = f"""WITH history AS (
  SELECT o_custkey,
         count(*) FILTER (o_orderdate < TIMESTAMP '{CUTOFF}') AS n,
         count(*) FILTER (o_orderdate >= TIMESTAMP '{CUTOFF}') AS n_later,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2)))
              FILTER (o_orderdate < TIMESTAMP '{CUTOFF}') AS DOUBLE) AS tot,
         min(o_orderdate) FILTER (o_orderdate < TIMESTAMP '{CUTOFF}') AS f
  FROM orders GROUP BY o_custkey),
base AS (
  SELECT c_custkey AS k, customer.*, history.*
  FROM customer JOIN history ON c_custkey = o_custkey WHERE n > 0),
once AS (SELECT k, {", ".join(f"{_EXPR[c]} AS {c}" for c in COLUMNS)} FROM base),
raw AS (SELECT {_COLS} FROM once UNION ALL SELECT {_COLS} FROM once WHERE k%60=0)
"""
_BUCKET = "CAST(concat('0x', substr(md5(concat(customerID, '|42')), 1, 8)) AS BIGINT)"
_SPLIT = f"CASE WHEN {_BUCKET} % 10000 < 2000 THEN 'test' ELSE 'train' END AS split"
_NUMBER = "try_cast(TotalCharges AS DOUBLE)"


def _swap(replacements: dict[str, str]) -> str:
    return ", ".join(f"{replacements[c]} AS {c}" if c in replacements else c for c in COLUMNS)


_NA_ALL = {c: f"nullif({c}, 'na')" for c in TEXT} | {"TotalCharges": "nullif(TotalCharges, 'na')"}
DISTINCT = RAW + ", uniq AS (SELECT DISTINCT * FROM raw)\n"
PATCHY = (
    DISTINCT
    + f", patchy AS (SELECT {_swap({**_NA_ALL, 'TotalCharges': _NUMBER})}, {_SPLIT} FROM uniq)\n"
)
CLEANED = (
    DISTINCT
    + f", tokens AS (SELECT {_swap(_NA_ALL)} FROM uniq)\n"
    + ", cleaned AS (SELECT * FROM tokens WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in COLUMNS)
    + ")\n"
)
INGESTED = (
    CLEANED
    + f", ingested AS (SELECT {_swap({'TotalCharges': _NUMBER})}, {_SPLIT} FROM cleaned)\n"
)
EXPLORED = (
    RAW
    + f", coerced AS (SELECT {_swap({'TotalCharges': _NUMBER})} FROM raw)\n"
    + ", explored AS (SELECT * FROM coerced WHERE TotalCharges IS NOT NULL)\n"
)
LABELED = (
    DISTINCT
    + f", labeled AS (SELECT *, CAST(CASE Churn WHEN 'Yes' THEN 1 ELSE 0 END AS TINYINT) AS label,"
    + f" {_SPLIT} FROM uniq)\n"
)
SCORED = (
    LABELED
    + f"""
, scores AS (
  SELECT customerID, split, label, 0 AS position, 'tenure' AS model,
         round(1 - CAST(tenure AS DOUBLE)/100, 2) AS score FROM labeled
  UNION ALL SELECT customerID, split, label, 1, 'contract',
         CAST(CASE Contract WHEN 'Month-to-month' THEN 0.75 WHEN 'One year' THEN 0.5 ELSE 0.25 END
              AS DOUBLE) FROM labeled
  UNION ALL SELECT customerID, split, label, 2, 'total',
         1 - least(coalesce({_NUMBER}, 0.0::DOUBLE), 10000.0::DOUBLE)/10000 FROM labeled)
, scored AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM scores)
"""
)


def _union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


def _nulls(table: str, columns: list[str]) -> str:
    return _union(
        [
            f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_missing FROM {table}"
            for c in columns
        ]
    )


def _box(value: str) -> str:
    return (
        EXPLORED
        + f"""
, q AS (SELECT Churn, count(*) AS n_rows, quantile_cont({value}, 0.25) AS q1,
        quantile_cont({value}, 0.5) AS median, quantile_cont({value}, 0.75) AS q3
        FROM explored WHERE {value} IS NOT NULL GROUP BY Churn)
SELECT e.Churn, n_rows, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(min({value}) FILTER (inside), 6) AS whisker_low,
  round(max({value}) FILTER (inside), 6) AS whisker_high,
  count(*) FILTER (NOT inside) AS n_outliers
FROM (SELECT x.Churn, x.{value}, q.* EXCLUDE Churn,
        x.{value} BETWEEN q1 - 1.5*(q3-q1) AND q3 + 1.5*(q3-q1) AS inside
      FROM explored x JOIN q ON x.Churn = q.Churn WHERE x.{value} IS NOT NULL) e
GROUP BY e.Churn, n_rows, q1, median, q3"""
    )


def _cells(reference: str, current: str, columns: list[str], kind: str) -> str:
    return _union(
        [
            f"SELECT '{c}' AS \"column\", '{side}' AS side, CAST({c} AS {kind}) AS v FROM {table}"
            for c in columns
            for side, table in (("reference", reference), ("current", current))
        ]
    )


def _ks_parts(name: str, cells: str, fill: str) -> str:
    """CTEs computing the KS table ``<name>_ks`` from (column, side, v) cells."""
    return f"""
, {name}_cells AS ({cells})
, {name}_fill AS ({fill})
, {name}_filled AS (
  SELECT c."column", c.side, coalesce(c.v, f.v) AS v, c.v IS NULL AS was_missing
  FROM {name}_cells c JOIN {name}_fill f ON c."column" = f."column" AND c.side = f.side)
, {name}_counts AS (
  SELECT "column", v, count(*) FILTER (side='reference') AS a,
         count(*) FILTER (side='current') AS b FROM {name}_filled GROUP BY ALL)
, {name}_cums AS (
  SELECT "column", sum(a) OVER w AS ca, sum(b) OVER w AS cb,
         sum(a) OVER (PARTITION BY "column") AS ta, sum(b) OVER (PARTITION BY "column") AS tb
  FROM {name}_counts WINDOW w AS (PARTITION BY "column" ORDER BY v))
, {name}_sizes AS (
  SELECT "column", count(*) FILTER (side='reference') AS n_reference,
    count(*) FILTER (side='current') AS n_current,
    count(*) FILTER (side='reference' AND was_missing) AS missing_reference,
    count(*) FILTER (side='current' AND was_missing) AS missing_current
  FROM {name}_filled GROUP BY "column")
, {name}_ks AS (
  SELECT k."column", k.ks_statistic, s.* EXCLUDE "column" FROM (
    SELECT "column", max(abs(CAST(ca AS DOUBLE)/ta - CAST(cb AS DOUBLE)/tb)) AS ks_statistic
    FROM {name}_cums GROUP BY "column") k JOIN {name}_sizes s ON k."column" = s."column")
"""


def _num_fill(name: str) -> str:
    return f'SELECT "column", side, median(v) AS v FROM {name}_cells GROUP BY "column", side'


def _text_fill(name: str) -> str:
    return f"""SELECT s."column", s.side, coalesce(m.v, 'Unknown') AS v
  FROM (SELECT DISTINCT "column", side FROM {name}_cells) s LEFT JOIN (
    SELECT "column", side, v FROM (
      SELECT "column", side, v,
        row_number() OVER (PARTITION BY "column", side ORDER BY count(*) DESC, v) AS r
      FROM {name}_cells WHERE v IS NOT NULL GROUP BY "column", side, v) WHERE r = 1) m
  ON s."column" = m."column" AND s.side = m.side"""


def _ks(reference: str, current: str) -> str:
    return _ks_parts(
        "num", _cells(reference, current, NUMERIC, "DOUBLE"), _num_fill("num")
    ) + _ks_parts("txt", _cells(reference, current, TEXT, "VARCHAR"), _text_fill("txt"))


_KS_ALL = "(SELECT * FROM num_ks UNION ALL SELECT * FROM txt_ks)"
_REPORT = f"""
, report AS (
  SELECT "column", ks_statistic,
    CASE WHEN x < 0.2 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE,
      2*list_sum(list_transform(range(1, 101), lambda j:
        (CASE WHEN j%2=1 THEN 1 ELSE -1 END) * exp(-2.0::DOUBLE*j*j*x*x))))) END AS p_value,
    missing_reference, missing_current, n_reference, n_current
  FROM (SELECT *, ks_statistic * sqrt(CAST(n_reference AS DOUBLE)*n_current
                                      /(n_reference+n_current)) AS x FROM {_KS_ALL}))
"""
_REPORT_SELECT = """
SELECT "column", round(ks_statistic, 6) AS ks_statistic, round(p_value, 6) AS p_value,
  p_value < 0.05 AS drift_found, missing_reference, missing_current, n_reference, n_current
FROM report"""
_TRAIN_TEST = (
    ", train AS (SELECT * FROM ingested WHERE split='train')"
    ", test AS (SELECT * FROM ingested WHERE split='test')\n"
)
_PATCHY_PARTS = (
    ", train AS (SELECT * FROM patchy WHERE split='train')"
    ", test AS (SELECT * FROM patchy WHERE split='test')\n"
)
_INGEST_REPORT = INGESTED + _TRAIN_TEST + _ks("train", "test") + _REPORT
_SHIFTED = (
    PATCHY
    + ", shifted AS (SELECT * REPLACE (MonthlyCharges + 50 AS MonthlyCharges, "
    + "'Two year' AS Contract) FROM patchy)\n"
    + _ks("patchy", "shifted")
    + _REPORT
)


def _metrics(by: str, source: str = "scored") -> str:
    return f"""
, cells AS (SELECT {by}, count(*) FILTER (label=0 AND prediction=0) AS tn,
    count(*) FILTER (label=0 AND prediction=1) AS fp,
    count(*) FILTER (label=1 AND prediction=0) AS fn,
    count(*) FILTER (label=1 AND prediction=1) AS tp FROM {source} GROUP BY {by})
, rates AS (SELECT *, CAST(tp+tn AS DOUBLE)/(tn+fp+fn+tp) AS accuracy,
    coalesce(CAST(tp AS DOUBLE)/nullif(tp+fp, 0), 0) AS "precision",
    coalesce(CAST(tp AS DOUBLE)/nullif(tp+fn, 0), 0) AS recall,
    coalesce(2.0::DOUBLE*tp/nullif(2*tp+fp+fn, 0), 0) AS f1_score FROM cells)
"""


def _auc(by: str, score: str = "score", source: str = "scored") -> str:
    """Mann-Whitney from mid-ranks, independent of the threshold form."""
    return f"""
, ranked AS (SELECT {by}, label,
    rank() OVER (PARTITION BY {by} ORDER BY {score})
      + (count(*) OVER (PARTITION BY {by}, {score}) - 1)/2.0::DOUBLE AS r FROM {source})
, auc AS (SELECT {by}, (sum(r) FILTER (label=1) - p*(p+1)/2.0::DOUBLE)/(p*m) AS roc_auc
  FROM (SELECT *, CAST(count(*) FILTER (label=1) OVER (PARTITION BY {by}) AS DOUBLE) AS p,
          CAST(count(*) FILTER (label=0) OVER (PARTITION BY {by}) AS DOUBLE) AS m FROM ranked)
  GROUP BY {by}, p, m)
"""


_CURVE = """
, points AS (SELECT model, score, count(*) FILTER (label=1) AS pos,
    count(*) FILTER (label=0) AS neg FROM scored GROUP BY model, score)
, curve AS (SELECT model, score AS threshold,
    CAST(sum(pos) OVER w AS DOUBLE) AS cp, CAST(sum(neg) OVER w AS DOUBLE) AS cn,
    CAST(sum(pos) OVER (PARTITION BY model) AS DOUBLE) AS tp,
    CAST(sum(neg) OVER (PARTITION BY model) AS DOUBLE) AS tn
  FROM points WINDOW w AS (PARTITION BY model ORDER BY score DESC))
"""
_RATE_SELECT = (
    "round(accuracy, 6) AS accuracy, round(\"precision\", 6) AS \"precision\", "
    "round(recall, 6) AS recall, round(f1_score, 6) AS f1_score"
)
_SCHEMA_ROWS = _union(
    [
        f"SELECT '{r.name}' AS \"column\", 'present' AS rule, 'yes' AS expected, "
        f"'yes' AS observed, true AS passed FROM (SELECT count({r.name}) FROM raw)"
        for r in CUSTOMER_RULES
    ]
    + [
        f"SELECT '{r.name}', 'type', '{r.kind}', t, t IN "
        f"({', '.join(repr(x) for x in KIND_TYPES[r.kind])}) FROM (SELECT CASE "
        f"typeof(any_value({r.name})) WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
        f"WHEN 'VARCHAR' THEN 'string' END AS t FROM raw)"
        for r in CUSTOMER_RULES
    ]
)


def _range_rows(table: str) -> str:
    rows = []
    for r in CUSTOMER_RULES:
        for side, bound, sign in (("min", r.minimum, ">="), ("max", r.maximum, "<=")):
            if bound is not None:
                rows.append(
                    f"SELECT '{r.name}' AS \"column\", '{side}' AS rule, "
                    f"CAST({bound} AS DOUBLE) AS expected, "
                    f"CAST({side}({r.name}) AS DOUBLE) AS observed, "
                    f"{side}({r.name}) {sign} {bound} AS passed FROM {table}"
                )
    return _union(rows)


def _status_rows(split_name: str) -> str:
    bounds = sum((r.minimum is not None) + (r.maximum is not None) for r in CUSTOMER_RULES)
    fixed = 2 * len(CUSTOMER_RULES)
    return (
        f"SELECT '{split_name}' AS split, CAST({fixed + bounds} AS BIGINT) AS n_rules, "
        f"count(*) FILTER (NOT passed) AS n_failed, bool_and(passed) AS passed "
        f"FROM ({_range_rows(split_name)})"
    )


_DOMAINS = _union(
    [
        f"SELECT '{r.name}' AS \"column\", 'allowed' AS rule, '{' | '.join(r.allowed)}' AS expected, "
        f"concat(CAST(n AS VARCHAR), ' other values') AS observed, n = 0 AS passed FROM "
        f"(SELECT count(*) FILTER ({r.name} NOT IN ({', '.join(repr(a) for a in r.allowed)})) AS n "
        f"FROM raw)"
        for r in CUSTOMER_RULES
        if r.allowed
    ]
)


def _flag(column: str, yes: str = "Yes", no: str = "No") -> str:
    return f"CASE {column} WHEN '{yes}' THEN 1 WHEN '{no}' THEN 0 END AS {column}"


def _mode(column: str) -> str:
    return (
        f"coalesce({column}, (SELECT {column} FROM patchy WHERE {column} IS NOT NULL "
        f"GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1)) AS {column}"
    )


def _median(column: str) -> str:
    return (
        f"coalesce(CAST({column} AS DOUBLE), (SELECT median({column}) FROM patchy)) AS {column}"
    )


_PROFILE_TYPES = {"SeniorCitizen": "int", "tenure": "int", "MonthlyCharges": "double"}

ORACLE: dict[str, str] = {
    "scan_customers": RAW + "SELECT * FROM raw",
    "drop_system_columns": RAW + "SELECT * FROM raw",
    "scan_csv": RAW + "SELECT * FROM raw",
    "to_json_records": RAW
    + "SELECT * FROM raw",
    "append_records": RAW + "SELECT * FROM raw UNION ALL SELECT * FROM raw",
    "write_feature_store": CLEANED + f"SELECT *, {_SPLIT} FROM cleaned",
    "route_by_validity": INGESTED
    + _TRAIN_TEST
    + f", status AS ({_status_rows('train')} UNION ALL {_status_rows('test')}) "
    "SELECT split, CASE WHEN (SELECT bool_and(passed) FROM status) THEN 'valid' "
    "ELSE 'invalid' END AS routed_to, customerID FROM ingested",
    "replace_na_token": RAW + f"SELECT {_swap(_NA_ALL)} FROM raw",
    "dropna_any": RAW
    + f"SELECT * FROM (SELECT {_swap(_NA_ALL)} FROM raw) WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in COLUMNS),
    "dropna_subset": EXPLORED + "SELECT * FROM explored",
    "coerce_numeric": EXPLORED + "SELECT * FROM coerced",
    "split_target": CLEANED + "SELECT * EXCLUDE Churn, Churn AS target FROM cleaned",
    "columns_by_type": PATCHY
    + "SELECT *, CASE WHEN \"column\" IN ("
    + ", ".join(repr(c) for c in NUMERIC)
    + ") THEN 'numeric' ELSE 'categorical' END AS kind FROM ("
    + _nulls("patchy", [c for c in COLUMNS if c not in ("customerID", "Churn")])
    + ")",
    "binary_encode": EXPLORED
    + "SELECT customerID, "
    + ", ".join(
        [
            _flag("gender", "Male", "Female"),
            *(
                _flag(c)
                for c in ("Partner", "Dependents", "PhoneService", "PaperlessBilling", "Churn")
            ),
        ]
    )
    + " FROM explored",
    "encode_target": RAW
    + "SELECT customerID, Churn, CAST(CASE Churn WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END "
    "AS TINYINT) AS label FROM raw",
    "fill_median": PATCHY
    + f"SELECT customerID, {', '.join(map(_median, NUMERIC))} FROM patchy",
    "fill_mode": PATCHY
    + f"SELECT customerID, {', '.join(map(_mode, ONE_HOT_COLUMNS))} FROM patchy",
    "null_counts": RAW
    + f", t AS (SELECT {_swap({**_NA_ALL, 'TotalCharges': _NUMBER})} FROM raw)\n"
    + _nulls("t", COLUMNS),
    "drop_duplicates": DISTINCT + "SELECT * FROM uniq",
    "duplicate_count": DISTINCT
    + "SELECT (SELECT count(*) FROM raw) - (SELECT count(*) FROM uniq) AS duplicate_rows",
    "table_profile": RAW
    + _union(
        [
            f"SELECT {i} AS position, '{c}' AS \"column\", "
            f"'{_PROFILE_TYPES.get(c, 'string')}' AS dtype, count(*) AS n_rows, "
            f"count(*) FILTER ({c} IS NULL) AS n_missing FROM raw"
            for i, c in enumerate(COLUMNS)
        ]
    ),
    "churn_counts": EXPLORED + "SELECT Churn, count(*) AS n FROM explored GROUP BY Churn",
    "contract_by_churn": EXPLORED
    + "SELECT Contract, Churn, count(*) AS n FROM explored GROUP BY Contract, Churn",
    "box_monthly_by_churn": _box("MonthlyCharges"),
    "box_total_by_churn": _box("TotalCharges"),
    "tenure_histogram": EXPLORED
    + """
, lim AS (SELECT CAST(min(tenure) AS DOUBLE) AS lo, CAST(max(tenure) AS DOUBLE) AS hi FROM explored)
, binned AS (SELECT Churn, least(CAST(floor((tenure-lo)*30.0::DOUBLE/(hi-lo)) AS INTEGER), 29) AS bin
             FROM explored, lim)
, grid AS (SELECT Churn, CAST(bin AS INTEGER) AS bin
           FROM (SELECT DISTINCT Churn FROM explored), range(30) t(bin))
, filled AS (SELECT g.Churn, g.bin, count(b.bin) AS n
             FROM grid g LEFT JOIN binned b ON g.Churn=b.Churn AND g.bin=b.bin GROUP BY g.Churn, g.bin)
SELECT Churn, bin, round(lo + bin*((hi-lo)/30), 6) AS bin_start,
  round(lo + (bin+1)*((hi-lo)/30), 6) AS bin_end, n,
  CAST(sum(n) OVER (PARTITION BY bin ORDER BY Churn) AS BIGINT) AS stacked_n
FROM filled, lim""",
    "tenure_density": EXPLORED
    + """
, lim AS (SELECT CAST(min(tenure) AS DOUBLE) AS lo, CAST(max(tenure) AS DOUBLE) AS hi FROM explored)
, sp AS (SELECT Churn, count(*) AS n, pow(count(*), -0.2::DOUBLE)*stddev_samp(tenure) AS h
         FROM explored GROUP BY Churn)
SELECT e.Churn, CAST(g.p AS INTEGER) AS point, round(lo + g.p*((hi-lo)/199), 6) AS x,
  round(sum(exp(-0.5::DOUBLE*pow((lo + g.p*((hi-lo)/199) - e.tenure)/h, 2)))
        /(n*h*sqrt(2*pi())), 6) AS density,
  round(sum(exp(-0.5::DOUBLE*pow((lo + g.p*((hi-lo)/199) - e.tenure)/h, 2)))
        *((hi-lo)/30)/(h*sqrt(2*pi())), 6) AS height
FROM explored e JOIN sp ON e.Churn=sp.Churn, lim, range(200) g(p)
GROUP BY e.Churn, g.p, lo, hi, n, h""",
    "scale_pos_weight": LABELED
    + "SELECT count(*) FILTER (label=0) AS n_negative, count(*) FILTER (label=1) AS n_positive, "
    "round(CAST(count(*) FILTER (label=0) AS DOUBLE)/count(*) FILTER (label=1), 6) "
    "AS scale_pos_weight FROM labeled",
    "balanced_weights": LABELED
    + "SELECT customerID, label, round(CAST(count(*) OVER () AS DOUBLE)"
    "/(2*count(*) OVER (PARTITION BY label)), 6) AS weight FROM labeled",
    "prefix_sum": """SELECT o_orderpriority, o_totalprice, n,
  CAST(sum(n) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS BIGINT) AS n_cum,
  CAST(sum(n) OVER (PARTITION BY o_orderpriority) AS BIGINT) AS n_total
FROM (SELECT o_orderpriority, o_totalprice, count(*) AS n FROM orders GROUP BY ALL)""",
    "grouped_quantiles": """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1,
  round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
  round(quantile_cont(l_extendedprice, 0.75), 6) AS q3 FROM lineitem GROUP BY l_returnflag""",
    "holdout_split": DISTINCT + f"SELECT customerID, {_SPLIT} FROM uniq",
    "holdout_split_exact": DISTINCT
    + "SELECT customerID, CASE WHEN r <= ceil(0.2*t) THEN 'test' ELSE 'train' END AS split FROM "
    f"(SELECT customerID, row_number() OVER (ORDER BY {_BUCKET}, customerID) AS r, "
    "count(*) OVER () AS t FROM uniq)",
    "hash_folds": DISTINCT + f"SELECT customerID, CAST({_BUCKET} % 3 AS INTEGER) AS fold FROM uniq",
    "stratified_folds": DISTINCT
    + "SELECT customerID, Churn, CAST((row_number() OVER (PARTITION BY Churn ORDER BY "
    f"{_BUCKET}, customerID) - 1) % 3 AS INTEGER) AS fold FROM uniq",
    "validate_schema": RAW + _SCHEMA_ROWS,
    "validate_ranges": EXPLORED + _range_rows("coerced"),
    "validate_domains": RAW + _DOMAINS,
    "validation_status": INGESTED
    + _TRAIN_TEST
    + _status_rows("train")
    + " UNION ALL "
    + _status_rows("test"),
    "ks_numeric": PATCHY
    + _PATCHY_PARTS
    + _ks("train", "test")
    + 'SELECT "column", round(ks_statistic, 6) AS ks_statistic, n_reference, n_current, '
    "missing_reference, missing_current FROM num_ks",
    "ks_categorical": PATCHY
    + _PATCHY_PARTS
    + _ks("train", "test")
    + 'SELECT "column", round(ks_statistic, 6) AS ks_statistic, n_reference, n_current, '
    "missing_reference, missing_current FROM txt_ks",
    "drift_report": _INGEST_REPORT + _REPORT_SELECT,
    "drift_report_shifted": _SHIFTED + _REPORT_SELECT,
    "drift_overall": _INGEST_REPORT
    + "SELECT bool_or(p_value < 0.05) AS overall_drift_found, count(*) AS n_columns, "
    "count(*) FILTER (p_value < 0.05) AS n_drifted FROM report",
    "retrain_decision": _INGEST_REPORT
    + "SELECT CASE WHEN d THEN 'train' ELSE 'skip' END AS decision, "
    "CASE WHEN d THEN 'drift found' ELSE 'model up to date' END AS reason "
    "FROM (SELECT bool_or(p_value < 0.05) AS d FROM report)",
    "binary_metrics": SCORED
    + _metrics("model")
    + _auc("model")
    + f"SELECT rates.model, {_RATE_SELECT}, round(roc_auc, 6) AS roc_auc, tn, fp, fn, tp "
    "FROM rates JOIN auc ON rates.model = auc.model",
    "confusion_matrix": SCORED
    + """SELECT CAST(y AS INTEGER) AS actual, CAST(p AS INTEGER) AS predicted, count(s.label) AS n
FROM range(2) a(y) CROSS JOIN range(2) b(p)
LEFT JOIN (SELECT * FROM scored WHERE model='tenure') s ON s.label = y AND s.prediction = p
GROUP BY y, p""",
    "roc_auc": SCORED + _auc("model") + "SELECT model, round(roc_auc, 6) AS roc_auc FROM auc",
    "roc_auc_hard": SCORED
    + _metrics("model")
    + "SELECT model, round((CAST(tp AS DOUBLE)/(tp+fn) + CAST(tn AS DOUBLE)/(tn+fp))/2, 6) "
    "AS roc_auc FROM rates",
    "roc_curve": SCORED
    + _CURVE
    + "SELECT model, threshold, round(cn/tn, 6) AS fpr, round(cp/tp, 6) AS tpr FROM curve "
    "UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE FROM scored",
    "roc_area": SCORED + _auc("model") + "SELECT model, round(roc_auc, 6) AS area FROM auc",
    "pr_curve": SCORED
    + _CURVE
    + 'SELECT model, threshold, round(cp/(cp+cn), 6) AS "precision", round(cp/tp, 6) AS recall '
    "FROM curve UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), 1.0::DOUBLE, 0.0::DOUBLE "
    "FROM scored",
    "metrics_by_split": SCORED
    + ", one AS (SELECT * FROM scored WHERE model='tenure')"
    + _metrics("split", "one")
    + _auc("split", source="one")
    + f"SELECT rates.split, {_RATE_SELECT}, round(roc_auc, 6) AS roc_auc, tn, fp, fn, tp "
    "FROM rates JOIN auc ON rates.split = auc.split",
    "best_model": SCORED
    + ", held AS (SELECT * FROM scored WHERE split='test')"
    + _metrics("position, model", "held")
    + f"SELECT position, model, {_RATE_SELECT}, tn, fp, fn, tp FROM rates "
    "ORDER BY rates.f1_score DESC, position LIMIT 1",
    "ingest": CLEANED + f"SELECT *, {_SPLIT} FROM cleaned",
    "validate": _INGEST_REPORT
    + f", status AS ({_status_rows('train')} UNION ALL {_status_rows('test')}) "
    "SELECT s AS schema_ok, d AS drift_found, s AND NOT d AS passed FROM "
    "(SELECT (SELECT bool_and(passed) FROM status) AS s, "
    "(SELECT bool_or(p_value < 0.05) FROM report) AS d)",
}

_FILL_SELECT = """
SELECT f."column", f.side, {number} AS fill_number, {text} AS fill_text,
  count(*) FILTER (c.v IS NULL) AS n_missing, count(*) AS n_rows
FROM {name}_fill f JOIN {name}_cells c ON c."column" = f."column" AND c.side = f.side
GROUP BY f."column", f.side, f.v"""
ORACLE["drift_fill"] = (
    PATCHY
    + _PATCHY_PARTS
    + _ks("train", "test")
    + _FILL_SELECT.format(name="num", number="round(f.v, 6)", text="CAST(NULL AS VARCHAR)")
    + " UNION ALL "
    + _FILL_SELECT.format(name="txt", number="CAST(NULL AS DOUBLE)", text="f.v")
)

_PARTS_ALL = PATCHY + ", fit AS (SELECT * FROM patchy WHERE split='train')\n"
_N4 = ("SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges")
_SQUARES = " + ".join(
    f"CASE WHEN r.{c} IS NOT NULL AND f.{c} IS NOT NULL "
    f"THEN (CAST(r.{c} AS DOUBLE)-f.{c})*(CAST(r.{c} AS DOUBLE)-f.{c}) ELSE 0.0::DOUBLE END"
    for c in _N4
)
_SHARED = " + ".join(
    f"CASE WHEN r.{c} IS NOT NULL AND f.{c} IS NOT NULL THEN 1 ELSE 0 END" for c in _N4
)
_NEAREST = ", ".join(f"f{i} NULLS FIRST" for i in range(4))


def _knn_fill(column: str) -> str:
    """Mean of the five nearest values of a column for every distinct incomplete row."""
    keys = ", ".join(f"r{i}" for i in range(4))
    return f"""
, near_{column} AS (
  SELECT {keys}, avg(v) AS fill FROM (
    SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY d, {_NEAREST}) AS rk FROM (
      SELECT {", ".join(f"r.{c} AS r{i}" for i, c in enumerate(_N4))},
        {", ".join(f"f.{c} AS f{i}" for i, c in enumerate(_N4))},
        f.{column} AS v, 4.0::DOUBLE/({_SHARED})*({_SQUARES}) AS d
      FROM (SELECT DISTINCT {", ".join(_N4)} FROM patchy WHERE {column} IS NULL) r
      JOIN fit f ON f.{column} IS NOT NULL AND ({_SHARED}) > 0))
  WHERE rk <= 5 GROUP BY {keys})"""


def _knn_value(column: str, alias: str) -> str:
    return f"round(coalesce(CAST(p.{column} AS DOUBLE), {alias}.fill), 6) AS {column}"


def _knn_join(column: str, alias: str) -> str:
    same = " AND ".join(f"p.{c} IS NOT DISTINCT FROM {alias}.r{i}" for i, c in enumerate(_N4))
    return f" LEFT JOIN near_{column} {alias} ON {same}"


ORACLE["knn_impute"] = (
    _PARTS_ALL
    + _knn_fill("MonthlyCharges")
    + _knn_fill("TotalCharges")
    + "\nSELECT p.customerID, CAST(p.SeniorCitizen AS DOUBLE) AS SeniorCitizen, "
    "CAST(p.tenure AS DOUBLE) AS tenure, "
    + _knn_value("MonthlyCharges", "m")
    + ", "
    + _knn_value("TotalCharges", "t")
    + " FROM patchy p"
    + _knn_join("MonthlyCharges", "m")
    + _knn_join("TotalCharges", "t")
)


def _fit_mode(column: str) -> str:
    return _mode(column).replace("FROM patchy", "FROM fit")


ORACLE["mode_impute"] = _PARTS_ALL + (
    f"SELECT customerID, {', '.join(map(_fit_mode, ONE_HOT_COLUMNS))} FROM patchy"
)
ORACLE["standardize"] = _PARTS_ALL + (
    "SELECT customerID, "
    + ", ".join(
        f"round((CAST({c} AS DOUBLE) - (SELECT avg({c}) FROM fit))"
        f"/(SELECT stddev_pop({c}) FROM fit), 6) AS {c}"
        for c in _N4
    )
    + " FROM patchy"
)
ORACLE["one_hot"] = _PARTS_ALL + (
    "SELECT customerID, "
    + ", ".join(
        f"CAST(CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS DOUBLE) AS {c}_{i}"
        for c, values in ONE_HOT_COLUMNS.items()
        for i, v in enumerate(values)
    )
    + " FROM patchy"
)
ORACLE["check_features"] = PATCHY + _union(
    [
        f"SELECT '{c}' AS \"column\", 'ok' AS status, count({c}) AS n_filled FROM patchy"
        for c in COLUMNS
        if c not in ("Churn", "tenure")
    ]
    + ["SELECT 'tenure', 'missing', 0"]
    + ["SELECT 'split', 'unexpected', count(split) FROM patchy"]
    + ["SELECT 'Churn', 'unexpected', count(Churn) FROM patchy"]
)

_SPARK_NAME = {"string": "string", "int": "int", "float": "double"}
_CODED = "CASE Churn WHEN 'Yes' THEN '1' ELSE '0' END"


def _eda(section: str, item: str, group: str, value: str, tail: str) -> str:
    return (
        f"SELECT '{section}' AS section, {item} AS item, {group} AS churn, "
        f"round(CAST({value} AS DOUBLE), 6) AS value {tail}"
    )


def _eda_box(section: str, value: str) -> str:
    stats = {
        "n_rows": "n_rows", "q1": "q1", "median": "median", "q3": "q3",
        "whisker_low": "whisker_low", "whisker_high": "whisker_high", "n_outliers": "n_outliers",
    }
    return _union(
        [_eda(section, f"'{n}'", _CODED, c, f"FROM {section}_box") for n, c in stats.items()]
    )


def _eda_box_cte(section: str, value: str) -> str:
    body = _box(value)[len(EXPLORED) :].lstrip().lstrip(",").strip()
    return f", {section}_box AS (WITH {body})"


ORACLE["eda_report"] = (
    EXPLORED
    + ", uniq AS (SELECT DISTINCT * FROM raw)\n"
    + _eda_box_cte("monthly", "MonthlyCharges")
    + _eda_box_cte("total", "TotalCharges")
    + ", tenure_range AS (SELECT CAST(min(tenure) AS DOUBLE) AS lo, CAST(max(tenure) AS DOUBLE) AS hi FROM explored)"
    ", spread AS (SELECT Churn, count(*) AS n, pow(count(*), -0.2::DOUBLE)*stddev_samp(tenure) AS h "
    "FROM explored GROUP BY Churn)"
    + ", hist AS (SELECT Churn, least(CAST(floor((tenure-lo)*30.0::DOUBLE/(hi-lo)) AS INTEGER), 29)"
    " AS bin FROM explored, (SELECT CAST(min(tenure) AS DOUBLE) AS lo, "
    "CAST(max(tenure) AS DOUBLE) AS hi FROM explored))\n"
    + _union(
        [
            _eda("shape", "'rows'", "NULL", "count(*)", "FROM raw"),
            _eda("shape", "'columns'", "NULL", str(len(COLUMNS)), "FROM (SELECT count(*) FROM raw)"),
            _eda("shape", "'clean_rows'", "NULL", "count(*)", "FROM explored"),
            _eda(
                "duplicates",
                "'rows'",
                "NULL",
                "(SELECT count(*) FROM raw) - (SELECT count(*) FROM uniq)",
                "",
            ),
            *(
                _eda(
                    "missing", f"'{c}'", "NULL", f"count(*) FILTER ({c} IS NULL)", "FROM coerced"
                )
                for c in COLUMNS
            ),
            *(
                _eda("types", f"'{r.name} {_SPARK_NAME[r.kind]}'", "NULL", f"count({r.name})", "FROM coerced")
                for r in CUSTOMER_RULES
            ),
            _eda("churn", "'rows'", _CODED, "count(*)", "FROM explored GROUP BY Churn"),
            _eda("contract", "Contract", _CODED, "count(*)", "FROM explored GROUP BY Contract, Churn"),
            _eda_box("monthly", "MonthlyCharges"),
            _eda_box("total", "TotalCharges"),
            _eda(
                "tenure",
                "concat('bin ', lpad(CAST(b AS VARCHAR), 2, '0'))",
                _CODED,
                "(SELECT count(*) FROM hist h WHERE h.Churn = c.Churn AND h.bin = b)",
                "FROM (SELECT DISTINCT Churn FROM explored) c, range(30) t(b)",
            ),
            _eda(
                "density",
                "concat('point ', lpad(CAST(p AS VARCHAR), 3, '0'))",
                _CODED.replace("Churn", "e.Churn"),
                "sum(exp(-0.5::DOUBLE*pow((lo + p*((hi-lo)/199) - e.tenure)/h, 2)))/(n*h*sqrt(2*pi()))",
                "FROM explored e JOIN spread s ON e.Churn = s.Churn, tenure_range, range(200) g(p) "
                "GROUP BY e.Churn, p, lo, hi, n, h",
            ),
        ]
    )
)

# --- encoded vectors: impute, scale, then one slot per category of the training rows -----

_SEPARABLE = (
    DISTINCT
    + ", patchy AS (SELECT * REPLACE (CASE WHEN Contract = 'Month-to-month' THEN 'Yes' "
    "WHEN InternetService = 'Fiber optic' AND CAST(substr(customerID, 2, 8) AS BIGINT) % 4 = 0 "
    f"THEN 'Yes' ELSE 'No' END AS Churn) FROM (SELECT {_swap({**_NA_ALL, 'TotalCharges': _NUMBER})}, "
    f"{_SPLIT} FROM uniq) WHERE split = 'train')\n"
    + ", fit AS (SELECT * FROM patchy)\n"
)
_CATEGORICAL = [c for c in TEXT if c not in ("customerID", "Churn")]
_IMPUTED = (
    _SEPARABLE
    + _knn_fill("MonthlyCharges")
    + _knn_fill("TotalCharges")
    + "\n, imputed AS (SELECT p.customerID, CAST(p.SeniorCitizen AS DOUBLE) AS SeniorCitizen, "
    "CAST(p.tenure AS DOUBLE) AS tenure, coalesce(p.MonthlyCharges, m.fill) AS MonthlyCharges, "
    "coalesce(p.TotalCharges, t.fill) AS TotalCharges, "
    + ", ".join(f"coalesce(p.{c}, {c}_mode.v) AS {c}" for c in _CATEGORICAL)
    + " FROM patchy p"
    + _knn_join("MonthlyCharges", "m")
    + _knn_join("TotalCharges", "t")
    + "".join(
        f", (SELECT {c} AS v FROM fit WHERE {c} IS NOT NULL GROUP BY {c} "
        f"ORDER BY count(*) DESC, {c} LIMIT 1) {c}_mode"
        for c in _CATEGORICAL
    )
    + ")\n, slots AS (SELECT CAST(row_number() OVER (ORDER BY o, v) - 1 AS INTEGER) AS position, * "
    "FROM ("
    + _union(
        [f"SELECT {i} AS o, '{c}' AS c, NULL AS v" for i, c in enumerate(_N4)]
        + [
            f"SELECT DISTINCT {4 + i} AS o, '{c}' AS c, {c} AS v FROM imputed"
            for i, c in enumerate(_CATEGORICAL)
        ]
    )
    + "))\n, long AS ("
    + _union(
        [
            f"SELECT customerID, '{c}' AS c, NULL AS v, ({c} - (SELECT avg({c}) FROM imputed))"
            f"/(SELECT stddev_pop({c}) FROM imputed) AS value FROM imputed"
            for c in _N4
        ]
        + [
            f"SELECT customerID, '{c}', {c}, 1.0::DOUBLE FROM imputed"
            for c in _CATEGORICAL
        ]
    )
    + ")\n, vectors AS (SELECT i.customerID, s.position, s.c, s.v, round(coalesce(l.value, 0), 6) "
    "AS value FROM (SELECT customerID FROM imputed) i CROSS JOIN slots s LEFT JOIN long l "
    "ON l.customerID = i.customerID AND l.c = s.c AND l.v IS NOT DISTINCT FROM s.v)\n"
)
ORACLE["assemble_features"] = _IMPUTED + "SELECT customerID, position, value FROM vectors"
ORACLE["feature_names"] = _IMPUTED + (
    "SELECT position, CASE WHEN v IS NULL THEN c ELSE concat(c, '_onehot_', v) END AS feature, "
    "count(*) FILTER (abs(value) > 1e-9) AS n_filled FROM vectors GROUP BY position, c, v"
)
ORACLE["expected_features"] = PATCHY + _union(
    [
        f"SELECT {i} AS position, '{c}' AS feature, count({c}) AS n_filled FROM patchy"
        for i, c in enumerate(c for c in COLUMNS if c != "Churn")
    ]
)
ORACLE["gated_run"] = (
    _INGEST_REPORT
    + f", status AS ({_status_rows('train')} UNION ALL {_status_rows('test')})\n"
    ", x AS (SELECT (SELECT bool_and(passed) FROM status) AS s, "
    "(SELECT bool_or(p_value < 0.05) FROM report) AS d)\n"
    "SELECT 1 AS turn, 'train' AS decision, 'no published model' AS reason, s AS schema_ok, "
    "d AS drift_found, true AS published FROM x UNION ALL "
    "SELECT 2, CASE WHEN d THEN 'train' ELSE 'skip' END, "
    "CASE WHEN d THEN 'drift found' ELSE 'model up to date' END, s, d, d FROM x"
)

# --- predictions: the separable target is decided by the features, so a right model repeats it ---

_SEPARATED = (
    DISTINCT
    + ", separated AS (SELECT customerID, CASE WHEN Contract = 'Month-to-month' THEN 1 "
    "WHEN InternetService = 'Fiber optic' AND CAST(substr(customerID, 2, 8) AS BIGINT) % 4 = 0 "
    f"THEN 1 ELSE 0 END AS y, {_SPLIT} FROM uniq)\n"
)
_CHURN = "CASE y WHEN 1 THEN 'Yes' ELSE 'No' END AS churn"
_SCORED_ALL = _SEPARATED + f"SELECT customerID, y AS prediction, {_CHURN} FROM separated"
_TEST_PREDICTIONS = (
    _SEPARATED + "SELECT customerID, y AS label, y AS prediction{} FROM separated WHERE split = 'test'"
)
for _name in ("random_forest", "gbt", "adaboost", "decision_tree", "weighted_gbt"):
    ORACLE[f"model_{_name}"] = _TEST_PREDICTIONS.format(f", '{_name}' AS model")
ORACLE["refit_best"] = _TEST_PREDICTIONS.format("")
for _name in ("score_records", "score_request_records", "score_csv", "score_stream", "model_roundtrip"):
    ORACLE[_name] = _SCORED_ALL
ORACLE["prediction_preview"] = (
    _SEPARATED + f"SELECT customerID, y AS prediction, {_CHURN}, count(*) OVER () AS n_total "
    "FROM separated ORDER BY customerID LIMIT 10"
)
ORACLE["publish_model"] = (
    _SEPARATED + "SELECT y AS prediction, count(*) AS n FROM separated GROUP BY y"
)
_PERFECT = ", ".join(f"1.0::DOUBLE AS {n}" for n in ("accuracy", "precision", "recall", "f1_score", "roc_auc"))
_PERFECT_CELLS = (
    "count(*) FILTER (y=0) AS tn, 0::BIGINT AS fp, 0::BIGINT AS fn, count(*) FILTER (y=1) AS tp"
)
ORACLE["train"] = _SEPARATED + f"SELECT split, {_PERFECT}, {_PERFECT_CELLS} FROM separated GROUP BY split"
ORACLE["run_metrics"] = (
    _SEPARATED
    + f", m AS (SELECT split, {_PERFECT}, {_PERFECT_CELLS} FROM separated GROUP BY split)\n"
    + _union(
        [
            f"SELECT 'run-1' AS run_id, split, '{n}' AS metric, CAST({n} AS DOUBLE) AS value FROM m"
            for n in ("accuracy", "precision", "recall", "f1_score", "roc_auc", "tn", "fp", "fn", "tp")
        ]
    )
)
ORACLE["forced_run"] = (
    CLEANED
    + f", ingested AS (SELECT *, {_SPLIT} FROM cleaned)\n"
    "SELECT 'forced' AS run_id, split, CAST(count(*) AS DOUBLE) AS n_rows, "
    "CAST(count(*) FILTER (Churn = 'Yes') AS DOUBLE) AS n_positive FROM ingested GROUP BY split"
)
ORACLE["csv_invalid_cells"] = RAW + _union(
    [
        f"SELECT '{r.name}' AS \"column\", "
        + ("count(*) FILTER (tenure % 2 = 0)" if r.name == "tenure" else "count(*) FILTER (1 = 0)")
        + " AS n_invalid FROM raw"
        for r in CUSTOMER_RULES
    ]
)
