"""The same results in plain SQL, written without looking at how Spark gets them.

The statements favour the obvious formulation over the fast one: joins before
aggregation, pairs formed and counted, windows over everything.
"""

from __future__ import annotations

from depotcast.sources.supplied import SCHEMAS

# stated here once more, so that a slip in the engine's own constants shows
_ENCODED = ("state", "city", "branch", "rank", "product", "urban_tier")
_COVARIATES = (
    "operational_total", "maintenance_total", "ready_total", "mech_total", "mech_present", "population", "month_number",
)
_TARGET_LAGS, _COVARIATE_LAGS, _HOLDOUT_MONTHS = 12, 6, 4

_CLASSES = ("new", "semi", "used")

# --- logical inputs -------------------------------------------------------------------

SNAPSHOT = """
snapshot AS (
  SELECT l_shipdate AS snapshot_ts, CAST(l_shipdate AS DATE) AS day,
         CAST(s_nationkey AS VARCHAR) AS branch,
         (SELECT CASE WHEN r_name = 'AMERICA' THEN 'ABROAD' ELSE 'HOME' END FROM nation
          LEFT JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey = s_nationkey) AS stated_country,
         'T' || CAST(CAST(round(l_tax * 100) AS INTEGER) AS VARCHAR) AS status_type,
         p_brand AS status_desc, l_linestatus AS operational_flag,
         CASE WHEN p_type IN ('STANDARD', 'ECONOMY') THEN 'new'
              WHEN p_type IN ('PROMO', 'LARGE') THEN 'semi' ELSE 'used' END AS product_rented,
         CASE WHEN p_size <= 16 THEN 'new' WHEN p_size <= 33 THEN 'semi' ELSE 'used' END AS product_class,
         CAST(l_quantity AS BIGINT) AS qty
  FROM lineitem
  LEFT JOIN supplier ON s_suppkey = l_suppkey
  LEFT JOIN part ON p_partkey = l_partkey)"""

REGISTER = """
register AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS branch,
         CASE WHEN r_name = 'AMERICA' THEN 'ABROAD' ELSE 'HOME' END AS country,
         n_name AS city, r_name AS region, n_name AS state,
         CASE WHEN r_name = 'MIDDLE EAST' THEN 1 ELSE 0 END AS third_party,
         (SELECT CAST(floor(sum(CAST(c_acctbal AS DECIMAL(18,2)))) AS BIGINT)
          FROM customer WHERE c_nationkey = n_nationkey) AS population
  FROM nation LEFT JOIN region ON r_regionkey = n_regionkey)"""

SALE = """
sale AS (
  SELECT CAST(o_orderdate AS DATE) AS paid_on, CAST(c_nationkey AS VARCHAR) AS branch,
         o_orderkey AS sale_id, o_custkey, o_orderstatus, o_totalprice,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'new'
              WHEN o_orderpriority = '3-MEDIUM' THEN 'semi' ELSE 'used' END AS product
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey)"""

INDICATOR = """
indicator AS (
  SELECT branch, paid_on AS day, CAST(count(*) AS DOUBLE) AS mech_total,
         min(o_totalprice) AS mech_present, max(o_totalprice) AS mech_on_ramp
  FROM sale GROUP BY branch, paid_on)"""

JOB = """
job AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS branch, CAST(l_shipdate AS DATE) AS finished_on,
         l_orderkey AS job_id,
         CASE WHEN l_returnflag = 'R' THEN 'internal' ELSE 'customer' END AS job_type
  FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey)"""

# --- measures -------------------------------------------------------------------------

_GENERAL = "'Brand#1', 'Brand#2', 'Brand#3', 'Brand#7'"
_MEASURES = {
    "rented_total": "status_type = 'T1'",
    **{f"rented_{c}": f"status_type = 'T1' AND product_rented = '{c}'" for c in _CLASSES},
    "operational_total": "operational_flag = 'O'",
    **{
        f"operational_{c}": f"operational_flag = 'O' AND product_class = '{c}' AND status_type <> 'T1'"
        for c in _CLASSES
    },
    "ready_total": "status_type = 'T2'",
    **{f"ready_{c}": f"status_type = 'T2' AND product_class = '{c}'" for c in _CLASSES},
    "maintenance_total": "status_desc = 'Brand#1'",
    **{f"maintenance_{c}": f"status_desc = 'Brand#1' AND product_class = '{c}'" for c in _CLASSES},
    "transit_new_by_desc": "status_desc = 'Brand#2'",
    "factory_new": "status_type = 'T0'",
    "administrative": "status_type = 'T7'",
    "sale_total": "status_type = 'T3'",
    "sale_own_programme": "status_type = 'T3' AND status_desc IN ('Brand#4', 'Brand#5')",
    "sale_direct_or_donation":
        "status_type = 'T3' AND status_desc NOT IN ('Brand#4', 'Brand#5', 'Brand#6')",
    "sale_awaiting_auction": "status_type = 'T3' AND status_desc = 'Brand#6'",
    "total_loss": "status_type = 'T5'",
    "stolen": "status_type = 'T6'",
    "unavailable_between_branches": "status_type = 'T4' AND status_desc IN ('Brand#7', 'Brand#8')",
    "unavailable_general": f"status_type = 'T4' AND status_desc NOT IN ({_GENERAL})",
    "unavailable_impounded": "status_type = 'T4' AND status_desc = 'Brand#9'",
    "unavailable_misappropriated": "status_type = 'T4' AND status_desc = 'Brand#10'",
    "unavailable_regulatory":
        f"status_type = 'T4' AND status_desc NOT IN ({_GENERAL}, 'Brand#8', 'Brand#9', 'Brand#10')",
    "received_new": "status_desc = 'Brand#3'",
    "transit_new_by_type": "status_type = 'T8'",
}
_FLOW = [
    "rented_total", "operational_total", "ready_total", "maintenance_total",
    "rented_new", "rented_semi", "rented_used", "operational_new", "operational_semi",
    "operational_used", "ready_new", "ready_semi", "ready_used", "sale_total",
    "sale_own_programme", "total_loss", "stolen", "unavailable_misappropriated", "received_new",
    "transit_new_by_type",
]


def _sums(names) -> str:
    return ",\n         ".join(
        f"CAST(sum(CASE WHEN {_MEASURES[n]} THEN qty ELSE 0 END) AS BIGINT) AS {n}" for n in names
    )


# --- monthly building blocks ----------------------------------------------------------

STOCK_FLOW = f"""
stock_flow AS (
  SELECT last_day(day - 1) AS month_end, register.country, register.branch,
         {_sums(_FLOW)}
  FROM snapshot JOIN register ON register.branch = snapshot.branch
  WHERE stated_country = 'HOME' AND register.third_party = 0
  GROUP BY ALL)"""


def _month_end_stock(latest: bool) -> str:
    newest = "(SELECT max(day) FROM snapshot)"
    keep = "extract(day FROM day) = 1"
    label = "CAST(day - 1 AS DATE)"
    if latest:
        keep += f" OR day = {newest}"
        label = f"CASE WHEN day = {newest} THEN last_day(day) ELSE CAST(day - 1 AS DATE) END"
    return f"""
stock AS (
  SELECT {label} AS month_end, register.country, register.branch,
         {_sums(_MEASURES)}
  FROM snapshot LEFT JOIN register ON register.branch = snapshot.branch
  WHERE {keep}
  GROUP BY ALL)"""


STOCK = _month_end_stock(True)

INVOICED = """
invoiced AS (
  SELECT last_day(paid_on) AS month_end, branch, count(DISTINCT o_custkey) AS invoiced_units
  FROM sale WHERE o_orderstatus = 'P' GROUP BY ALL)"""

PRODUCED = """
produced AS (
  SELECT last_day(finished_on) AS month_end, job.branch, count(job_id) AS produced_units
  FROM job JOIN register ON register.branch = job.branch
  WHERE register.country = 'HOME' GROUP BY ALL)"""

DEMAND = """
demand AS (
  SELECT last_day(paid_on) AS month_end, branch,
         count(CASE WHEN product = 'new' THEN sale_id END) AS sales_new,
         count(CASE WHEN product = 'semi' THEN sale_id END) AS sales_semi,
         count(CASE WHEN product = 'used' THEN sale_id END) AS sales_used
  FROM sale WHERE paid_on >= DATE '1995-01-01' GROUP BY ALL)"""

WORKSHOP = """
workshop AS (
  SELECT jobs.*, mech_total, mech_present, mech_on_ramp
  FROM (SELECT branch, last_day(finished_on) AS month_end,
               count(CASE WHEN job_type = 'internal' THEN job_id END) AS maint_internal,
               count(CASE WHEN job_type <> 'internal' THEN job_id END) AS maint_customer
        FROM job WHERE finished_on > DATE '1995-01-01' GROUP BY ALL) jobs
  LEFT JOIN (SELECT branch, last_day(day) AS month_end, avg(mech_total) AS mech_total,
                    avg(mech_present) AS mech_present, avg(mech_on_ramp) AS mech_on_ramp
             FROM indicator GROUP BY ALL) days
    ON days.branch = jobs.branch AND days.month_end = jobs.month_end)"""

WORKSHOP_PAIRS = """
workshop_pairs AS (
  SELECT job.branch, last_day(finished_on) AS month_end,
         count(CASE WHEN job_type = 'internal' THEN job_id END) AS maint_internal,
         count(CASE WHEN job_type <> 'internal' THEN job_id END) AS maint_customer,
         avg(mech_total) AS mech_total, avg(mech_on_ramp) AS mech_on_ramp
  FROM job LEFT JOIN indicator
    ON indicator.branch = job.branch AND last_day(indicator.day) = last_day(job.finished_on)
  WHERE finished_on > DATE '1995-01-01' GROUP BY ALL)"""

SEGMENT = """
segment AS (
  SELECT branch, country, city, state, region, third_party, population, pop_bucket,
         CASE pop_bucket WHEN 1 THEN 'D' WHEN 2 THEN 'C' WHEN 3 THEN 'B' WHEN 4 THEN 'A'
              WHEN 5 THEN 'S' END AS pop_letter,
         CASE WHEN pop_bucket >= 5 THEN 'megacity' WHEN pop_bucket >= 4 THEN 'metropolis'
              WHEN pop_bucket >= 3 THEN 'regional centre' ELSE 'interior' END AS urban_tier,
         CASE WHEN country = 'ABROAD' THEN 'ABROAD'
              WHEN region = 'ASIA' AND city = 'NATION_2' THEN 'NATION_2 (capital)'
              WHEN region = 'EUROPE' AND city = 'NATION_3' THEN 'NATION_3 (capital)'
              ELSE region END AS region_consolidated,
         CASE WHEN (region = 'ASIA' AND city = 'NATION_2') OR (region = 'EUROPE' AND city = 'NATION_3')
              THEN 1 ELSE 0 END AS is_capital
  FROM (SELECT *, CAST(ntile(5) OVER (ORDER BY population, branch) AS INTEGER) AS pop_bucket
        FROM register WHERE population IS NOT NULL))"""

WIDE = """
wide AS (
  SELECT stock.*, invoiced_units, produced_units, sales_new, sales_semi, sales_used,
         maint_internal, maint_customer, mech_total, mech_present, mech_on_ramp
  FROM stock
  LEFT JOIN invoiced USING (month_end, branch)
  LEFT JOIN produced USING (month_end, branch)
  LEFT JOIN demand USING (month_end, branch)
  LEFT JOIN workshop USING (month_end, branch))"""

PLANNING = """
planning AS (
  SELECT wide.*, city, state, region, population, pop_bucket, pop_letter, region_consolidated,
         urban_tier, is_capital
  FROM wide LEFT JOIN segment ON segment.branch = wide.branch)"""


def _with(*ctes: str, query: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + query


_WIDE_CTES = (SNAPSHOT, REGISTER, SALE, INDICATOR, JOB, STOCK, INVOICED, PRODUCED, DEMAND, WORKSHOP, WIDE)
_PLANNING_CTES = (*_WIDE_CTES, SEGMENT, PLANNING)


def _rounded(columns, digits: int = 6) -> str:
    inner = ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)
    return f"* REPLACE ({inner})"


_MECH = ("mech_total", "mech_present", "mech_on_ramp")

# --- rollups --------------------------------------------------------------------------

_RENTED = {"new": "rented_new", "semi": "rented_semi", "used": "rented_used", "total": "rented_total"}


def _union(source: str, head: str, columns: dict[str, str], group: bool) -> str:
    """One SELECT per product, stacked."""
    return "\nUNION ALL\n".join(
        f"SELECT {head}, '{product}' AS product, "
        + (f"CAST(sum({c}) AS BIGINT)" if group else f"coalesce(CAST({c} AS DOUBLE), 0)")
        + f" AS value FROM {source}"
        + (" GROUP BY ALL" if group else "")
        for product, c in columns.items()
    )


def _rollup(name: str, keys: list[str], table: str, select: str | None = None) -> str:
    present = " AND ".join(f"{k} IS NOT NULL" for k in ["month_end", *keys])
    head = select or ", ".join(["month_end AS date", *keys])
    return f"\n{name} AS ({_union(f'(SELECT * FROM {table} WHERE {present})', head, _RENTED, True)})"


LONG = f"\nlong AS ({_union('wide', 'month_end AS date, country, branch', _RENTED, False)})"
BY_COMPANY = _rollup("by_company", [], "wide", "month_end AS date, 'company' AS company")
BY_COUNTRY = _rollup("by_country", ["country"], "wide")
BY_REGION = _rollup("by_region", ["country", "region", "region_consolidated"], "planning")
BY_STATE = _rollup("by_state", ["country", "state"], "planning")
BY_RANK = _rollup(
    "by_rank", ["country", "pop_letter"], "planning", "month_end AS date, country, pop_letter AS rank"
)
BY_TIER = _rollup("by_tier", ["country", "urban_tier"], "planning")
BY_POPULATION = _rollup("by_population", ["country", "population"], "planning")

_LEVEL_KEYS = ["country", "region", "region_consolidated", "state", "pop_letter", "urban_tier", "population"]


def _level(name: str, table: str, renamed: dict[str, str], keys: list[str]) -> str:
    columns = ", ".join(
        (f"{renamed.get(k, k)} AS {k}" if k in keys else f"NULL AS {k}") for k in _LEVEL_KEYS
    )
    return f"SELECT '{name}' AS level, date, {columns}, product, value FROM {table}"


_ALL_LEVELS = "\nUNION ALL\n".join(
    [
        _level("company", "by_company", {}, []),
        _level("country", "by_country", {}, ["country"]),
        _level("region", "by_region", {}, ["country", "region", "region_consolidated"]),
        _level("state", "by_state", {}, ["country", "state"]),
        _level("pop_rank", "by_rank", {"pop_letter": "rank"}, ["country", "pop_letter"]),
        _level("urban_tier", "by_tier", {}, ["country", "urban_tier"]),
        _level("population", "by_population", {}, ["country", "population"]),
    ]
)


def _total(table: str, key: str, kind: str = "BIGINT") -> str:
    return (
        f"SELECT {key}, CAST(sum(value) AS {kind}) AS total FROM {table} "
        f"WHERE product <> 'total' AND {key} IS NOT NULL GROUP BY {key}"
    )


def _share(table: str, key: str) -> str:
    return f"""SELECT {key}, total,
       round(CASE WHEN everything > 0 THEN CAST(total AS DOUBLE) / everything ELSE 0 END * 100, 6) AS pct
FROM (SELECT *, sum(total) OVER () AS everything FROM ({_total(table, key)}))"""


def _summary(table: str, keys: list[str]) -> str:
    counts = ", ".join(f"count(DISTINCT {k}) AS n_{k}" for k in ["date", *keys])
    return (
        f"SELECT count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, {counts} FROM {table}"
    )


def _cross(key: str, fill: bool) -> str:
    cells = ", ".join(
        ("coalesce({0}, 0)" if fill else "{0}").format(f"sum(value) FILTER (WHERE product = '{p}')")
        + f" AS {p}"
        for p in ("new", "semi", "used", "total")
    )
    return f"SELECT {key}, {cells} FROM long WHERE {key} IS NOT NULL GROUP BY {key}"


# --- panel ----------------------------------------------------------------------------

_OPERATIONAL = (
    "operational_total", "maintenance_total", "ready_total", "mech_total", "mech_present",
    "unavailable_general", "received_new",
)
_STATICS = ("country", "state", "city", "urban_tier", "rank", "population")

CLEAN = f"""
clean AS (
  SELECT last_day(month_end) AS month_end, branch, country, state, city, urban_tier, pop_letter,
         population, {", ".join(f"coalesce({c}, 0) AS {c}" for c in _OPERATIONAL)},
         sales_new, sales_semi, sales_used
  FROM planning WHERE branch IS NOT NULL AND month_end IS NOT NULL)"""

_PANEL_HEAD = (
    "month_end AS date, branch, country, state, city, urban_tier, pop_letter AS rank, population, "
    + ", ".join(_OPERATIONAL)
)
PANEL_LONG = "\npanel_long AS (" + "\nUNION ALL\n".join(
    f"SELECT {_PANEL_HEAD}, '{p}' AS product, sales_{p} AS value FROM clean" for p in _CLASSES
) + ")"

PANEL = f"""
latest AS (
  SELECT branch, product, {", ".join(_STATICS)}
  FROM panel_long
  QUALIFY row_number() OVER (PARTITION BY branch, product ORDER BY date DESC) = 1),
months AS (
  SELECT last_day(CAST(unnest(generate_series(
           date_trunc('month', (SELECT min(date) FROM panel_long)),
           date_trunc('month', (SELECT max(date) FROM panel_long)), INTERVAL 1 MONTH)) AS DATE)) AS date),
panel AS (
  SELECT months.date, b.branch, p.product, {", ".join("latest." + c for c in _STATICS)},
         {", ".join(f"coalesce(f.{c}, 0) AS {c}" for c in _OPERATIONAL)},
         CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM months
  CROSS JOIN (SELECT DISTINCT branch FROM panel_long) b
  CROSS JOIN (SELECT DISTINCT product FROM panel_long) p
  LEFT JOIN latest ON latest.branch = b.branch AND latest.product = p.product
  LEFT JOIN panel_long f ON f.date = months.date AND f.branch = b.branch AND f.product = p.product)"""

RECENT = """
recent AS (
  SELECT * FROM panel
  WHERE date >= CAST((SELECT max(date) FROM panel) - INTERVAL 24 MONTH AS DATE))"""

_PANEL_CTES = (*_PLANNING_CTES, CLEAN, PANEL_LONG, PANEL)


def _code(column: str) -> str:
    return f"coalesce(CAST({column} AS VARCHAR), 'nan')"


_CODES = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", label, CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS code "
    f"FROM (SELECT DISTINCT {_code(c)} AS label FROM recent)"
    for c in _ENCODED
)

_LAGS = ",\n       ".join(
    [
        f"round(lag(ln(1 + value), {k}) OVER w, 6) AS value_lag_{k}"
        for k in range(1, _TARGET_LAGS + 1)
    ]
    + [
        f"round(CAST(lag({c}, {k}) OVER w AS DOUBLE), 6) AS {c}_lag_{k}"
        for c in _COVARIATES
        for k in range(1, _COVARIATE_LAGS + 1)
    ]
    + [f"CAST(dense_rank() OVER (ORDER BY {_code(c)}) - 1 AS BIGINT) AS {c}_code" for c in _ENCODED]
)

_LAG_ROWS = f"""
SELECT branch, product, date, value, round(ln(1 + value), 6) AS label,
       {_LAGS}
FROM (SELECT *, month(date) AS month_number FROM recent)
WINDOW w AS (PARTITION BY branch, product ORDER BY date)"""
_POPULATION_LAGS = [f"population_lag_{k}" for k in range(1, _COVARIATE_LAGS + 1)]
_TRAINING_ROWS = f"""
SELECT * REPLACE ({", ".join(f"coalesce({c}, 0) AS {c}" for c in _POPULATION_LAGS)}),
       CASE WHEN population_lag_1 IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS population_missing,
       CASE WHEN date < (SELECT date_trunc('month', max(date) - INTERVAL {_HOLDOUT_MONTHS} MONTH) FROM recent)
            THEN 'train' ELSE 'holdout' END AS split
FROM ({_LAG_ROWS}) WHERE value_lag_{_TARGET_LAGS} IS NOT NULL"""

_COVARIATE_LIST = "operational_total, maintenance_total, ready_total, mech_total, mech_present, population"
_FUTURE = f"""
last_row AS (
  SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY branch, product ORDER BY date DESC) = 1),
extended AS (
  SELECT branch, product, date, {_COVARIATE_LIST}, 0 AS is_future FROM panel
  UNION ALL
  SELECT branch, product,
         last_day(CAST(date_trunc('month', date) + to_months(CAST(k AS INTEGER)) AS DATE)),
         {_COVARIATE_LIST}, 1
  FROM last_row CROSS JOIN (SELECT unnest(generate_series(1, 12)) AS k))"""

# --- ensemble -------------------------------------------------------------------------


def _ensemble_ctes(calendar: bool) -> str:
    series = "\nUNION ALL\n".join(
        f"SELECT branch, CAST(date_trunc('month', month_end) AS DATE) AS month, '{p}' AS product, "
        f"CAST(coalesce(sum(rented_{p}), 0) AS DOUBLE) AS value FROM wide WHERE branch IS NOT NULL "
        "GROUP BY ALL"
        for p in _CLASSES
    )
    trained = "SELECT * FROM series WHERE month <= DATE '2001-04-30'"
    if calendar:
        trained = """SELECT spine.branch, spine.month, spine.product, coalesce(s.value, 0) AS value
  FROM (SELECT branch, product,
               CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month
        FROM series WHERE month <= DATE '2001-04-30' GROUP BY branch, product) spine
  LEFT JOIN series s ON s.branch = spine.branch AND s.product = spine.product AND s.month = spine.month"""
    return f"""
series AS ({series}),
trained AS ({trained}),
indexed AS (
  SELECT *, row_number() OVER (PARTITION BY branch, product ORDER BY month) - 1 AS i,
         count(*) OVER (PARTITION BY branch, product) AS n FROM trained),
fitted AS (
  SELECT branch, product, max(n) AS n,
         avg(value) FILTER (WHERE i >= n - CASE WHEN n < 3 THEN greatest(1, n - 1) ELSE 3 END) AS ma,
         avg(value) AS mean, regr_slope(value, i) AS slope, regr_intercept(value, i) AS intercept,
         sum(value * CASE WHEN i = 0 THEN pow(0.7, n - 1) ELSE 0.3 * pow(0.7, n - 1 - i) END) AS es
  FROM indexed WHERE n >= 2 GROUP BY branch, product),
ensemble AS (
  SELECT branch, strftime(DATE '2001-05-01' + to_months(CAST(step AS INTEGER)), '%Y-%m') AS period, product,
         ma, CASE WHEN n < 3 THEN mean ELSE greatest(intercept + slope * (n + step), 0) END AS lr, es,
         (ma + CASE WHEN n < 3 THEN mean ELSE greatest(intercept + slope * (n + step), 0) END + es) / 3
           AS ensemble
  FROM fitted CROSS JOIN (SELECT unnest(generate_series(0, 6)) AS step))"""


_ENSEMBLE = (*_WIDE_CTES, _ensemble_ctes(False))
_ENSEMBLE_ROWS = f"SELECT {_rounded(('ma', 'lr', 'es', 'ensemble'), 4)} FROM ensemble"
_SUMMARY_CTE = "\nsummary AS (SELECT period, product, sum(ensemble) AS total FROM ensemble GROUP BY ALL)"
_SCENARIOS = "\nscenarios AS (" + "\nUNION ALL\n".join(
    [
        f"SELECT month_end AS date, branch, '{p}' AS product, CAST(rented_{p} AS DOUBLE) AS value, "
        "'actual' AS scenario FROM wide WHERE branch IS NOT NULL AND month_end >= DATE '2000-01-01'"
        for p in _CLASSES
    ]
    + [
        "SELECT last_day(CAST(period || '-01' AS DATE)), branch, product, round(ensemble, 4), 'forecast' "
        "FROM ensemble"
    ]
) + ")"

# --- column profile -------------------------------------------------------------------

def _profile_column(table: str, ordinal: int, name: str, kind: str) -> str:
    def text(value: str) -> str:
        if kind.startswith("array"):
            return "CAST(NULL AS VARCHAR)"
        if kind == "double":
            return f"CAST(CAST({value} AS DECIMAL(38, 6)) AS VARCHAR)"
        if kind == "timestamp_ntz":
            return f"strftime({value}, '%Y-%m-%d %H:%M:%S')"
        return f"CAST({value} AS VARCHAR)"

    longest = f"CAST(max(length({text(name)})) AS BIGINT)"
    if kind == "double":
        longest = f"CAST(greatest(length({text(f'min({name})')}), length({text(f'max({name})')})) AS BIGINT)"
    return (
        f"SELECT '{table}' AS table_name, CAST({ordinal} AS BIGINT) AS ordinal, '{name}' AS column_name, "
        f"'{kind}' AS data_type, count(*) - count({name}) AS null_count, "
        f"count(DISTINCT {name}) AS distinct_count, {text(f'min({name})')} AS min_value, "
        f"{text(f'max({name})')} AS max_value, {longest} AS max_text_length, "
        + ", ".join(
            (f"{f}({name})" if kind == "double" else "CAST(NULL AS DOUBLE)") + f" AS {f}_number" for f in ("min", "max")
        )
        + " "
        + f"FROM {table}"
    )


def _profile() -> str:
    rows = []
    for table, columns in SCHEMAS.items():
        for ordinal, column in enumerate(columns.split(", "), 1):
            name, kind = column.split(" ")
            rows.append(_profile_column(table, ordinal, name, kind))
    return "\nUNION ALL\n".join(rows)


# --- statements -----------------------------------------------------------------------

ORACLE: dict[str, str] = {
    "demand_by_product_month": _with(SALE, DEMAND, query="SELECT * FROM demand"),
    "stock_flow_sum": _with(SNAPSHOT, REGISTER, STOCK_FLOW, query="SELECT * FROM stock_flow"),
    "stock_month_end": _with(SNAPSHOT, REGISTER, STOCK, query="SELECT * FROM stock"),
    "stock_month_start_only": _with(
        SNAPSHOT, REGISTER, _month_end_stock(False), query="SELECT * FROM stock"
    ),
    "invoiced_units": _with(SALE, INVOICED, query="SELECT * FROM invoiced"),
    "produced_units": _with(REGISTER, JOB, PRODUCED, query="SELECT * FROM produced"),
    "active_restrictions": """
WITH months AS (
  SELECT CAST(unnest(generate_series(
    (SELECT date_trunc('month', min(o_orderdate)) FROM orders),
    (SELECT date_trunc('month', max(o_orderdate)) FROM orders), INTERVAL 1 MONTH)) AS DATE) AS opening),
history AS (
  SELECT c_custkey AS unit_id, CAST(c_nationkey AS VARCHAR) AS branch, opening
  FROM customer CROSS JOIN months
  WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD')),
restriction AS (
  SELECT o_custkey AS unit_id, CAST(o_orderdate AS DATE) AS starts, o_orderpriority AS description,
         CAST(CASE o_orderstatus WHEN 'F' THEN o_orderdate + INTERVAL 45 DAY
              WHEN 'P' THEN o_orderdate + INTERVAL 200 DAY END AS DATE) AS ends
  FROM orders)
SELECT CAST(opening - 1 AS DATE) AS month_end, branch, description,
       count(history.unit_id) AS restrictions
FROM history LEFT JOIN restriction
  ON restriction.unit_id = history.unit_id AND starts <= opening AND (ends IS NULL OR opening < ends)
GROUP BY ALL""",
    "workshop_join_then_agg": _with(
        SALE, INDICATOR, JOB, WORKSHOP_PAIRS,
        query=f"SELECT {_rounded(('mech_total', 'mech_on_ramp'))} FROM workshop_pairs",
    ),
    "workshop_agg_then_join": _with(
        SALE, INDICATOR, JOB, WORKSHOP, query=f"SELECT {_rounded(_MECH)} FROM workshop"
    ),
    "branch_segments": _with(REGISTER, SEGMENT, query="SELECT * FROM segment"),
    "wide_table": _with(
        SNAPSHOT, REGISTER, SALE, INDICATOR, JOB, STOCK_FLOW, INVOICED, DEMAND, WORKSHOP_PAIRS, SEGMENT,
        query="""
SELECT f.*, invoiced_units, sales_new, sales_semi, sales_used, maint_internal, maint_customer,
       round(mech_total, 6) AS mech_total, round(mech_on_ramp, 6) AS mech_on_ramp,
       pop_letter, region_consolidated, urban_tier
FROM stock_flow f
LEFT JOIN invoiced USING (month_end, branch)
LEFT JOIN demand USING (month_end, branch)
LEFT JOIN workshop_pairs USING (month_end, branch)
LEFT JOIN segment ON segment.branch = f.branch
WHERE month_end BETWEEN DATE '1995-01-31' AND DATE '2001-12-31'
ORDER BY month_end DESC, f.branch""",
    ),
    "wide_table_snapshot": _with(*_WIDE_CTES, query=f"SELECT {_rounded(_MECH)} FROM wide"),
    "planning_table": _with(*_PLANNING_CTES, query=f"SELECT {_rounded(_MECH)} FROM planning"),
    "branch_month_grid": _with(
        SNAPSHOT,
        query="""
, history AS (SELECT DISTINCT last_day(day - 1) AS month_end FROM snapshot
              WHERE last_day(day - 1) < last_day(DATE '2001-08-15' - 1)),
future AS (SELECT last_day(CAST(unnest(generate_series(
             DATE '2001-08-01', DATE '2002-07-01', INTERVAL 1 MONTH)) AS DATE)) AS month_end),
months AS (SELECT * FROM history UNION SELECT * FROM future),
branches AS (SELECT DISTINCT branch FROM snapshot WHERE branch IS NOT NULL),
measured AS (
  SELECT last_day(day - 1) AS month_end, branch,
         CAST(sum(CASE WHEN status_type = 'T3' THEN qty ELSE 0 END) AS BIGINT) AS sale_total
  FROM snapshot GROUP BY ALL)
SELECT months.month_end, branches.branch, coalesce(sale_total, 0) AS sale_total,
       CASE WHEN months.month_end >= last_day(DATE '2001-08-15' - 1) THEN 'forecast'
            WHEN sale_total IS NULL THEN 'empty' ELSE 'actual' END AS status
FROM months CROSS JOIN branches
LEFT JOIN measured ON measured.month_end = months.month_end AND measured.branch = branches.branch""",
    ),
    "company_closed_months": _with(
        SNAPSHOT,
        query="""
SELECT CAST(day - 1 AS DATE) AS date,
       CAST(sum(CASE WHEN status_type = 'T3' THEN qty ELSE 0 END) AS BIGINT) AS sale_total,
       'actual' AS status
FROM snapshot GROUP BY day
HAVING day - 1 < (SELECT max(last_day(day - 1)) FROM snapshot)""",
    ),
    "branch_product_long": _with(*_WIDE_CTES, LONG, query="SELECT * FROM long"),
    "rollup_company": _with(*_WIDE_CTES, BY_COMPANY, query="SELECT * FROM by_company"),
    "rollup_country": _with(*_WIDE_CTES, BY_COUNTRY, query="SELECT * FROM by_country"),
    "rollup_region": _with(*_PLANNING_CTES, BY_REGION, query="SELECT * FROM by_region"),
    "rollup_state": _with(*_PLANNING_CTES, BY_STATE, query="SELECT * FROM by_state"),
    "rollup_pop_rank": _with(*_PLANNING_CTES, BY_RANK, query="SELECT * FROM by_rank"),
    "rollup_urban": _with(*_PLANNING_CTES, BY_TIER, query="SELECT * FROM by_tier"),
    "rollup_population": _with(*_PLANNING_CTES, BY_POPULATION, query="SELECT * FROM by_population"),
    "rollup_all_levels": _with(
        *_PLANNING_CTES, BY_COMPANY, BY_COUNTRY, BY_REGION, BY_STATE, BY_RANK, BY_TIER, BY_POPULATION,
        query=_ALL_LEVELS,
    ),
    "dataset_summary": _with(*_WIDE_CTES, LONG, query=_summary("long", ["country", "branch", "product"])),
    "dataset_summary_region": _with(
        *_PLANNING_CTES, BY_REGION,
        query=_summary("by_region", ["country", "region", "region_consolidated", "product"]),
    ),
    "totals_by_product": _with(*_WIDE_CTES, BY_COMPANY, query=_total("by_company", "product")),
    "totals_by_country": _with(*_WIDE_CTES, BY_COUNTRY, query=_total("by_country", "country")),
    "totals_by_region": _with(*_PLANNING_CTES, BY_REGION, query=_total("by_region", "region_consolidated")),
    "totals_by_rank": _with(*_PLANNING_CTES, BY_RANK, query=_total("by_rank", "rank")),
    "totals_by_urban_tier": _with(*_PLANNING_CTES, BY_TIER, query=_total("by_tier", "urban_tier")),
    "grand_total": _with(
        *_WIDE_CTES, BY_COMPANY,
        query="SELECT CAST(sum(value) AS BIGINT) AS total FROM by_company WHERE product <> 'total'",
    ),
    "top_branches": _with(
        *_WIDE_CTES, LONG, query="""
SELECT country, branch, CAST(sum(value) AS DOUBLE) AS total FROM long
WHERE product <> 'total' AND country IS NOT NULL AND branch IS NOT NULL
GROUP BY country, branch ORDER BY total DESC, country, branch LIMIT 10"""
    ),
    "top_states": _with(
        *_PLANNING_CTES, BY_STATE,
        query="""
SELECT country, state, CAST(sum(value) AS BIGINT) AS total FROM by_state WHERE product <> 'total'
GROUP BY country, state ORDER BY total DESC, country, state LIMIT 10""",
    ),
    "share_by_product": _with(*_WIDE_CTES, BY_COMPANY, query=_share("by_company", "product")),
    "share_by_country": _with(*_WIDE_CTES, BY_COUNTRY, query=_share("by_country", "country")),
    "share_by_rank": _with(*_PLANNING_CTES, BY_RANK, query=_share("by_rank", "rank")),
    "share_by_urban_tier": _with(*_PLANNING_CTES, BY_TIER, query=_share("by_tier", "urban_tier")),
    "per_capita": _with(
        *_PLANNING_CTES,
        query="""
SELECT country, CAST(sum(units) AS BIGINT) AS value, CAST(sum(population) AS BIGINT) AS population,
       round(CASE WHEN sum(population) > 0 THEN CAST(sum(units) AS DOUBLE) / sum(population) ELSE 0 END, 6)
         AS per_capita
FROM (SELECT country, state, city, sum(rented_new + rented_semi + rented_used) AS units,
             max(population) AS population
      FROM planning WHERE country IS NOT NULL AND population IS NOT NULL GROUP BY country, state, city)
GROUP BY country""",
    ),
    "population_by_country": _with(
        *_PLANNING_CTES,
        query="SELECT DISTINCT country, population FROM planning "
              "WHERE country IS NOT NULL AND population IS NOT NULL",
    ),
    "cross_tab_branch": _with(*_WIDE_CTES, LONG, query=_cross("branch", False)),
    "cross_tab_country": _with(*_WIDE_CTES, LONG, query=_cross("country", True)),
    "ops_list": _with(
        *_WIDE_CTES,
        query="""
SELECT month_end, branch, maint_internal, maint_customer, rented_total, operational_total,
       round(CAST(rented_total AS DOUBLE) / nullif(operational_total, 0), 4) AS utilisation,
       round(CAST(maintenance_total AS DOUBLE) / nullif(operational_total, 0), 4) AS maintenance_index,
       round(CAST(ready_total AS DOUBLE) / nullif(operational_total, 0), 4) AS ready_index
FROM wide WHERE year(month_end) = 2000 AND month(month_end) = 1
ORDER BY maint_internal DESC NULLS LAST, branch""",
    ),
    "clean_wide": _with(
        *_PLANNING_CTES, CLEAN, query=f"SELECT {_rounded(('mech_total', 'mech_present'))} FROM clean"
    ),
    "panel_long": _with(
        *_PLANNING_CTES, CLEAN, PANEL_LONG,
        query=f"SELECT {_rounded(('mech_total', 'mech_present'))} FROM panel_long",
    ),
    "panel_dense": _with(*_PANEL_CTES, query=f"SELECT {_rounded(('mech_total', 'mech_present'))} FROM panel"),
    "branch_maturity": _with(
        *_PANEL_CTES,
        query="""
SELECT branch, first_date, days, round(days / 30.0, 6) AS months,
       CASE WHEN days < 60 THEN 'just opened' WHEN days < 180 THEN 'young'
            WHEN days < 360 THEN 'intermediate' ELSE 'mature' END AS maturity
FROM (SELECT branch,
             coalesce(min(date) FILTER (WHERE value > 0), (SELECT min(date) FROM panel)) AS first_date,
             CAST(coalesce(date_diff('day', min(date) FILTER (WHERE value > 0),
                                     max(date) FILTER (WHERE value > 0)), 0) AS BIGINT) AS days
      FROM panel GROUP BY branch)""",
    ),
    "recency_window": _with(*_PANEL_CTES, RECENT, query="SELECT date, branch, product, value FROM recent"),
    "log_roundtrip": _with(
        *_PANEL_CTES,
        query="""
SELECT date, branch, product, value, round(ln(1 + value), 6) AS value_log,
       round(greatest(exp(ln(1 + value)) - 1, 0), 2) AS restored FROM panel""",
    ),
    "category_codes": _with(*_PANEL_CTES, RECENT, query=_CODES),
    "category_roundtrip": _with(
        *_PANEL_CTES, RECENT,
        query=f"SELECT date, {', '.join(f'{_code(c)} AS {c}' for c in _ENCODED)} FROM recent",
    ),
    "lag_features": _with(*_PANEL_CTES, RECENT, query=_LAG_ROWS),
    "training_rows": _with(*_PANEL_CTES, RECENT, query=_TRAINING_ROWS),
    "future_covariates": _with(
        *_PANEL_CTES, _FUTURE,
        query=f"SELECT {_rounded(('mech_total', 'mech_present'))}, CAST(month(date) AS BIGINT) AS month_number "
              "FROM extended",
    ),
    "ensemble_forecast": _with(*_ENSEMBLE, query=_ENSEMBLE_ROWS),
    "ensemble_calendar": _with(*_WIDE_CTES, _ensemble_ctes(True), query=_ENSEMBLE_ROWS),
    "ensemble_summary": _with(
        *_ENSEMBLE, _SUMMARY_CTE, query="SELECT period, product, round(total, 4) AS total FROM summary"
    ),
    "ensemble_summary_table": _with(
        *_ENSEMBLE, _SUMMARY_CTE,
        query="SELECT period, "
        + ", ".join(
            f"CAST(trunc(coalesce(sum(total) FILTER (WHERE product = '{p}'), 0)) AS BIGINT) AS {p}"
            for p in _CLASSES
        )
        + " FROM summary GROUP BY period UNION ALL SELECT 'TOTAL', "
        + ", ".join(
            f"CAST(round(coalesce(sum(total) FILTER (WHERE product = '{p}'), 0)) AS BIGINT)" for p in _CLASSES
        )
        + " FROM summary",
    ),
    "actual_vs_forecast": _with(*_ENSEMBLE, _SCENARIOS, query="SELECT * FROM scenarios"),
    "scenario_branches": _with(
        *_ENSEMBLE, _SCENARIOS,
        query="SELECT branch, CASE WHEN branch = (SELECT min(branch) FROM scenarios) THEN 1 ELSE 0 END "
              "AS is_default FROM (SELECT DISTINCT branch FROM scenarios)",
    ),
    "column_profile": _profile(),
}
# the same results, read from a copy partitioned by month
ORACLE |= {f"{name}_partitioned": ORACLE[name] for name in ("stock_month_end", "ops_list")}
