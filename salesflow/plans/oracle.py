"""The registered queries as plain SQL over the given tables.

Each text stands alone. Steps are common table expressions, put together by name.
"""

from salesflow.schemas import METRICS as _METRICS
from salesflow.schemas import STATE

_STATE_COLUMNS = STATE.fieldNames()

_STEPS = {
    "lines": """
        SELECT 'TXN_' || printf('%010d', k * 10 + n) AS transaction_id,
               CAST(d AS VARCHAR) AS transaction_date,
               'SKU_' || printf('%05d', p) AS sku_id,
               CAST(q AS BIGINT) AS quantity_sold,
               CAST(r AS DOUBLE) AS revenue_usd,
               CASE WHEN (k + n) % 25 = 0 THEN NULL
                    ELSE CAST(d + CAST((k * 7 + n) % 49 - 4 AS INTEGER) AS VARCHAR) END AS maturity_date,
               k, n
        FROM (SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS n, l_partkey AS p, l_quantity AS q,
                     l_extendedprice AS r,
                     DATE '2025-10-01' + CAST(l_orderkey % 10 AS INTEGER) AS d
              FROM lineitem)""",
    "txn": """
        SELECT 'client_' || CAST(1 + o_custkey % 2 AS VARCHAR) AS client_id, lines.*,
               CASE WHEN k % 100 < 20 THEN z || '-0042'
                    WHEN k % 100 < 35 THEN ' ' || z || '  '
                    WHEN k % 100 < 45 THEN substr(z, 1, 3) || ' ' || substr(z, 4)
                    WHEN k % 100 < 52 THEN 'ZIP' || z
                    WHEN k % 100 < 58 THEN 'zip' || z
                    WHEN k % 100 < 63 THEN 'INTL 00000'
                    WHEN k % 100 < 67 THEN 'INVALID_ZIP'
                    WHEN k % 100 < 70 THEN NULL
                    ELSE z END AS zip_code_raw
        FROM lines
        JOIN (SELECT o_orderkey, o_custkey,
                     printf('%05d', o_custkey) AS z
              FROM orders) ON k = o_orderkey""",
    "sku": """
        SELECT CASE WHEN p_partkey % 40 = 7 THEN 'RETIRED_' ELSE 'SKU_' END
                 || printf('%05d', p_partkey) AS sku_id,
               p_brand AS sku_group, p_type AS category,
               lower(CASE WHEN p_size > 25 THEN 'TRUE' ELSE 'false' END) = 'true' AS is_high_priority
        FROM part""",
    "zip": """
        SELECT CASE WHEN c_custkey % 30 = 7 THEN 'CLOSED_' ELSE '' END
                 || printf('%05d', c_custkey) AS zip_code,
               c_mktsegment AS city,
               CASE WHEN n_regionkey = 1 THEN 'CA' ELSE n_name END AS state,
               lower(CASE WHEN c_custkey % 5 <> 0 THEN 'True' ELSE 'FALSE' END) = 'true' AS is_us
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "parsed": """
        SELECT client_id, transaction_id, sku_id, quantity_sold, revenue_usd, zip_code_raw,
               CAST(transaction_date AS DATE) AS t,
               CAST(try_strptime(maturity_date, '%Y-%m-%d') AS DATE) AS m,
               substr(regexp_replace(upper(coalesce(zip_code_raw, '')), '[^0-9]', '', 'g'), 1, 5)
                 AS zip_candidate
        FROM txn""",
    "cleaned": """
        SELECT client_id, transaction_id, sku_id, quantity_sold, revenue_usd, zip_code_raw, zip_candidate,
               CASE WHEN length(zip_candidate) = 5 THEN zip_candidate END AS zip_code,
               CASE WHEN length(zip_candidate) = 5 THEN 0 ELSE 1 END AS invalid,
               t AS transaction_date, coalesce(m, t + 3) AS maturity_date,
               CASE WHEN m IS NULL THEN 1 ELSE 0 END AS imputed,
               CASE WHEN coalesce(m, t + 3) < t THEN 0
                    ELSE date_diff('day', t, coalesce(m, t + 3)) END AS days
        FROM parsed""",
    "enriched": """
        SELECT c.*, CASE WHEN s.sku_group IS NULL THEN 1 ELSE 0 END AS sku_miss,
               coalesce(s.sku_group, 'UNKNOWN') AS sku_group,
               coalesce(s.category, 'Unassigned') AS category,
               coalesce(s.is_high_priority, false) AS is_high_priority,
               CASE WHEN z.state IS NULL THEN 1 ELSE 0 END AS zip_miss,
               coalesce(z.state, 'UNKNOWN') AS state, coalesce(z.city, 'Unknown') AS city,
               coalesce(z.is_us, false) AS is_us,
               coalesce(z.is_us, false) AND coalesce(z.state, 'UNKNOWN') = 'CA' AS local
        FROM cleaned c LEFT JOIN sku s USING (sku_id) LEFT JOIN zip z USING (zip_code)
        WHERE invalid = 0""",
}

_ORDER = ["lines", "txn", "sku", "zip", "parsed", "cleaned", "enriched"]

_MEASURES = """
    min(category) AS category, bool_or(is_high_priority) AS is_high_priority,
    CAST(sum(quantity_sold) AS BIGINT) AS total_quantity,
    CAST(sum(CAST(round(revenue_usd * 10000) AS BIGINT)) AS BIGINT) AS units,
    count(*) AS order_count,
    CAST(sum(quantity_sold) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_quantity_per_order,
    CAST(sum(days) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS days_to_maturity"""

_USD = "CAST(units AS DOUBLE) / CAST(10000 AS DOUBLE)"

_SALES = """
    CAST(transaction_date AS VARCHAR) AS transaction_date, CAST(maturity_date AS VARCHAR) AS maturity_date,
    sku_group, local, category, is_high_priority, total_quantity, total_revenue, order_count,
    avg_quantity_per_order, avg_order_value, days_to_maturity, revenue_share_of_day, revenue_rank"""


def _aggregate(by: str = "", where: str = "true") -> str:
    return f"""
        SELECT {by} transaction_date, maturity_date, sku_group, local, {_MEASURES}
        FROM enriched WHERE {where}
        GROUP BY {by} transaction_date, maturity_date, sku_group, local"""


def _ranked(source: str, by: str = "") -> str:
    return f"""
        SELECT *, {_USD} AS total_revenue,
               {_USD} / CAST(order_count AS DOUBLE) AS avg_order_value,
               CASE WHEN sum(units) OVER w > 0
                    THEN CAST(units AS DOUBLE) / CAST(sum(units) OVER w AS DOUBLE)
                    ELSE 0.0 END AS revenue_share_of_day,
               dense_rank() OVER (PARTITION BY {by} transaction_date, local ORDER BY units DESC) AS revenue_rank
        FROM ({source}) WINDOW w AS (PARTITION BY {by} transaction_date, local)"""


def _with(last: str, select: str, **extra: str) -> str:
    """``select`` preceded by the steps up to ``last`` and the extra ones."""
    steps = {name: _STEPS[name] for name in _ORDER[: _ORDER.index(last) + 1]} | extra
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in steps.items()) + "\n" + select


def _sales(select: str, by: str = "", where: str = "true", **extra: str) -> str:
    return _with("enriched", select, sales=_ranked(_aggregate(by, where), by), **extra)


_FIVE_BEST = """
    SELECT * FROM sales WHERE transaction_date = (SELECT max(transaction_date) FROM sales)
    ORDER BY total_revenue DESC, sku_group, local, maturity_date LIMIT 5"""

_PERTURBED = """
    SELECT * REPLACE (CASE WHEN revenue_rank = 1 AND NOT local THEN total_revenue + 1
                           ELSE total_revenue END AS total_revenue)
    FROM sales WHERE NOT (sku_group = 'Brand#2' AND local)"""


_VERDICT = "1e-6 + 1e-6 * abs(b.{m})"
_DISTANCE = "1e-4"

_EXACT = ["total_quantity", "order_count", "revenue_rank"]


def _differs(m: str, bound: str) -> str:
    if m in _EXACT:
        return f"(i.{m} IS DISTINCT FROM b.{m})"
    apart = f"coalesce(abs(i.{m} - b.{m}) > {bound.format(m=m)}, false)"
    return f"((i.{m} IS NULL) <> (b.{m} IS NULL) OR {apart})"


_BOTH_SIDES = """
    FROM copy i FULL JOIN sales b ON i.transaction_date = b.transaction_date
      AND i.maturity_date = b.maturity_date AND i.sku_group = b.sku_group AND i.local = b.local"""

_STATE = """
    SELECT client_id, CAST(transaction_date AS VARCHAR) AS transaction_date,
           CAST(maturity_date AS VARCHAR) AS maturity_date, sku_group, CAST(local AS INTEGER) AS local,
           total_quantity, total_revenue, order_count, avg_quantity_per_order, avg_order_value,
           days_to_maturity, revenue_share_of_day, revenue_rank FROM sales"""

_DAILY = """
    SELECT transaction_date, CAST(sum(quantity_sold) AS BIGINT) AS total_quantity,
           CAST(sum(CAST(round(revenue_usd * 10000) AS BIGINT)) AS DOUBLE) / CAST(10000 AS DOUBLE) AS total_revenue,
           CAST(sum(CAST(round(revenue_usd * 10000) AS BIGINT)) AS DOUBLE) / CAST(10000 AS DOUBLE)
             / CAST(count(revenue_usd) AS DOUBLE) AS avg_revenue,
           count({counted}) AS order_count
    FROM lines WHERE transaction_date IS NOT NULL GROUP BY transaction_date"""

_KEYS_TEXT = (
    "CAST(transaction_date AS VARCHAR) AS transaction_date, "
    "CAST(maturity_date AS VARCHAR) AS maturity_date, sku_group, local"
)


# --- generators: the same hashes, lanes and weight line as plain SQL ---


def _lane(text: str, index: int) -> str:
    return f"CAST('0x' || substr(md5({text}), {1 + 8 * index}, 8) AS BIGINT)"


def _uniform(text: str, index: int) -> str:
    return f"(CAST({_lane(text, index)} AS DOUBLE) / CAST(4294967296 AS DOUBLE))"


def _seeded(seed: str, row: str = "CAST(id AS VARCHAR)") -> str:
    return f"{row} || ':{seed}'"


def _draw(index: int, count: int, seed: str) -> str:
    return f"CAST(floor({_uniform(_seeded(seed), index)} * {count}) AS BIGINT)"


def _point(text: str, index: int) -> str:
    return f"({_lane(text, index)} * 1073741824 + {_lane(text, index + 1)} // 4)"


def _line(key: str, weighted: str) -> str:
    """Adjoining pieces of [0, 2**62), ordered by block and key."""
    return f"""
        SELECT {key}, CAST(floor(CAST(upto - weight AS DOUBLE) * CAST(4611686018427387904 AS DOUBLE)
                                 / CAST(total AS DOUBLE)) AS BIGINT) AS lo,
               CAST(floor(CAST(upto AS DOUBLE) * CAST(4611686018427387904 AS DOUBLE)
                          / CAST(total AS DOUBLE)) AS BIGINT) AS hi
        FROM (SELECT {key}, weight, CAST(sum(weight) OVER () AS BIGINT) AS total,
                     CAST(sum(weight) OVER (ORDER BY substr(md5({key}), 1, 2), {key}) AS BIGINT) AS upto
              FROM ({weighted}))"""


_IDS = "SELECT range AS id FROM range((SELECT count(*) FROM lineitem))"

_SKU_LINE = _line(
    "sku_id",
    f"""SELECT sku_id, CAST(ceil((pow(1 - {_uniform(_seeded('sku', 'sku_id'), 0)},
                                     CAST(-1.0 AS DOUBLE) / CAST(1.16 AS DOUBLE)) - 1) * 1000000) AS BIGINT) AS weight
        FROM sku""",
)

_ZIP_LINE = _line(
    "zip_code",
    """SELECT zip_code, CASE WHEN zip_code = '00000' THEN 500000
                                WHEN state = 'CA' THEN 3000000 ELSE 1000000 END AS weight FROM zip""",
)

_NOISE = f"""
    CASE WHEN shape < 0.20 THEN zip_code || '-' || printf('%04d', {_draw(1, 10000, 'txn-noise')})
         WHEN shape < 0.35 THEN ' ' || zip_code || '  '
         WHEN shape < 0.45 THEN substr(zip_code, 1, 3) || ' ' || substr(zip_code, 4)
         WHEN shape < 0.52 THEN 'ZIP' || zip_code
         WHEN shape < 0.58 THEN lower(zip_code)
         WHEN shape < 0.63 THEN 'INTL 00000'
         WHEN shape < 0.67 THEN 'INVALID_ZIP'
         WHEN shape < 0.70 THEN NULL
         ELSE zip_code END"""

_MATURITY = f"""
    CASE WHEN {_uniform(_seeded('txn-kinds'), 3)} >= 0.04
         THEN CAST(day + CAST(CASE
             WHEN {_uniform(_seeded('txn-kinds'), 2)} < 0.04 THEN 45 + {_draw(2, 75, 'txn-offsets')}
             WHEN {_uniform(_seeded('txn-kinds'), 1)} < 0.03 THEN -1 - {_draw(1, 4, 'txn-offsets')}
             WHEN {_uniform(_seeded('txn-kinds'), 0)} < 0.05 THEN 0
             ELSE 1 + {_draw(0, 44, 'txn-offsets')} END AS INTEGER) AS VARCHAR) END"""


def _generators() -> dict[str, str]:
    picks = f"""
        SELECT id, {_point(_seeded('txn-places'), 0)} AS sku_point, {_point(_seeded('txn-places'), 2)} AS zip_point,
               {_uniform(_seeded('txn-noise'), 0)} AS shape FROM ({_IDS})"""
    noisy = f"""
        SELECT id, sku_point, zip_code, {_NOISE} AS zip_code_raw
        FROM picks JOIN zip_line ON zip_point >= zip_line.lo AND zip_point < zip_line.hi"""
    steps = {"zip_line": _ZIP_LINE, "picks": picks, "noisy": noisy}
    dated = """
        SELECT noisy.*, DATE '2025-10-01' + CAST(CASE WHEN id < first_day THEN 0
                   ELSE 1 + (id - first_day) // per_day END AS INTEGER) AS day
        FROM noisy, (SELECT n - 9 * greatest(1, n // 100) AS first_day, greatest(1, n // 100) AS per_day
                     FROM (SELECT count(*) AS n FROM lineitem))"""
    return {
        "synth_transactions": _with(
            "zip",
            f"""SELECT 'TXN_' || printf('%010d', id) AS transaction_id, CAST(day AS VARCHAR) AS transaction_date, sku_id,
                   1 + {_draw(1, 10, 'txn-picks')} AS quantity_sold,
                   CAST(500 + {_draw(2, 49501, 'txn-picks')} AS DOUBLE) / CAST(100 AS DOUBLE) AS revenue_usd,
                   {_MATURITY} AS maturity_date, zip_code_raw
            FROM dated JOIN sku_line ON sku_point >= sku_line.lo AND sku_point < sku_line.hi""",
            **steps,
            sku_line=_SKU_LINE,
            dated=dated,
        ),
        "synth_zip_noise": _with("zip", "SELECT id, zip_code, zip_code_raw FROM noisy", **steps),
        "synth_maturity": f"""
            SELECT id, CAST(day AS VARCHAR) AS transaction_date, {_MATURITY} AS maturity_date
            FROM (SELECT l_orderkey * 10 + l_linenumber AS id,
                         DATE '2025-10-01' + CAST(l_orderkey % 10 AS INTEGER) AS day FROM lineitem)""",
    }


def oracle_sql() -> dict[str, str]:
    found = _texts()
    same = {
        "csv_scan_typed": "txn_scan_typed",
        "full_pipeline_large": "full_pipeline",
        "csv_sink_roundtrip": "full_pipeline",
        "revenue_rank_large": "revenue_rank",
        "incremental_landed": "state_projection",
        "changed_replay": "state_projection",
        "state_rebuild_client": "state_projection",
        "state_schema_drift": "state_projection",
        "quality_one_pass": "quality_report",
        "top5_one_pass": "top5_latest_day",
    }
    return found | {name: found[other] for name, other in same.items()}


def _texts() -> dict[str, str]:
    flat = "SELECT transaction_id, transaction_date, sku_id, quantity_sold FROM lines"
    after = f"{flat} WHERE transaction_date > '2025-10-05'"
    malformed = """
        SELECT transaction_id, transaction_date,
               CASE WHEN (k + n) % 25 = 1 THEN '2025-13-01' ELSE maturity_date END AS maturity_text
        FROM lines"""
    return {
        "txn_scan_typed": _with("txn", "SELECT transaction_id, transaction_date, sku_id, quantity_sold, revenue_usd, maturity_date, zip_code_raw FROM txn"),
        "archive_roundtrip": _with(
            "txn",
            """SELECT client_id, CAST(10 AS INTEGER) AS snapshot_day, transaction_id, transaction_date, sku_id, quantity_sold,
                   revenue_usd, maturity_date, zip_code_raw FROM txn""",
        ),
        "sku_lookup": _with("sku", "SELECT sku_id, sku_group, category, is_high_priority FROM sku"),
        "zip_lookup": _with("zip", "SELECT zip_code, city, state, is_us FROM zip"),
        "date_filter_gt": _with("lines", after),
        "date_filter_sql": "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem WHERE l_shipdate > TIMESTAMP '1996-01-01 00:00:00'",
        "parse_dates": _with(
            "lines",
            "SELECT transaction_id, CAST(CAST(transaction_date AS DATE) AS VARCHAR) AS transaction_date, maturity_text, "
            "CAST(CAST(try_strptime(maturity_text, '%Y-%m-%d') AS DATE) AS VARCHAR) AS maturity_parsed FROM dirty",
            dirty=malformed,
        ),
        "zip_normalize": _with("cleaned", "SELECT transaction_id, zip_code_raw, zip_candidate, zip_code, invalid AS zip_invalid FROM cleaned"),
        "zip_valid_rows": _with("cleaned", "SELECT transaction_id, zip_code FROM cleaned WHERE invalid = 0"),
        "maturity_impute": _with("cleaned", "SELECT transaction_id, CAST(maturity_date AS VARCHAR) AS maturity_date, imputed AS maturity_imputed FROM cleaned"),
        "days_to_maturity": _with("cleaned", "SELECT transaction_id, CAST(days AS BIGINT) AS days_to_maturity FROM cleaned"),
        "enrich_sku": _with("enriched", "SELECT transaction_id, sku_id, sku_group, category, is_high_priority, CAST(sku_miss AS BIGINT) AS sku_lookup_miss FROM enriched"),
        "enrich_zip": _with("enriched", "SELECT transaction_id, zip_code, state, city, is_us, CAST(zip_miss AS BIGINT) AS zip_lookup_miss FROM enriched"),
        "local_flag": _with("enriched", "SELECT transaction_id, state, is_us, local FROM enriched"),
        "quality_base": _with("cleaned", "SELECT count(*) AS rows_input, CAST(sum(invalid) AS BIGINT) AS invalid_zip_dropped, CAST(sum(imputed) AS BIGINT) AS maturity_imputed FROM cleaned"),
        "quality_join": _with("enriched", "SELECT count(*) AS rows_after_join, CAST(sum(zip_miss) AS BIGINT) AS zip_lookup_miss, CAST(sum(sku_miss) AS BIGINT) AS sku_lookup_miss FROM enriched"),
        "quality_report": _with(
            "enriched",
            "SELECT (SELECT count(*) FROM cleaned) AS rows_input, (SELECT CAST(sum(invalid) AS BIGINT) FROM cleaned) AS invalid_zip_dropped, "
            "(SELECT CAST(sum(imputed) AS BIGINT) FROM cleaned) AS maturity_imputed, count(*) AS rows_after_join, "
            "CAST(sum(zip_miss) AS BIGINT) AS zip_lookup_miss, CAST(sum(sku_miss) AS BIGINT) AS sku_lookup_miss FROM enriched",
        ),
        "sales_aggregate": _sales(
            f"SELECT {_KEYS_TEXT}, category, is_high_priority, total_quantity, total_revenue, order_count, "
            "avg_quantity_per_order, avg_order_value, days_to_maturity FROM sales"
        ),
        "revenue_share": _sales(f"SELECT {_KEYS_TEXT}, total_revenue, revenue_share_of_day FROM sales"),
        "revenue_rank": _sales(f"SELECT {_KEYS_TEXT}, total_revenue, revenue_rank FROM sales"),
        "full_pipeline": _sales(f"SELECT {_SALES} FROM sales"),
        "multi_client_pipeline": _sales(f"SELECT client_id, {_SALES} FROM sales", by="client_id,"),
        "daily_totals": _with("lines", _DAILY.format(counted="*")),
        "daily_totals_nonnull": _with("lines", _DAILY.format(counted="revenue_usd")),
        "sku_day_totals": _with(
            "lines",
            "SELECT sku_id, transaction_date, CAST(sum(quantity_sold) AS BIGINT) AS total_quantity, "
            "CAST(sum(CAST(round(revenue_usd * 10000) AS BIGINT)) AS DOUBLE) / CAST(10000 AS DOUBLE) AS total_revenue "
            "FROM lines GROUP BY sku_id, transaction_date",
        ),
        "sku_concentration": """
            WITH hits AS (SELECT l_partkey, count(*) AS hits FROM lineitem GROUP BY l_partkey),
            placed AS (SELECT hits, row_number() OVER (ORDER BY hits DESC, l_partkey) AS place,
                              count(*) OVER () AS skus FROM hits)
            SELECT count(*) AS sku_count, CAST(max(floor(skus * CAST(0.2 AS DOUBLE))) AS BIGINT) AS top_sku_count,
                   CAST(sum(hits) AS BIGINT) AS total_weight,
                   CAST(sum(CASE WHEN place <= floor(skus * CAST(0.2 AS DOUBLE)) THEN hits ELSE 0 END) AS BIGINT) AS top_weight,
                   CAST(sum(CASE WHEN place <= floor(skus * CAST(0.2 AS DOUBLE)) THEN hits ELSE 0 END) AS DOUBLE)
                     / CAST(sum(hits) AS DOUBLE) AS top_share
            FROM placed""",
        "top5_latest_day": _sales(f"SELECT {_SALES} FROM ({_FIVE_BEST})"),
        "top5_report": _sales(
            "SELECT sku_group, CAST(maturity_date AS VARCHAR) AS maturity_date, "
            "CASE WHEN local THEN 'Local' ELSE 'Non-local' END AS locality, revenue_rank, total_revenue, order_count, "
            "avg_order_value, avg_quantity_per_order, revenue_share_of_day * 100 AS revenue_share_percent, "
            f"days_to_maturity FROM ({_FIVE_BEST})"
        ),
        "leaderboard_sku_group": _with(
            "enriched",
            f"""SELECT CAST(transaction_date AS VARCHAR) AS transaction_date, place, sku_group, local,
                   {_USD} AS total_revenue, order_count,
                   {_USD} / CAST(order_count AS DOUBLE) AS avg_order_value,
                   CAST(units AS DOUBLE) / CAST(day_units AS DOUBLE) AS revenue_share_of_day
            FROM (SELECT *, sum(units) OVER (PARTITION BY transaction_date, local) AS day_units,
                         row_number() OVER (PARTITION BY transaction_date
                                            ORDER BY units DESC, sku_group, local) AS place
                  FROM rolled) WHERE place <= 5""",
            rolled="""SELECT transaction_date, sku_group, local, count(*) AS order_count,
                   CAST(sum(CAST(round(revenue_usd * 10000) AS BIGINT)) AS BIGINT) AS units
            FROM enriched GROUP BY transaction_date, sku_group, local""",
        ),
        "locality_summary": _sales(
            """SELECT CASE WHEN local THEN 'Local (CA)' ELSE 'Non-local' END AS segment, local,
                   CAST(sum(total_quantity) AS BIGINT) AS total_quantity,
                   CAST(sum(units) AS DOUBLE) / CAST(10000 AS DOUBLE) AS total_revenue,
                   CAST(sum(order_count) AS BIGINT) AS order_count,
                   round(sum(avg_order_value * order_count) / CAST(sum(order_count) AS DOUBLE), 6) AS avg_order_value,
                   round(sum(days_to_maturity * order_count) / CAST(sum(order_count) AS DOUBLE), 6)
                     AS avg_days_to_maturity
            FROM sales WHERE transaction_date = DATE '2025-10-10' GROUP BY local"""
        ),
        "state_projection": _sales(_STATE, by="client_id,"),
        "last_processed_date": _with(
            "enriched",
            "SELECT client_id, CAST(max(transaction_date) AS VARCHAR) AS last_processed_date FROM enriched GROUP BY client_id",
        ),
        "incremental_batch": _sales(f"SELECT {_SALES} FROM sales", where="transaction_date > DATE '2025-10-05'"),
        "late_rows": _with(
            "txn",
            """SELECT client_id, transaction_id, transaction_date, arrival_day, high_water
            FROM arrived JOIN (
                SELECT client_id, arrival_day, max(newest) OVER (
                           PARTITION BY client_id ORDER BY arrival_day
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high_water
                FROM (SELECT client_id, arrival_day, max(transaction_date) AS newest
                      FROM arrived GROUP BY client_id, arrival_day)) USING (client_id, arrival_day)
            WHERE transaction_date <= high_water""",
            arrived="""SELECT client_id, transaction_id, transaction_date,
                CASE WHEN k % 97 = 0 AND transaction_date < '2025-10-10'
                     THEN CAST(CAST(transaction_date AS DATE) + 1 AS VARCHAR)
                     ELSE transaction_date END AS arrival_day
            FROM txn""",
        ),
        "state_after_replay": _sales(_STATE, by="client_id,"),
        "state_constraint_check": _sales(
            f"""SELECT CAST(sum(n) AS BIGINT) AS row_count, count(*) FILTER (WHERE n > 1) AS duplicate_keys,
                   CAST(sum(n - 1) AS BIGINT) AS surplus_rows,
                   {', '.join(f'CAST(sum(null_{c}) AS BIGINT) AS null_{c}' for c in _STATE_COLUMNS)}
            FROM (SELECT count(*) AS n,
                         {', '.join(f'count(*) - count({c}) AS null_{c}' for c in _STATE_COLUMNS)}
                  FROM ({_STATE}) GROUP BY client_id, transaction_date, maturity_date, sku_group, local)""",
            by="client_id,",
        ),
        "parity_summary": _sales(
            f"""SELECT *, only_in_incremental + only_in_baseline
                   + {' + '.join(f'differs_{m}' for m in _METRICS)} = 0 OR incremental_keys = 0 AS parity_pass
            FROM (SELECT count(*) AS keys_compared, count(i.order_count) AS incremental_keys,
                   count(*) FILTER (WHERE b.order_count IS NULL) AS only_in_incremental,
                   count(*) FILTER (WHERE i.order_count IS NULL) AS only_in_baseline,
                   {', '.join(f'count(*) FILTER (WHERE i.order_count IS NOT NULL AND b.order_count IS NOT NULL AND {_differs(m, _VERDICT)}) AS differs_{m}' for m in _METRICS)}
                  {_BOTH_SIDES})""",
            copy=_PERTURBED,
        ),
        "stored_day_parity": _sales(
            f"""SELECT *, only_in_incremental + only_in_baseline
                   + {' + '.join(f'differs_{m}' for m in _METRICS)} = 0 OR incremental_keys = 0 AS parity_pass
            FROM (SELECT coalesce(i.client_id, b.client_id) AS client_id,
                   CAST(coalesce(i.transaction_date, b.transaction_date) AS VARCHAR) AS transaction_date,
                   count(*) AS keys_compared, count(i.order_count) AS incremental_keys,
                   count(*) FILTER (WHERE b.order_count IS NULL) AS only_in_incremental,
                   count(*) FILTER (WHERE i.order_count IS NULL) AS only_in_baseline,
                   {', '.join(f'count(*) FILTER (WHERE i.order_count IS NOT NULL AND b.order_count IS NOT NULL AND {_differs(m, _VERDICT)}) AS differs_{m}' for m in _METRICS)}
                  {_BOTH_SIDES} AND i.client_id = b.client_id GROUP BY 1, 2)""",
            by="client_id,",
            copy=_PERTURBED,
        ),
        "parity_diff": _sales(
            f"""SELECT CAST(coalesce(i.transaction_date, b.transaction_date) AS VARCHAR) AS transaction_date,
                   CAST(coalesce(i.maturity_date, b.maturity_date) AS VARCHAR) AS maturity_date,
                   coalesce(i.sku_group, b.sku_group) AS sku_group, coalesce(i.local, b.local) AS local,
                   CASE WHEN b.order_count IS NULL THEN 'incremental'
                        WHEN i.order_count IS NULL THEN 'baseline' ELSE 'both' END AS found_in,
                   {', '.join(f'i.{m} AS {m}_incremental, b.{m} AS {m}_baseline' for m in _METRICS)}
            {_BOTH_SIDES}
            WHERE i.order_count IS NULL OR b.order_count IS NULL OR {' OR '.join(_differs(m, _DISTANCE) for m in _METRICS)}""",
            copy=_PERTURBED,
        ),
        "max_date": _sales("SELECT CAST(max(transaction_date) AS VARCHAR) AS target_transaction_date FROM sales"),
        "parity_head": _sales(
            f"""SELECT * FROM (SELECT CAST(coalesce(i.transaction_date, b.transaction_date) AS VARCHAR) AS transaction_date,
                   CAST(coalesce(i.maturity_date, b.maturity_date) AS VARCHAR) AS maturity_date,
                   coalesce(i.sku_group, b.sku_group) AS sku_group, coalesce(i.local, b.local) AS local,
                   CASE WHEN b.order_count IS NULL THEN 'incremental'
                        WHEN i.order_count IS NULL THEN 'baseline' ELSE 'both' END AS found_in,
                   {', '.join(f'i.{m} AS {m}_incremental, b.{m} AS {m}_baseline' for m in _METRICS)}
            {_BOTH_SIDES}
            WHERE i.order_count IS NULL OR b.order_count IS NULL OR {' OR '.join(_differs(m, _DISTANCE) for m in _METRICS)})
            ORDER BY transaction_date, maturity_date, sku_group, local LIMIT 5""",
            copy=_PERTURBED,
        ),
        "snapshot_rows": _with(
            "txn",
            """SELECT s.client_id, s.snapshot_day,
                   count(*) FILTER (WHERE t.transaction_date = s.snapshot_day) AS new_rows, count(*) AS snapshot_rows
            FROM (SELECT DISTINCT client_id, transaction_date AS snapshot_day FROM txn) s
            JOIN txn t ON t.client_id = s.client_id AND t.transaction_date <= s.snapshot_day
            GROUP BY s.client_id, s.snapshot_day""",
        ),
    } | _generators()

