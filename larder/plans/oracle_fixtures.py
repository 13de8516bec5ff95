"""DuckDB spellings of the derived entities (independent of the Spark code).

Each entry is one CTE body; ``with_ctes`` pulls in dependencies in order.
"""

from __future__ import annotations


def money(x: str) -> str:
    return (f"concat(cast(cast(floor(floor(({x})*1e2+5e-1)/1e2) as bigint) as VARCHAR), '.', "
            f"lpad(cast(cast(floor(({x})*1e2+5e-1) as bigint)%100 as VARCHAR),2,'0'))")


DAY = "cast(cast(l_shipdate as DATE) as VARCHAR)"

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, deps: tuple[str, ...] = ()) -> None:
    CTES[name] = (deps, body)


cte("sales_raw", f"""
SELECT concat('T', l_orderkey, '-', l_partkey, '-', l_suppkey) AS transaction_id,
       cast(l_linenumber as VARCHAR) AS line_number,
       concat('S', l_suppkey) AS store_id,
       concat('P', l_partkey) AS product_id,
       CASE WHEN l_orderkey % 29 = 0 THEN NULL WHEN l_orderkey % 47 = 0 THEN 'bad'
            WHEN l_orderkey % 59 = 0 THEN '0'
            ELSE cast(cast(l_quantity as BIGINT) as VARCHAR) END AS quantity,
       CASE WHEN l_orderkey % 31 = 0 THEN NULL ELSE {money('l_extendedprice/l_quantity')} END AS unit_price,
       CASE WHEN l_orderkey % 37 = 0 THEN NULL
            ELSE {money('l_extendedprice/l_quantity*l_discount')} END AS discount,
       CASE WHEN l_orderkey % 41 = 0 THEN NULL
            ELSE {money('l_extendedprice*(1e0-l_discount)')} END AS total_amount,
       o_orderpriority AS payment_type,
       CASE WHEN l_returnflag = 'A' THEN 'pickup' WHEN l_returnflag = 'N' THEN 'delivery'
            ELSE 'in_store' END AS channel,
       concat('L', o_custkey) AS loyalty_id,
       CASE WHEN l_orderkey % 43 = 0 THEN 'n/a'
            ELSE concat({DAY}, ' ', lpad(cast(l_partkey % 24 as VARCHAR), 2, '0'), ':00:00') END
         AS transaction_ts,
       CASE WHEN l_orderkey % 53 = 0 THEN NULL ELSE {DAY} END AS event_date
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")


def _imp(target: str, formula: str, *needs: str) -> str:
    cond = " AND ".join(f"{n} IS NOT NULL" for n in needs)
    return f"COALESCE(TRY_CAST({target} AS DOUBLE), CASE WHEN {cond} THEN {formula} END) AS {target}"


_Q = "TRY_CAST(quantity AS DOUBLE)"
_SILVER_SELECT = f"""
SELECT transaction_id, TRY_CAST(line_number AS INTEGER) AS line_number, store_id, product_id,
       TRY_CAST(quantity AS INTEGER) AS quantity,
       {_imp('unit_price', f'TRY_CAST(total_amount AS DOUBLE)/NULLIF({_Q},0) + TRY_CAST(discount AS DOUBLE)', 'total_amount', 'discount', 'quantity')},
       {_imp('discount', f'TRY_CAST(unit_price AS DOUBLE) - TRY_CAST(total_amount AS DOUBLE)/NULLIF({_Q},0)', 'total_amount', 'unit_price', 'quantity')},
       {_imp('total_amount', f'{_Q} * (TRY_CAST(unit_price AS DOUBLE) - TRY_CAST(discount AS DOUBLE))', 'unit_price', 'discount', 'quantity')},
       payment_type, channel, loyalty_id,
       TRY_CAST(transaction_ts AS TIMESTAMP) AS transaction_ts,
       TRY_CAST(event_date AS DATE) AS event_date
FROM sales_raw
WHERE transaction_ts IS NOT NULL AND event_date IS NOT NULL AND quantity IS NOT NULL
  AND transaction_id IS NOT NULL AND TRY_CAST(line_number AS INTEGER) IS NOT NULL
  AND store_id IS NOT NULL AND product_id IS NOT NULL"""

cte("sales", _SILVER_SELECT, ("sales_raw",))
cte("sales_strict", _SILVER_SELECT + """
  AND TRY_CAST(transaction_ts AS TIMESTAMP) IS NOT NULL AND TRY_CAST(event_date AS DATE) IS NOT NULL
  AND TRY_CAST(quantity AS INTEGER) IS NOT NULL""", ("sales_raw",))

cte("stores", """
SELECT concat('S', s_suppkey) AS store_id, s_name AS name, r_name AS region, n_name AS city,
       concat('N', s_nationkey) AS state, lpad(cast(s_suppkey as VARCHAR), 5, '0') AS zipcode,
       cast(DATE '2018-01-01' + cast(s_suppkey % 2000 as INTEGER) as DATE) AS opened_date
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
     LEFT JOIN region ON n_regionkey = r_regionkey""")

cte("products", """
SELECT concat('P', p_partkey) AS product_id, concat('SKU-', p_partkey) AS sku, p_name AS name,
       p_type AS category, p_brand AS brand,
       CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE p_retailprice END AS base_price, 'EA' AS unit
FROM part""")

cte("competitor_raw", f"""
SELECT concat('C', k) AS competitor, concat('P', l_partkey) AS product_id,
       CASE WHEN (l_partkey + k) % 61 = 0 THEN 'oops' WHEN l_partkey % 7 = 0 THEN 'n/a'
            ELSE {money("p_retailprice*(85e-2+((l_partkey*7+k*11+dayofmonth(d))%31)/1e2)")} END AS price,
       concat(cast(d as VARCHAR), ' 06:00:00') AS scrape_ts,
       cast(d as VARCHAR) AS event_date,
       CASE WHEN (l_partkey + k) % 67 = 0 THEN '{{"extra":"1"}}'
            WHEN (l_partkey + k) % 5 = 0 THEN '{{"extra":"5"}}' ELSE NULL END AS _rescued_data
FROM (SELECT DISTINCT l_partkey, cast(l_shipdate as DATE) AS d FROM lineitem) keys
JOIN part ON l_partkey = p_partkey
CROSS JOIN (VALUES (0), (1), (2)) ks(k)""")

cte("competitor", """
SELECT competitor, product_id, TRY_CAST(price AS DOUBLE) AS price,
       TRY_CAST(scrape_ts AS TIMESTAMP) AS scrape_ts, TRY_CAST(event_date AS DATE) AS event_date
FROM competitor_raw
WHERE competitor IS NOT NULL AND product_id IS NOT NULL AND TRY_CAST(price AS DOUBLE) IS NOT NULL
  AND TRY_CAST(scrape_ts AS TIMESTAMP) IS NOT NULL AND TRY_CAST(event_date AS DATE) IS NOT NULL
  AND _rescued_data IS NULL""", ("competitor_raw",))

cte("gold", """
SELECT s.transaction_id, s.line_number, s.store_id, s.product_id, s.quantity, s.unit_price,
       s.discount, s.total_amount, s.payment_type, s.channel, s.loyalty_id, s.transaction_ts,
       s.event_date, p.sku, p.name AS product_name, p.category, p.brand, p.base_price,
       p.unit AS product_unit, st.name AS store_name, CAST(NULL AS BIGINT) AS store_manager_id,
       CAST(NULL AS VARCHAR) AS address, st.city AS store_city, st.state AS store_state,
       cp.competitor, cp.price AS competitor_price, cp.scrape_ts AS competitor_scrape_ts,
       cp.event_date AS competitor_event_date
FROM sales s LEFT JOIN products p ON s.product_id = p.product_id
     LEFT JOIN stores st ON s.store_id = st.store_id
     LEFT JOIN competitor cp ON s.product_id = cp.product_id AND s.event_date = cp.event_date""",
    ("sales", "products", "stores", "competitor"))

cte("tickets", """
SELECT event_id AS ticket_id, CASE WHEN event_id % 5 = 0 THEN 'open' ELSE 'closed' END AS status,
       event_type AS issue_category, cast(user_id % 2147483647 as INTEGER) AS unit_id, ts AS created_time,
       CASE WHEN event_id % 5 = 0 THEN NULL
            ELSE ts + to_hours(cast(event_id % 72 as BIGINT)) END AS close_time,
       value % 5e0 AS csat_score,
       cast(json_extract_string(props, '$.k') as INTEGER) AS hold_time_seconds,
       event_type = 'error' AS escalated
FROM (SELECT * REPLACE (CASE WHEN event_type = 'view' AND weekofyear(ts) % 4 = 2 THEN ts + INTERVAL 7 DAY ELSE ts END AS ts)
      FROM events) e""")

cte("chats", """
SELECT conv_id AS id, concat('U', conv_id % 20) AS user_id, concat('Chat ', conv_id) AS title,
       CASE WHEN conv_id % 4 = 0 THEN 'public' ELSE 'private' END AS visibility,
       TIMESTAMP '2024-01-01 00:00:00' + to_hours(cast(conv_id % 1000000
         - CASE WHEN conv_id % 3 = 0 AND conv_id >= 20 THEN 20 ELSE 0 END as BIGINT)) AS created_at
FROM (SELECT DISTINCT conv_id FROM conversations) c""")

cte("page_requests", """
SELECT user_id, CASE WHEN n % 6 = 5 THEN n + 1000000000 ELSE n + 40 END AS cursor_id
FROM (SELECT DISTINCT user_id, cast(substr(user_id, 2) AS BIGINT) AS n FROM chats) u""", ("chats",))

cte("lookup_requests", """
SELECT concat(conv_id, '-', CASE WHEN turn = 0 THEN 999 ELSE turn - 1 END) AS message_id FROM conversations""")

cte("messages", """
SELECT concat(conv_id, '-', turn) AS id, conv_id AS chat_id, turn, role, text,
       TIMESTAMP '2024-01-01 00:00:00' + to_hours(cast(conv_id % 1000000 as BIGINT))
         + to_minutes(cast(turn as BIGINT)) AS created_at
FROM conversations""")

cte("chat_versions", """
SELECT id, user_id, title,
       CASE WHEN (id + version) % 2 = 0 THEN 'public' ELSE 'private' END AS visibility,
       cast(version as INTEGER) AS version,
       created_at + to_minutes(cast(version * 10 as BIGINT)) AS updated_at
FROM chats CROSS JOIN (VALUES (0), (1), (2)) v(version)""", ("chats",))


def with_ctes(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` for the named CTEs and their deps."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        deps, _ = CTES[n]
        for d in deps:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n"


def _uuid(seed: str) -> str:
    h = f"md5({seed})"
    return (f"concat_ws('-', substr({h},1,8), substr({h},9,4), substr({h},13,4), substr({h},17,4), "
            f"substr({h},21,12))")


cte("chat_requests", f"""
SELECT concat(conv_id, '-', turn) AS request_id,
       CASE WHEN conv_id % 11 = 0 THEN concat('chat-', conv_id) ELSE {_uuid("concat('c', conv_id)")} END AS chat_uuid,
       {_uuid("concat('m', conv_id, '-', turn)")} AS message_uuid, role,
       CASE WHEN turn % 3 = 0 THEN
         [{{'type': 'text', 'text': text, 'media_type': NULL::VARCHAR, 'name': NULL::VARCHAR, 'url': NULL::VARCHAR}},
          {{'type': 'file', 'text': NULL::VARCHAR,
            'media_type': CASE WHEN turn % 6 = 0 THEN 'image/gif' ELSE 'image/png' END,
            'name': concat('img', turn, '.png'),
            'url': CASE WHEN turn % 9 = 0 THEN 'not a url' ELSE concat('https://img.test/', conv_id, '/', turn) END}}]
       ELSE [{{'type': 'text', 'text': text, 'media_type': NULL::VARCHAR, 'name': NULL::VARCHAR, 'url': NULL::VARCHAR}}]
       END AS parts,
       CASE WHEN (conv_id + turn) % 17 = 0 THEN 'other-model' WHEN turn % 2 = 0 THEN 'chat-model'
            ELSE 'chat-model-reasoning' END AS selected_model,
       CASE WHEN conv_id % 4 = 0 THEN 'public' ELSE 'private' END AS visibility
FROM conversations""")

cte("access_requests", """
SELECT concat(conv_id, '-', turn) AS request_id, conv_id AS chat_id, concat('U', (conv_id + turn) % 20) AS user_id
FROM conversations""")
cte("chats_present", "SELECT * FROM chats WHERE id % 13 <> 0", ("chats",))
cte("delete_requests", "SELECT id AS chat_id FROM chats WHERE id % 7 = 0", ("chats",))
cte("trailing_requests", """
SELECT chat_id, created_at AS cutoff FROM messages WHERE turn = 2 AND chat_id % 3 = 0""", ("messages",))
cte("streams", """
SELECT id AS stream_id, chat_id, created_at AS started_at FROM messages WHERE role = 'assistant'""", ("messages",))
cte("usage", """
SELECT id, chat_id, created_at, cast(turn * 10 + length(text) % 50 AS BIGINT) AS prompt_tokens,
       cast(len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS BIGINT) AS completion_tokens,
       cast(turn * 10 + length(text) % 50 + len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS BIGINT)
         AS total_tokens
FROM messages WHERE role = 'assistant'""", ("messages",))
