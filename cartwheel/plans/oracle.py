"""Independent DuckDB oracle: the same questions asked in plain SQL over the
raw tables (views region nation customer supplier part orders lineitem events
...). Entity adapters are CTEs; the cart fold here follows the sequential
window formulation, not the aggregate one the Spark code uses, so the two
implementations check each other. Money columns are emitted as DOUBLE after
exact DECIMAL arithmetic, matching ``registry.portable``.
"""

from __future__ import annotations

BATCH_TS = "TIMESTAMP '2024-02-01 00:00:00'"
CART_SPLIT_TS = "TIMESTAMP '2024-01-16 00:00:00'"

_CANON_ORDER = ("CASE lower(trim({c})) WHEN 'pending' THEN 'Pending' WHEN 'processing' THEN 'Processing' "
                "WHEN 'shipped' THEN 'Shipped' WHEN 'cancelled' THEN 'Cancelled' ELSE {c} END")
_CANON_APPROVAL = ("CASE lower(trim({c})) WHEN 'pending' THEN 'Pending' WHEN 'approved' THEN 'Approved' "
                   "WHEN 'rejected' THEN 'Rejected' ELSE {c} END")


def canon_order(c):
    return _CANON_ORDER.format(c=c)


def canon_approval(c):
    return _CANON_APPROVAL.format(c=c)


_EMAIL = "lower(replace({n}, '#', '')) || '@example.com'"

# Sequential cart semantics, step by step (clear, delete, first add, last set).
CART = """
        WITH ev AS (
            SELECT *, row_number() OVER (ORDER BY ts, event_id) AS seq FROM {events}
            WHERE op = 'clear' OR (product_id IS NOT NULL AND op IN ('add', 'set', 'remove'))),
        clr AS (SELECT user_id, max(seq) AS clear_seq FROM ev WHERE op = 'clear' GROUP BY user_id),
        e1 AS (SELECT ev.* FROM ev LEFT JOIN clr ON clr.user_id = ev.user_id
               WHERE ev.op <> 'clear' AND (clr.clear_seq IS NULL OR ev.seq > clr.clear_seq)),
        del AS (SELECT user_id, product_id, max(seq) AS del_seq FROM e1
                WHERE op = 'remove' OR (op = 'set' AND coalesce(value, 0) <= 0) GROUP BY user_id, product_id),
        e2 AS (SELECT e1.* FROM e1 LEFT JOIN del ON del.user_id = e1.user_id AND del.product_id = e1.product_id
               WHERE del.del_seq IS NULL OR e1.seq > del.del_seq),
        fa AS (SELECT user_id, product_id, min(seq) AS first_add FROM e2 WHERE op = 'add'
               GROUP BY user_id, product_id),
        e3 AS (SELECT e2.* FROM e2 JOIN fa ON fa.user_id = e2.user_id AND fa.product_id = e2.product_id
               WHERE e2.seq >= fa.first_add),
        ls AS (SELECT user_id, product_id, max(seq) AS set_seq FROM e3 WHERE op = 'set'
               GROUP BY user_id, product_id)
        SELECT row_number() OVER (ORDER BY e3.user_id, e3.product_id) AS cart_id, e3.user_id, e3.product_id,
               CAST(sum(CASE WHEN e3.op = 'set' AND e3.seq = ls.set_seq THEN e3.value
                             WHEN e3.op = 'add' AND (ls.set_seq IS NULL OR e3.seq > ls.set_seq) THEN e3.value
                             ELSE 0 END) AS INTEGER) AS quantity,
               min(e3.ts) FILTER (WHERE e3.op = 'add') AS added_at
        FROM e3 LEFT JOIN ls ON ls.user_id = e3.user_id AND ls.product_id = e3.product_id
        GROUP BY e3.user_id, e3.product_id"""

# name -> (sql, dependencies)
CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "e_users": (f"""
        SELECT c.c_custkey AS user_id, c.c_name AS name, {_EMAIL.format(n='c.c_name')} AS email,
               n.n_name AS address, lpad(CAST(c.c_custkey AS VARCHAR), 10, '0') AS phone,
               CAST(NULL AS TIMESTAMP) AS created_at
        FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey""", ()),
    "e_sellers": (f"""
        SELECT s_suppkey AS seller_id, s_name AS name, {_EMAIL.format(n='s_name')} AS email,
               lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS phone, CAST(NULL AS TIMESTAMP) AS created_at
        FROM supplier""", ()),
    "e_products": ("""
        SELECT p.p_partkey AS product_id, p.p_name AS name,
               concat_ws(' ', p.p_brand, p.p_type, p.p_name) AS description,
               CAST(p.p_retailprice AS DECIMAL(10,2)) AS price, p.p_size AS stock, p.p_type AS category,
               '' AS image_url, CAST(NULL AS TIMESTAMP) AS created_at, o.seller_id
        FROM part p LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS seller_id FROM lineitem GROUP BY l_partkey) o
          ON o.l_partkey = p.p_partkey""", ()),
    "e_orders": ("""
        SELECT o.o_orderkey AS order_id, o.o_custkey AS user_id,
               CAST(o.o_totalprice AS DECIMAL(10,2)) AS total_amount,
               CASE o.o_orderstatus WHEN 'F' THEN 'Shipped' WHEN 'O' THEN 'Pending' WHEN 'P' THEN 'Processing' END
                 AS order_status,
               o.o_orderdate AS created_at,
               CASE o.o_orderpriority WHEN '1-URGENT' THEN 'approved' WHEN '5-LOW' THEN 'Rejected'
                    WHEN '2-HIGH' THEN 'Pending' ELSE 'pending' END AS seller_approval_status,
               CASE WHEN o.o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE l.seller_id END AS seller_id
        FROM orders o LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS seller_id FROM lineitem GROUP BY l_orderkey) l
          ON l.l_orderkey = o.o_orderkey""", ()),
    "e_items": ("""
        SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                                  l_shipdate) AS item_id,
               l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
               CAST(l_extendedprice AS DECIMAL(10,2)) AS subtotal
        FROM lineitem""", ()),
    "e_listed": ("""
        SELECT * REPLACE (CASE WHEN product_id % 5 = 1 THEN 0 ELSE stock END AS stock) FROM e_products
        WHERE product_id % 10 <> 4""", ("e_products",)),
    "e_payments": ("""
        SELECT o_orderkey * 2 AS payment_id, o_orderkey AS order_id, o_custkey AS user_id,
               CAST(o_totalprice AS DECIMAL(10,2)) AS amount,
               CASE WHEN o_orderstatus = 'F' THEN 'Completed' ELSE 'Pending' END AS payment_status,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'Credit Card' WHEN '2-HIGH' THEN 'Debit Card'
                    WHEN '3-MEDIUM' THEN 'PayPal' WHEN '4-NOT SPECIFIED' THEN 'Pay on Delivery'
                    ELSE 'Not Specified' END AS payment_method,
               o_orderdate AS created_at
        FROM orders WHERE o_orderkey % 10 <> 0
        UNION ALL
        SELECT o_orderkey * 2 + 1, o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(10,2)),
               'Completed', 'Credit Card', o_orderdate + INTERVAL 1 DAY
        FROM orders WHERE o_orderkey % 25 = 1""", ()),
    "e_events": ("""
        SELECT event_id, ts, user_id, event_type,
               CASE WHEN event_id % 89 = 0 THEN value * 1e12 ELSE value END AS value,
               CASE WHEN event_id % 97 = 0 THEN '{"k": "x' || event_id || '"}' ELSE props END AS props
        FROM events""", ()),
    "e_cart_all": ("""
        SELECT event_id, ts, user_id, event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id,
               CASE event_type WHEN 'click' THEN 'add' WHEN 'view' THEN 'set' WHEN 'error' THEN 'remove'
                    WHEN 'purchase' THEN 'clear' END AS op,
               CASE event_type WHEN 'click' THEN 1
                    WHEN 'view' THEN CASE WHEN abs(value) < 2147483647 THEN CAST(floor(value) AS INTEGER) END END AS value,
               event_type = 'view' AND value IS NOT NULL AND NOT abs(value) < 2147483647 AS bad_quantity
        FROM e_events WHERE event_type IN ('click', 'view', 'error', 'purchase')""", ("e_events",)),
    "e_cart_events": ("""
        SELECT event_id, ts, user_id, product_id, op, value FROM e_cart_all
        WHERE NOT bad_quantity OR product_id IS NULL""", ("e_cart_all",)),
    "e_cart": (CART.format(events="e_cart_events"), ("e_cart_events",)),
    "e_cart_events_1": (f"SELECT * FROM e_cart_events WHERE ts < {CART_SPLIT_TS}", ("e_cart_events",)),
    "e_cart_1": (CART.format(events="e_cart_events_1"), ("e_cart_events_1",)),
    "e_status_events": ("""
        SELECT event_id, ts, CAST(floor(event_id / 3) AS BIGINT) AS order_id,
               CASE WHEN event_type = 'purchase' THEN 'payment' ELSE 'approval' END AS kind,
               CASE event_type WHEN 'purchase' THEN 'Completed' WHEN 'click' THEN 'Approved'
                    ELSE 'Rejected' END AS value
        FROM events WHERE event_type IN ('purchase', 'click', 'error')""", ()),
    "e_requests": ("""
        WITH r AS (
            SELECT c_custkey * 2 AS request_id, c_custkey AS user_id,
                   CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Credit Card' WHEN 'BUILDING' THEN 'Debit Card'
                        WHEN 'FURNITURE' THEN 'PayPal' WHEN 'HOUSEHOLD' THEN 'Pay on Delivery' END AS payment_method
            FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD'))
        SELECT * FROM r UNION ALL SELECT request_id + 1, user_id, 'Credit Card' FROM r WHERE user_id % 14 = 0""", ()),
    "e_known_users": ("SELECT * FROM e_users WHERE user_id % 10 <> 3", ("e_users",)),
    "e_registrations": (f"""
        SELECT c_custkey * 3 AS request_id, c_name AS name, upper({_EMAIL.format(n='c_name')}) AS email,
               'Nation ' || CAST(c_nationkey AS VARCHAR) AS address,
               lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS phone
        FROM customer WHERE c_custkey % 7 = 0
        UNION ALL
        SELECT c_custkey * 3 + 1000000000000, c_name, NULL, 'Nation ' || CAST(c_nationkey AS VARCHAR),
               lpad(CAST(c_custkey AS VARCHAR), 10, '0')
        FROM customer WHERE c_custkey % 21 = 0
        UNION ALL
        SELECT c_custkey * 3 + 1, c_name, replace({_EMAIL.format(n='c_name')}, '@', '+new@'),
               'Nation ' || CAST(c_nationkey AS VARCHAR), lpad(CAST(c_custkey AS VARCHAR), 10, '0')
        FROM customer WHERE c_custkey % 7 = 0
        UNION ALL
        SELECT c_custkey * 3 + 2, c_name, upper(replace({_EMAIL.format(n='c_name')}, '@', '+new@')),
               'Nation ' || CAST(c_nationkey AS VARCHAR), lpad(CAST(c_custkey AS VARCHAR), 10, '0')
        FROM customer WHERE c_custkey % 14 = 0""", ()),
    "e_product_changes": ("""
        WITH base AS (
            SELECT pt.p_partkey AS k, pt.p_name, pt.p_type, pr.description, pr.price,
                   coalesce(pr.seller_id, 0) AS owner
            FROM part pt JOIN e_products pr ON pr.product_id = pt.p_partkey),
        top AS (SELECT max(p_partkey) AS m FROM part)
        SELECT k * 3 AS change_id, 'edit' AS op, k AS product_id,
               CASE WHEN k % 2 = 0 THEN owner ELSE owner + 1 END AS seller_id,
               p_name || ' v2' AS name, description, CAST(price + 1 AS DECIMAL(10,2)) AS price,
               CAST(NULL AS VARCHAR) AS category, '' AS image_url
        FROM base WHERE k % 11 = 0 AND k % 13 <> 0
        UNION ALL
        SELECT k * 3 + 1, 'delete', k, CASE WHEN k % 2 = 0 THEN owner ELSE owner + 1 END,
               NULL, NULL, NULL, NULL, NULL
        FROM base WHERE k % 13 = 0
        UNION ALL
        SELECT k * 3 + 2, 'add', k + (SELECT m FROM top) + 1, owner, 'new ' || p_name, description, price,
               CASE WHEN k % 2 = 0 THEN p_type END, ''
        FROM base WHERE k % 17 = 0
        UNION ALL
        SELECT k * 3 + 1000000000000, 'add', NULL, owner, 'keyless ' || p_name, description, price, p_type, ''
        FROM base WHERE k % 34 = 0
        UNION ALL
        SELECT k * 3 + 1000000000001, 'add', k + (SELECT m FROM top) + 1, owner, 'again ' || p_name, description, price, p_type, ''
        FROM base WHERE k % 51 = 0
        UNION ALL
        SELECT k * 3 + 1000000000002, 'EDIT', k, CASE WHEN k % 2 = 0 THEN owner ELSE owner + 1 END, NULL, NULL, NULL, NULL, NULL
        FROM base WHERE k % 19 = 0""", ("e_products",)),
    # What becomes of every change, one condition after the other.
    "e_outcomes": ("""
        WITH owned AS (
            SELECT c.*, p.product_id IS NOT NULL AS present,
                   coalesce(c.op IN ('edit', 'delete') AND p.seller_id = c.seller_id, FALSE) AS may
            FROM e_product_changes c LEFT JOIN e_products p ON p.product_id = c.product_id),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY product_id, may ORDER BY (op = 'delete') DESC, change_id DESC) AS late,
                   row_number() OVER (PARTITION BY product_id, op = 'add' AND category IS NOT NULL ORDER BY change_id) AS early
            FROM owned)
        SELECT change_id, op, product_id, seller_id, name, description, price, category, image_url,
               CASE WHEN op = 'add' AND category IS NULL THEN 'missing_category'
                    WHEN op = 'add' AND product_id IS NOT NULL AND (present OR early > 1) THEN 'duplicate_key'
                    WHEN op = 'add' THEN 'applied'
                    WHEN op NOT IN ('edit', 'delete') THEN 'unknown_op'
                    WHEN NOT may THEN 'not_owner_or_missing'
                    WHEN late > 1 THEN 'superseded' ELSE 'applied' END AS outcome
        FROM ranked""", ("e_product_changes", "e_products")),
    "e_pm_changes": ("""
        SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 14 = 0 THEN 'Credit Card' ELSE 'PayPal' END AS payment_method
        FROM orders WHERE o_orderstatus = 'O'""", ()),
    "e_terms": ("""
        SELECT * FROM (VALUES (''), ('widget'), ('WIDGET'), ('r_d'), ('brand#1'), ('zzz')) t(term)""", ()),
    "e_latest_pay": ("""
        SELECT * FROM (
            SELECT p.*, row_number() OVER (PARTITION BY order_id
                                           ORDER BY created_at DESC NULLS LAST, payment_id DESC) AS rn
            FROM e_payments p) WHERE rn = 1""", ("e_payments",)),
    "e_priced": ("""
        SELECT c.user_id, c.product_id, c.quantity, p.price, p.seller_id,
               CAST(p.price * c.quantity AS DECIMAL(18,2)) AS line_subtotal
        FROM e_cart c JOIN e_products p ON p.product_id = c.product_id
        WHERE c.user_id IN (SELECT user_id FROM e_requests) AND c.user_id IN (SELECT user_id FROM e_known_users)""",
                 ("e_cart", "e_products", "e_requests", "e_known_users")),
    "e_new_orders": (f"""
        SELECT CAST((SELECT coalesce(max(order_id), 0) FROM e_orders)
                    + row_number() OVER (ORDER BY user_id) AS BIGINT) AS order_id,
               user_id, subtotal, CAST(round(subtotal * 1.1, 2) AS DECIMAL(18,2)) AS total_amount,
               'Processing' AS order_status, {BATCH_TS} AS created_at,
               'Pending' AS seller_approval_status, seller_id
        FROM (SELECT user_id, CAST(sum(line_subtotal) AS DECIMAL(18,2)) AS subtotal,
                     min(seller_id) AS seller_id
              FROM e_priced GROUP BY user_id) b""", ("e_priced", "e_orders")),
    "e_status_effects": (f"""
        SELECT event_id, ts, order_id,
               CASE WHEN kind = 'payment' AND lower(value) = 'completed' THEN 'Processing'
                    WHEN kind = 'approval' AND lower(value) = 'approved' THEN 'Processing'
                    WHEN kind = 'approval' AND lower(value) = 'rejected' THEN 'Cancelled' END AS new_status,
               CASE WHEN kind = 'approval' THEN {canon_approval('value')} END AS new_approval
        FROM e_status_events""", ("e_status_events",)),
}


def with_ctes(body: str, *needs: str) -> str:
    order: list[str] = []

    def visit(n):
        for d in CTES[n][1]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return body.strip()
    parts = ",\n".join(f"{n} AS ({CTES[n][0]}\n)" for n in order)
    body = body.strip()
    if body[:4].upper() == "WITH":          # merge the body's own CTE list
        return f"WITH {parts},\n{body[4:].lstrip()}"
    return f"WITH {parts}\n{body}"


def _d(c, alias=None):
    return f"CAST({c} AS DOUBLE) AS {alias or c.split('.')[-1]}"


PRODUCT_COLS = (f"product_id, name, description, {_d('price')}, stock, category, image_url, created_at, seller_id")
ORDER_COLS = (f"o.order_id, o.user_id, {_d('o.total_amount')}, o.order_status, o.created_at, "
              "o.seller_approval_status, o.seller_id")
MONEY_TEXT = "'₹' || CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)"
ORDER_STATUS_LATEST = with_ctes(f"""
    WITH eff AS (SELECT * FROM e_status_effects WHERE new_status IS NOT NULL),
    ls AS (SELECT order_id, new_status, event_id AS status_event_id FROM (
             SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY ts DESC, event_id DESC) AS rn FROM eff)
           WHERE rn = 1),
    la AS (SELECT order_id, new_approval FROM (
             SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY ts DESC, event_id DESC) AS rn
             FROM eff WHERE new_approval IS NOT NULL) WHERE rn = 1)
    SELECT o.order_id, o.user_id, {_d('o.total_amount')}, o.created_at, o.seller_id,
           {canon_order('coalesce(ls.new_status, o.order_status)')} AS order_status,
           {canon_approval('coalesce(la.new_approval, o.seller_approval_status)')} AS seller_approval_status,
           ls.status_event_id
    FROM e_orders o LEFT JOIN ls ON ls.order_id = o.order_id LEFT JOIN la ON la.order_id = o.order_id
""", "e_orders", "e_status_effects")

CART_FOLD = with_ctes("SELECT cart_id, user_id, product_id, quantity, added_at FROM e_cart", "e_cart")


# The shop's constraints, written down here once more from its DDL: table ->
# (key, NOT NULL columns, VARCHAR lengths, DECIMAL(10,2) columns, references).
DDL = {
    "users": ("user_id", ["name", "email", "address", "phone"], {"name": 100, "email": 100, "phone": 20}, [], {}),
    "sellers": ("seller_id", ["name", "email", "phone"], {"name": 100, "email": 100, "phone": 20}, [], {}),
    "products": ("product_id", ["name", "description", "price", "stock", "category", "image_url"],
                 {"name": 200, "category": 50, "image_url": 255}, ["price"], {"seller_id": ("products_seller", "sellers")}),
    "cart": ("cart_id", ["user_id", "product_id", "quantity"], {}, [],
             {"user_id": ("cart_user", "users"), "product_id": ("cart_product", "products")}),
    "orders": ("order_id", ["user_id", "total_amount", "order_status"], {"order_status": 20, "seller_approval_status": 20},
               ["total_amount"], {"user_id": ("orders_user", "users"), "seller_id": ("orders_seller", "sellers")}),
    "order_items": ("item_id", ["order_id", "product_id", "quantity", "subtotal"], {}, ["subtotal"],
                    {"order_id": ("order_items_order", "orders"), "product_id": ("order_items_product", "products")}),
    "payments": ("payment_id", ["order_id", "user_id", "amount", "payment_status", "payment_method"],
                 {"payment_status": 20, "payment_method": 50}, ["amount"],
                 {"order_id": ("payments_order", "orders"), "user_id": ("payments_user", "users")}),
}
_CLEAN = {"users": "e_users", "sellers": "e_sellers", "products": "e_products", "cart": "e_cart",
          "orders": "e_orders", "order_items": "e_items", "payments": "e_payments"}
_ALL = tuple(_CLEAN.values())


def _incoming(table: str) -> str:
    """The table with its bad copies (see sources/incoming.py)."""
    key, required, text, money, refs = DDL[table]
    src = _CLEAN[table]
    as_double = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in money)
    wide = f"SELECT * REPLACE ({as_double}) FROM {src}" if money else f"SELECT * FROM {src}"

    def copy(residue, changes):
        moved = [f"{key} + {residue} * 1000000000000 AS {key}"] + [f"{v} AS {c}" for c, v in changes.items()]
        return f"SELECT * REPLACE ({', '.join(moved)}) FROM w WHERE {key} % 50 = {residue}"

    parts = ["SELECT * FROM w", f"SELECT * FROM w WHERE {key} % 50 = 8", copy(12, {c: "NULL" for c in required}),
             f"SELECT * REPLACE (NULL AS {key}) FROM w WHERE {key} % 50 = 14", copy(22, {c: "-1" for c in refs})]
    if text:
        parts.append(copy(16, {c: f"repeat('x', {n + 1})" for c, n in text.items()}))
    if money:
        parts.append(copy(18, {c: "1e9" for c in money}))
    if table == "products":
        parts.append(copy(32, {"price": "-1.0", "name": "'  '", "description": "''", "image_url": "'https://example.com/x.jpg'"}))
    if table in ("cart", "order_items"):
        parts += [copy(32, {"quantity": "0"}), copy(34, {"quantity": "1000000"})]
    return f"WITH w AS ({wide}) " + " UNION ALL ".join(parts)


for _t, _src in _CLEAN.items():
    CTES[f"i_{_t}"] = (_incoming(_t), (_src,))
_INCOMING = tuple(f"i_{t}" for t in DDL)


_UNIQUE = [(f"{t}_pk", t, [d[0]]) for t, d in DDL.items()] + [
    ("users_email", "users", ["lower(trim(email))"]), ("sellers_email", "sellers", ["lower(trim(email))"]),
    ("cart_user_product", "cart", ["user_id", "product_id"])]


def _earlier(table: str) -> str:
    """Is the row of an earlier batch than the last of four?"""
    return f"((coalesce({DDL[table][0]}, -1) % 4) + 4) % 4 < 3"


def _dq_unique_batch() -> str:
    """All batches' surplus less that of the batches before the last."""
    parts = []
    for name, table, keys in _UNIQUE:
        def total(what, condition):
            return (f"(SELECT coalesce({what}, 0) FROM (SELECT count(*) AS n FROM i_{table} WHERE {' AND '.join(f'{k} IS NOT NULL' for k in keys)} "
                    f"AND {condition} GROUP BY {', '.join(keys)} HAVING count(*) > 1) d)")
        difference = [f"CAST({total(w, 'true')} - {total(w, _earlier(table))} AS BIGINT)" for w in ("count(*)", "sum(n - 1)")]
        parts.append(f"SELECT '{name}' AS rule, '{table}' AS table_name, {difference[0]} AS duplicate_keys, {difference[1]} AS excess_rows")
    return with_ctes(" UNION ALL ".join(parts), *_INCOMING)


def _dq_fk_batch() -> str:
    parts = []
    for child, (*_, refs) in DDL.items():
        for col, (name, parent) in refs.items():
            def total(extra, children, parents):
                return (f"(SELECT count(*) FROM i_{child} c WHERE c.{col} IS NOT NULL AND {children} {extra.format(parents=parents)})")
            orphan = f"AND c.{col} NOT IN (SELECT {DDL[parent][0]} FROM i_{parent} WHERE {DDL[parent][0]} IS NOT NULL AND {{parents}})"
            rows = [f"CAST({total(x, 'true', 'true')} - {total(x, _earlier(child), _earlier(parent))} AS BIGINT)" for x in ("", orphan)]
            parts.append(f"SELECT '{name}' AS rule, '{child}' AS table_name, {rows[0]} AS child_rows, {rows[1]} AS orphan_rows")
    return with_ctes(" UNION ALL ".join(parts), *_INCOMING)


def _dq_unique() -> str:
    parts = []
    for name, table, keys in _UNIQUE:
        parts.append(f"""
        SELECT '{name}' AS rule, '{table}' AS table_name, CAST(count(*) AS BIGINT) AS duplicate_keys,
               CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS excess_rows
        FROM (SELECT count(*) AS n FROM i_{table} WHERE {' AND '.join(f'{k} IS NOT NULL' for k in keys)}
              GROUP BY {', '.join(keys)} HAVING count(*) > 1) d""")
    return with_ctes(" UNION ALL ".join(parts), *_INCOMING)


def _dq_fk() -> str:
    parts = []
    for child, (*_, refs) in DDL.items():
        for col, (name, parent) in refs.items():
            parts.append(f"""
        SELECT '{name}' AS rule, '{child}' AS table_name, CAST(count(*) AS BIGINT) AS child_rows,
               CAST(count(*) FILTER (WHERE p.k IS NULL) AS BIGINT) AS orphan_rows
        FROM i_{child} c LEFT JOIN (SELECT DISTINCT {DDL[parent][0]} AS k FROM i_{parent}) p ON p.k = c.{col}
        WHERE c.{col} IS NOT NULL""")
    return with_ctes(" UNION ALL ".join(parts), *_INCOMING)


def _dq_not_null() -> str:
    return with_ctes(" UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS null_rows "
        f"FROM i_{t}" for t, (key, required, *_) in DDL.items() for c in (key, *required)), *_INCOMING)


def _dq_domain() -> str:
    parts = []
    for table, (_, _, text, money, _) in DDL.items():
        rules = [(f"{c}_longer_than_{n}", f"length({c}) > {n}") for c, n in text.items()]
        rules += [(f"{c}_out_of_decimal_10_2", f"abs({c}) >= 100000000") for c in money]
        if table == "products":
            rules += [("price_negative", "price < 0"), ("name_empty", "length(trim(name)) = 0"),
                      ("description_empty", "length(trim(description)) = 0"),
                      ("image_url_not_url", "NOT regexp_matches(lower(image_url), '^https?://')")]
        if table in ("cart", "order_items"):
            rules.append(("quantity_below_1", "quantity < 1"))
        for rule, cond in rules:
            parts.append(f"SELECT '{table}' AS table_name, '{rule}' AS rule, "
                         f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT) AS violations FROM i_{table}")
    parts.append("SELECT 'cart' AS table_name, 'quantity_above_stock' AS rule, "
                 "CAST(count(*) FILTER (WHERE c.quantity > p.stock) AS BIGINT) AS violations FROM i_cart c "
                 "JOIN (SELECT product_id, max(stock) AS stock FROM i_products GROUP BY product_id) p ON p.product_id = c.product_id")
    return with_ctes(" UNION ALL ".join(parts), *_INCOMING)


REGISTRATIONS = with_ctes("""
        WITH r AS (SELECT *, lower(trim(email)) AS email_key FROM e_registrations),
        f AS (SELECT email_key, min(request_id) AS first_id FROM r GROUP BY email_key),
        k AS (SELECT DISTINCT lower(trim(email)) AS email_key FROM e_users),
        j AS (SELECT r.*, CASE WHEN r.email_key IS NULL THEN 'missing_email'
                               WHEN k.email_key IS NOT NULL THEN 'duplicate_existing'
                               WHEN r.request_id = f.first_id THEN 'accepted' ELSE 'duplicate_in_batch' END AS status
              FROM r LEFT JOIN f ON f.email_key = r.email_key LEFT JOIN k ON k.email_key = r.email_key),
        t AS (SELECT *, CAST(CASE WHEN status = 'accepted' THEN (SELECT max(user_id) FROM e_users)
                    + row_number() OVER (PARTITION BY status = 'accepted' ORDER BY request_id) END AS BIGINT) AS user_id
              FROM j)
        {rest}""", "e_registrations", "e_users")

LIKE = "lower({t}) LIKE '%' || replace(lower(e_terms.term), '\\', '\\\\') || '%' ESCAPE '\\'"

SQL: dict[str, str] = {
    "products_all": with_ctes(f"SELECT {PRODUCT_COLS} FROM e_products", "e_products"),
    "table_counts": with_ctes(" UNION ALL ".join(
        f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS row_count FROM {src}"
        for t, src in (("users", "e_users"), ("sellers", "e_sellers"), ("products", "e_products"),
                       ("cart", "e_cart"), ("orders", "e_orders"), ("order_items", "e_items"),
                       ("payments", "e_payments"))), *_ALL),
    "product_lookup": with_ctes("""
        SELECT c.change_id, c.product_id, c.seller_id,
               CASE WHEN p.product_id IS NULL THEN 'missing' ELSE 'found' END AS lookup,
               CASE WHEN p.seller_id IS NOT NULL AND p.seller_id = c.seller_id THEN 'yes' ELSE 'no' END
                 AS owned_by_sender
        FROM e_product_changes c LEFT JOIN e_products p ON p.product_id = c.product_id""",
                                "e_product_changes", "e_products"),
    "product_search": with_ctes(f"""
        SELECT e_terms.term, p.product_id FROM e_products p JOIN e_terms
          ON ({LIKE.format(t='p.name')}) OR ({LIKE.format(t='p.description')})""", "e_products", "e_terms"),
    "featured_products": with_ctes(f"SELECT {PRODUCT_COLS} FROM e_products ORDER BY product_id LIMIT 4",
                                   "e_products"),
    "product_cards": with_ctes(f"""
        SELECT product_id, name, 'PRD' || CAST(product_id AS VARCHAR) AS sku,
               {MONEY_TEXT.format(c='price')} AS price_text,
               substring(description, 1, 80) || '...' AS excerpt,
               CASE WHEN stock > 0 THEN 'in_stock' ELSE 'out_of_stock' END AS stock_badge
        FROM e_products""", "e_products"),
    "cart_state_fold": CART_FOLD,
    "cart_lines": with_ctes(f"""
        SELECT c.user_id, c.product_id, c.quantity, p.name, {_d('p.price')}, p.image_url, p.stock,
               CAST(CAST(p.price * c.quantity AS DECIMAL(18,2)) AS DOUBLE) AS line_subtotal,
               c.quantity > p.stock AS cart_exceeds_stock
        FROM e_cart c JOIN e_products p ON p.product_id = c.product_id""", "e_cart", "e_products"),
    "cart_totals": with_ctes("""
        SELECT user_id, n_lines, n_units, CAST(subtotal AS DOUBLE) AS subtotal,
               CAST(round(subtotal * 0.1, 2) AS DOUBLE) AS tax, CAST(round(subtotal * 1.1, 2) AS DOUBLE) AS total
        FROM (SELECT c.user_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(c.quantity) AS BIGINT) AS n_units,
                     CAST(sum(CAST(p.price * c.quantity AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS subtotal
              FROM e_cart c JOIN e_products p ON p.product_id = c.product_id GROUP BY c.user_id) t""",
                              "e_cart", "e_products"),
    # Applying the later events to the stored state equals replaying them all; a
    # line that no later event deletes keeps its row, the others get new ids.
    "cart_upsert": with_ctes(f"""
        WITH cut AS (SELECT DISTINCT user_id, product_id FROM e_cart_events
                     WHERE ts >= {CART_SPLIT_TS} AND (op = 'remove' OR (op = 'set' AND coalesce(value, 0) <= 0))),
        cleared AS (SELECT DISTINCT user_id FROM e_cart_events WHERE ts >= {CART_SPLIT_TS} AND op = 'clear'),
        kept AS (SELECT * FROM e_cart_1 AS s
                 WHERE NOT EXISTS (SELECT 1 FROM cut WHERE cut.user_id = s.user_id AND cut.product_id = s.product_id)
                   AND NOT EXISTS (SELECT 1 FROM cleared WHERE cleared.user_id = s.user_id))
        SELECT coalesce(k.cart_id, (SELECT max(cart_id) FROM e_cart_1) + row_number() OVER (
                 PARTITION BY k.cart_id IS NULL ORDER BY e.user_id, e.product_id))::BIGINT AS cart_id,
               e.user_id, e.product_id, e.quantity,
               CASE WHEN k.cart_id IS NULL THEN e.added_at ELSE k.added_at END AS added_at
        FROM e_cart e LEFT JOIN kept k ON k.user_id = e.user_id AND k.product_id = e.product_id""",
                             "e_cart", "e_cart_1"),
    "cart_stock_check": with_ctes("""
        SELECT e.event_id, e.user_id, e.product_id, e.value AS requested, p.stock,
               CASE WHEN e.product_id IS NULL OR e.value IS NULL THEN 'bad_request'
                    WHEN p.stock IS NULL THEN 'not_found'
                    WHEN p.stock < e.value THEN 'not_enough_stock' ELSE 'ok' END AS check_status,
               coalesce(c.quantity > p.stock, false) AS cart_exceeds_stock
        FROM e_cart_events e LEFT JOIN e_listed p ON p.product_id = e.product_id
        LEFT JOIN e_cart c ON c.user_id = e.user_id AND c.product_id = e.product_id
        WHERE e.op = 'add'""", "e_cart_events", "e_listed", "e_cart"),
    "cart_cascade": with_ctes("""
        SELECT c.user_id, c.product_id, c.quantity FROM e_cart c
        WHERE EXISTS (SELECT 1 FROM e_known_users u WHERE u.user_id = c.user_id)
          AND EXISTS (SELECT 1 FROM e_listed p WHERE p.product_id = c.product_id)""",
                               "e_cart", "e_known_users", "e_listed"),
    "cart_event_rejects": with_ctes("""
        SELECT event_id, user_id, event_type,
               CASE WHEN op <> 'clear' AND product_id IS NULL THEN 'bad_product_id' ELSE 'bad_quantity' END AS reason
        FROM e_cart_all WHERE (op <> 'clear' AND product_id IS NULL) OR bad_quantity""", "e_cart_all"),
    "checkout_orders": with_ctes(f"SELECT {ORDER_COLS} FROM e_new_orders o", "e_new_orders"),
    "checkout_lines": with_ctes("""
        SELECT (SELECT max(item_id) FROM e_items) + row_number() OVER (ORDER BY o.order_id, p.product_id) AS item_id,
               o.order_id, p.user_id, p.product_id, p.quantity, CAST(p.line_subtotal AS DOUBLE) AS subtotal
        FROM e_priced p JOIN e_new_orders o ON o.user_id = p.user_id""", "e_priced", "e_new_orders", "e_items"),
    "payments_autocreate": with_ctes(f"""
        SELECT CAST((SELECT coalesce(max(payment_id), 0) FROM e_payments)
                    + row_number() OVER (ORDER BY order_id) AS BIGINT) AS payment_id,
               order_id, user_id, CAST(total_amount AS DOUBLE) AS amount, 'Pending' AS payment_status,
               'Not Specified' AS payment_method, {BATCH_TS} AS created_at
        FROM e_new_orders""", "e_new_orders", "e_payments"),
    "checkout_payments": with_ctes(f"""
        SELECT CAST((SELECT coalesce(max(payment_id), 0) FROM e_payments)
                    + row_number() OVER (ORDER BY o.order_id) AS BIGINT) AS payment_id,
               o.order_id, o.user_id, CAST(o.total_amount AS DOUBLE) AS amount, 'Pending' AS payment_status,
               coalesce(r.payment_method, 'Not Specified') AS payment_method, {BATCH_TS} AS created_at
        FROM e_new_orders o
        LEFT JOIN (SELECT user_id, arg_max(payment_method, request_id) AS payment_method FROM e_requests GROUP BY user_id) r
          ON r.user_id = o.user_id""", "e_new_orders", "e_payments", "e_requests"),
    "stock_after_checkout": with_ctes("""
        SELECT p.product_id, CAST(p.stock - coalesce(q.ordered, 0) AS INTEGER) AS stock
        FROM e_products p
        LEFT JOIN (SELECT product_id, sum(quantity) AS ordered FROM e_priced GROUP BY product_id) q
          ON q.product_id = p.product_id""", "e_products", "e_priced"),
    "checkout_cart_after": with_ctes("""
        SELECT c.user_id, c.product_id, c.quantity FROM e_cart c
        WHERE NOT EXISTS (SELECT 1 FROM e_new_orders o WHERE o.user_id = c.user_id)""",
                                      "e_cart", "e_new_orders"),
    "order_payment_raw": with_ctes(f"""
        SELECT o.order_id, o.user_id, o.created_at, {_d('o.total_amount')}, o.order_status,
               p.payment_id, p.payment_status, p.payment_method
        FROM e_orders o LEFT JOIN e_payments p ON p.order_id = o.order_id""", "e_orders", "e_payments"),
    "order_payment": with_ctes(f"""
        SELECT o.order_id, o.user_id, o.created_at, {_d('o.total_amount')}, o.order_status,
               p.payment_id, p.payment_status, p.payment_method
        FROM e_orders o LEFT JOIN e_latest_pay p ON p.order_id = o.order_id""", "e_orders", "e_latest_pay"),
    "order_history": with_ctes(f"""
        SELECT o.order_id, o.user_id, o.created_at, {_d('o.total_amount')}, o.order_status,
               coalesce(p.payment_status, 'Pending') AS payment_status,
               coalesce(p.payment_method, 'Not Specified') AS payment_method,
               strftime(o.created_at, '%B %d, %Y %I:%M %p') AS placed_text,
               strftime(o.created_at + INTERVAL 3 DAY, '%B %d, %Y') AS delivery_text
        FROM e_orders o LEFT JOIN e_latest_pay p ON p.order_id = o.order_id
        ORDER BY o.created_at DESC, o.order_id DESC""", "e_orders", "e_latest_pay"),
    "order_items_detail": with_ctes(f"""
        SELECT i.order_id, i.product_id, i.quantity, {_d('i.subtotal')}, p.name, {_d('p.price')}, p.image_url
        FROM e_items i JOIN e_products p ON p.product_id = i.product_id""", "e_items", "e_products"),
    "order_history_nested": with_ctes("""
        SELECT o.order_id, o.user_id, CAST(count(l.product_id) AS BIGINT) AS n_items,
               coalesce(string_agg(concat_ws('|', CAST(l.product_id AS VARCHAR), CAST(l.quantity AS VARCHAR),
                                             CAST(l.subtotal AS VARCHAR), l.name, CAST(l.price AS VARCHAR)),
                                   '; ' ORDER BY l.product_id, l.quantity, l.subtotal, l.name, l.price), '')
                 AS items_text
        FROM e_orders o
        LEFT JOIN (SELECT i.order_id, i.product_id, i.quantity, i.subtotal, p.name, p.price
                   FROM e_items i JOIN e_products p ON p.product_id = i.product_id) l ON l.order_id = o.order_id
        GROUP BY o.order_id, o.user_id""", "e_orders", "e_items", "e_products"),
    "orders_unpaid": with_ctes(f"""
        SELECT {ORDER_COLS} FROM e_orders o
        WHERE NOT EXISTS (SELECT 1 FROM e_payments p WHERE p.order_id = o.order_id)""", "e_orders", "e_payments"),
    "payments_backfill": with_ctes(f"""
        SELECT CAST((SELECT coalesce(max(payment_id), 0) FROM e_payments)
                    + row_number() OVER (ORDER BY o.order_id) AS BIGINT) AS payment_id,
               o.order_id, o.user_id, CAST(o.total_amount AS DOUBLE) AS amount, 'Pending' AS payment_status,
               'Pay on Delivery' AS payment_method, {BATCH_TS} AS created_at
        FROM e_orders o WHERE NOT EXISTS (SELECT 1 FROM e_payments p WHERE p.order_id = o.order_id)""",
                                    "e_orders", "e_payments"),
    "orders_purged": with_ctes(f"""
        SELECT {ORDER_COLS} FROM e_orders o
        WHERE EXISTS (SELECT 1 FROM e_payments p WHERE p.order_id = o.order_id)""", "e_orders", "e_payments"),
    "payment_method_update": with_ctes("""
        SELECT p.payment_id, p.order_id, p.user_id, CAST(p.amount AS DOUBLE) AS amount, p.payment_status,
               coalesce(c.payment_method, p.payment_method) AS payment_method, p.created_at
        FROM e_payments p
        LEFT JOIN e_pm_changes c ON c.order_id = p.order_id""", "e_payments", "e_pm_changes"),
    "orders_after_payment_update": with_ctes(f"""
        SELECT o.order_id, o.user_id, {_d('o.total_amount')},
               CASE WHEN EXISTS (SELECT 1 FROM e_payments p JOIN e_pm_changes c ON c.order_id = p.order_id
                                 WHERE p.order_id = o.order_id AND lower(p.payment_status) = 'completed')
                    THEN 'Processing' ELSE o.order_status END AS order_status,
               o.created_at, o.seller_approval_status, o.seller_id
        FROM e_orders o""", "e_orders", "e_payments", "e_pm_changes"),
    "order_status_latest": ORDER_STATUS_LATEST,
    "seller_decisions": with_ctes(f"""
        WITH d AS (SELECT order_id, value FROM (
                     SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY ts DESC, event_id DESC) AS rn
                     FROM e_status_events
                     WHERE kind = 'approval' AND lower(value) IN ('approved', 'rejected')) WHERE rn = 1)
        SELECT o.order_id, o.user_id, {_d('o.total_amount')}, o.created_at, o.seller_id,
               CASE WHEN d.value IS NULL THEN {canon_approval('o.seller_approval_status')}
                    WHEN lower(d.value) = 'approved' THEN 'Approved' ELSE 'Rejected' END AS seller_approval_status,
               CASE WHEN d.value IS NULL THEN {canon_order('o.order_status')}
                    WHEN lower(d.value) = 'approved' THEN 'Processing' ELSE 'Cancelled' END AS order_status
        FROM e_orders o LEFT JOIN d ON d.order_id = o.order_id""", "e_orders", "e_status_events"),
    "seller_products": with_ctes(f"""
        SELECT seller_id, product_id, name, {_d('price')}, stock, category, created_at,
               substring(description, 1, 100) || '...' AS excerpt, {MONEY_TEXT.format(c='price')} AS price_text
        FROM e_products WHERE seller_id IS NOT NULL
        ORDER BY seller_id, created_at DESC, product_id DESC""", "e_products"),
    "seller_pending_orders": with_ctes(f"""
        WITH pend AS (SELECT * FROM e_orders WHERE lower(trim(seller_approval_status)) = 'pending'),
        pairs AS (SELECT DISTINCT i.order_id, p.seller_id FROM e_items i
                  JOIN e_products p ON p.product_id = i.product_id WHERE p.seller_id IS NOT NULL)
        SELECT pr.seller_id, o.order_id, o.user_id, {_d('o.total_amount')}, o.order_status,
               o.seller_approval_status, o.created_at, u.name AS customer_name,
               strftime(o.created_at, '%Y-%m-%d %H:%M') AS created_text,
               upper(substring(o.order_status, 1, 1)) || lower(substring(o.order_status, 2)) AS status_title,
               CASE WHEN lower(o.seller_approval_status) = 'approved' THEN 'success' ELSE 'warning' END
                 AS approval_badge
        FROM pairs pr JOIN pend o ON o.order_id = pr.order_id JOIN e_users u ON u.user_id = o.user_id""",
                                        "e_orders", "e_items", "e_products", "e_users"),
    "seller_dashboard_view": with_ctes(f"""
        SELECT o.order_id, o.seller_id, o.created_at, {_d('o.total_amount')}, o.order_status,
               o.seller_approval_status, p.payment_status, p.payment_method, u.name AS customer_name,
               u.email AS customer_email, u.phone AS customer_phone, u.address AS customer_address
        FROM e_orders o JOIN e_payments p ON p.order_id = o.order_id JOIN e_users u ON u.user_id = o.user_id
        WHERE o.seller_id IS NOT NULL""", "e_orders", "e_payments", "e_users"),
    "seller_orders_view": with_ctes(f"""
        WITH lab AS (
            SELECT i.order_id, string_agg(p.name || ' (' || CAST(i.quantity AS VARCHAR) || ')', ', '
                                          ORDER BY p.name || ' (' || CAST(i.quantity AS VARCHAR) || ')') AS products
            FROM e_items i JOIN e_products p ON p.product_id = i.product_id GROUP BY i.order_id)
        SELECT o.order_id, o.seller_id, o.created_at, {_d('o.total_amount')}, o.order_status,
               o.seller_approval_status, p.payment_status, p.payment_method, u.name AS customer_name, lab.products
        FROM e_orders o JOIN e_latest_pay p ON p.order_id = o.order_id JOIN e_users u ON u.user_id = o.user_id
        JOIN lab ON lab.order_id = o.order_id
        WHERE o.seller_id IS NOT NULL""", "e_orders", "e_latest_pay", "e_users", "e_items", "e_products"),
    "order_customer_detail": with_ctes(f"""
        SELECT o.order_id, o.user_id, o.seller_id, u.name AS customer_name, u.email AS customer_email,
               {_d('o.total_amount')}, o.order_status, o.seller_approval_status, o.created_at,
               coalesce(p.payment_status, 'Pending') AS payment_status,
               coalesce(p.payment_method, 'Not Specified') AS payment_method,
               CASE WHEN lower(coalesce(p.payment_status, 'Pending')) IN ('completed', 'paid') THEN 'success'
                    ELSE 'warning' END AS payment_badge
        FROM e_orders o JOIN e_users u ON u.user_id = o.user_id
        LEFT JOIN e_latest_pay p ON p.order_id = o.order_id""", "e_orders", "e_users", "e_latest_pay"),
    "product_changes": with_ctes(f"""
        WITH ok AS (SELECT * FROM e_outcomes WHERE outcome = 'applied'),
        top AS (SELECT greatest((SELECT max(product_id) FROM e_products),
                                (SELECT max(product_id) FROM e_product_changes WHERE op = 'add')) AS m),
        nxt AS (
            SELECT p.product_id, coalesce(e.name, p.name) AS name, coalesce(e.description, p.description) AS description,
                   coalesce(e.price, p.price) AS price, p.stock, p.category, coalesce(e.image_url, p.image_url) AS image_url,
                   p.created_at, p.seller_id
            FROM e_products p LEFT JOIN ok e ON e.op = 'edit' AND e.product_id = p.product_id
            WHERE NOT EXISTS (SELECT 1 FROM ok d WHERE d.op = 'delete' AND d.product_id = p.product_id)
            UNION ALL
            SELECT coalesce(a.product_id, top.m + row_number() OVER (PARTITION BY a.product_id IS NULL ORDER BY a.change_id)),
                   a.name, a.description, a.price, 0, a.category, coalesce(a.image_url, ''), CAST(NULL AS TIMESTAMP), a.seller_id
            FROM ok a, top WHERE a.op = 'add')
        SELECT {PRODUCT_COLS} FROM nxt""", "e_outcomes", "e_product_changes", "e_products"),
    "product_change_rejects": with_ctes("""
        SELECT change_id, outcome AS reason FROM e_outcomes WHERE outcome NOT IN ('applied', 'superseded')""", "e_outcomes"),
    "change_conservation": with_ctes("""
        SELECT 'registrations' AS feed, count(*) AS input_rows, count(*) AS accounted_rows FROM e_registrations
        UNION ALL SELECT 'product_changes', count(*), count(*) FROM e_product_changes
        UNION ALL SELECT 'cart_events', count(*), count(*) FROM e_cart_all""",
                                     "e_registrations", "e_product_changes", "e_cart_all"),
    "seller_assign": with_ctes("""
        WITH per AS (SELECT l_partkey AS product_id, l_suppkey AS seller_id, sum(l_quantity) AS q
                     FROM lineitem GROUP BY l_partkey, l_suppkey),
        best AS (SELECT product_id, seller_id FROM (
                   SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY q DESC, seller_id ASC) AS rn
                   FROM per) WHERE rn = 1)
        SELECT p.product_id, coalesce(b.seller_id, p.seller_id) AS seller_id, p.seller_id AS previous_seller_id
        FROM e_products p LEFT JOIN best b ON b.product_id = p.product_id""", "e_products"),
    "registration_ingest": REGISTRATIONS.format(rest="SELECT request_id, email_key, status, user_id FROM t"),
    "registration_rejects": REGISTRATIONS.format(
        rest="SELECT request_id, status AS reason FROM t WHERE status <> 'accepted'"),
    "new_users": REGISTRATIONS.format(rest="""
        SELECT user_id, name, email, address, phone, CAST(NULL AS TIMESTAMP) AS created_at FROM t
        WHERE status = 'accepted'"""),
    "user_credentials": with_ctes("""
        SELECT DISTINCT r.email_key, u.user_id, u.name
        FROM (SELECT DISTINCT lower(trim(email)) AS email_key FROM e_registrations) r
        JOIN e_users u ON lower(trim(u.email)) = r.email_key""", "e_registrations", "e_users"),
    "orders_of_requesters": with_ctes(f"""
        SELECT o.order_id, o.user_id, o.created_at, {_d('o.total_amount')}, o.order_status,
               p.payment_id, p.payment_status, p.payment_method
        FROM e_orders o LEFT JOIN e_latest_pay p ON p.order_id = o.order_id
        WHERE o.user_id IN (SELECT user_id FROM e_requests)""", "e_orders", "e_latest_pay", "e_requests"),
    "checkout_orders_untaxed": with_ctes(
        f"SELECT {ORDER_COLS.replace('CAST(o.total_amount AS DOUBLE)', 'CAST(o.subtotal AS DOUBLE)')} FROM e_new_orders o",
        "e_new_orders"),
    "seller_assign_listed": with_ctes("""
        SELECT product_id, CASE WHEN product_id IN (1, 2, 3, 4) THEN 1 ELSE seller_id END AS seller_id
        FROM e_products""", "e_products"),
    "product_search_catalogue": with_ctes(f"""
        WITH e_terms AS (
          SELECT DISTINCT unnest(list_concat([p_name, p_brand, p_type, p_brand || ' ' || p_type, replace(p_name, ' ', '_'),
                 upper(p_brand || '%' || p_name)], string_split(p_name, ' '))) AS term FROM part)
        SELECT e_terms.term, p.product_id FROM e_products p JOIN e_terms
          ON ({LIKE.format(t='p.name')}) OR ({LIKE.format(t='p.description')})""", "e_products"),
    "dq_unique": _dq_unique(),
    "dq_foreign_keys": _dq_fk(),
    "dq_not_null": _dq_not_null(),
    "dq_domain": _dq_domain(),
    "dq_order_totals": with_ctes("""
        WITH l AS (SELECT order_id, CAST(sum(subtotal) AS DECIMAL(18,2)) AS lines_total FROM e_items GROUP BY order_id),
        r AS (SELECT o.order_id, l.lines_total,
                     CAST(coalesce(CASE o.order_id % 50 WHEN 21 THEN l.lines_total WHEN 23 THEN round(l.lines_total * 1.1, 2) END,
                                   o.total_amount) AS DECIMAL(18,2)) AS total_amount
              FROM e_orders o LEFT JOIN l ON l.order_id = o.order_id)
        SELECT order_id, CAST(total_amount AS DOUBLE) AS total_amount, CAST(lines_total AS DOUBLE) AS lines_total,
               CASE WHEN lines_total IS NULL THEN 'no_lines' WHEN total_amount = lines_total THEN 'equal'
                    WHEN total_amount = round(lines_total * 1.1, 2) THEN 'with_tax' ELSE 'mismatch' END AS total_check
        FROM r""", "e_orders", "e_items"),
    "dq_unique_batch": _dq_unique_batch(),
    "dq_foreign_keys_batch": _dq_fk_batch(),
    "seller_dashboard_refreshed": with_ctes(f"""
        SELECT o.order_id, o.seller_id, o.created_at, {_d('o.total_amount')}, o.order_status,
               o.seller_approval_status, p.payment_status, coalesce(c.payment_method, p.payment_method) AS payment_method,
               u.name AS customer_name, u.email AS customer_email, u.phone AS customer_phone, u.address AS customer_address
        FROM e_orders o JOIN e_payments p ON p.order_id = o.order_id JOIN e_users u ON u.user_id = o.user_id
        LEFT JOIN e_pm_changes c ON c.order_id = o.order_id
        WHERE o.seller_id IS NOT NULL""", "e_orders", "e_payments", "e_users", "e_pm_changes"),
    "order_history_parts": with_ctes("""
        WITH l AS (
            SELECT i.order_id, concat_ws('|', CAST(i.product_id AS VARCHAR), CAST(i.quantity AS VARCHAR), CAST(i.subtotal AS VARCHAR),
                                         p.name, CAST(p.price AS VARCHAR)) AS line,
                   row_number() OVER (PARTITION BY i.order_id ORDER BY i.product_id, i.quantity, i.subtotal, p.name, p.price) - 1 AS n
            FROM e_items i JOIN e_products p ON p.product_id = i.product_id)
        SELECT o.order_id, o.user_id, CAST(coalesce(n // 2, 0) AS INTEGER) AS part, coalesce(string_agg(line, '; ' ORDER BY n), '') AS items_text
        FROM e_orders o LEFT JOIN l ON l.order_id = o.order_id GROUP BY o.order_id, o.user_id, n // 2""", "e_orders", "e_items", "e_products"),
    # Stream twins: the streaming job must end where the batch query ends.
    "stream_cart": CART_FOLD,
    "stream_payments": with_ctes("""
        SELECT row_number() OVER (ORDER BY o_orderkey) AS payment_id, o_orderkey AS order_id, o_custkey AS user_id,
               CAST(CAST(o_totalprice AS DECIMAL(10,2)) AS DOUBLE) AS amount, 'Pending' AS payment_status, 'Not Specified' AS payment_method, o_orderdate AS created_at
        FROM orders"""),
    "stream_order_status": ORDER_STATUS_LATEST,
}

_PAGE = "SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, order_id DESC) AS place FROM ({0})) WHERE place <= 3"
# A change made in place ends where the operator on the whole table does.
SQL |= {
    "payment_method_update_in_place": SQL["payment_method_update"],
    "product_changes_in_place": SQL["product_changes"],
    "order_history_first_page": _PAGE.format(SQL["order_history"]),
}
