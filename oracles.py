"""SQL twins of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from lectern.plans.model import LIVE_CHANGES, LIVE_ROUTES, TABLE_OF_EVENT

EV = """ev AS (
  SELECT event_id AS log_id, CAST(user_id AS VARCHAR) AS mid,
    CASE WHEN event_type <> 'error' THEN CAST(user_id AS VARCHAR) END AS uid,
    CAST(user_id AS VARCHAR) AS sid, ts,
    CASE event_type WHEN 'view' THEN 'home' WHEN 'click' THEN 'course_list' WHEN 'signup' THEN 'course_detail'
      WHEN 'purchase' THEN 'order' WHEN 'error' THEN 'search' END AS page_id,
    CAST(floor(value * 1000) AS BIGINT) AS during_time,
    CASE WHEN event_id % 3 <> 0 THEN '1' ELSE '0' END AS is_new,
    CAST(event_id % 2 AS VARCHAR) AS vc, CAST(user_id % 5 AS VARCHAR) AS sc, CAST(user_id % 25 AS VARCHAR) AS ar,
    'ch' || (user_id % 3) AS ch, 'ba' || (user_id % 4) AS ba, 'md' || (user_id % 6) AS md, 'os' || (user_id % 2) AS os,
    event_type, value, props, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    CAST(floor(epoch_us(ts) / 1000.0) AS BIGINT) AS millis, CAST(ts AS DATE) AS d
  FROM events)"""

PAGES = EV + """, pages AS (
  SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 14400000000 THEN lag(page_id) OVER w END AS last_page_id
  FROM ev WINDOW w AS (PARTITION BY mid ORDER BY ts, log_id))"""

FIXED = PAGES + """, firsts AS (
  SELECT *, first_value(d - CASE WHEN is_new = '1' THEN 0 ELSE 1 END) OVER (PARTITION BY mid ORDER BY ts, log_id) AS first_day
  FROM pages), fixed AS (
  SELECT * REPLACE (CASE WHEN is_new = '1' AND first_day <> d THEN '0' ELSE is_new END AS is_new) FROM firsts)"""


def traffic_parts(log: str) -> str:
    return f"""uv AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mid, d ORDER BY ts, log_id) AS rn
    FROM {log} WHERE last_page_id IS NULL) WHERE rn = 1), nexts AS (
  SELECT *, lead(ts) OVER w AS nts, lead(last_page_id) OVER w AS nlast
  FROM {log} WINDOW w AS (PARTITION BY mid ORDER BY ts, log_id)), jumps AS (
  SELECT * FROM nexts WHERE last_page_id IS NULL
    AND NOT coalesce(epoch_us(nts) - epoch_us(ts) < 10800000000 AND nlast IS NOT NULL, FALSE)), measures AS (
  SELECT ts, vc, sc, ar, is_new, 0 AS uv, CASE WHEN last_page_id IS NULL THEN 1 ELSE 0 END AS se, 1 AS pv, during_time AS du, 0 AS ju FROM {log}
  UNION ALL SELECT ts, vc, sc, ar, is_new, 1, 0, 0, 0, 0 FROM uv
  UNION ALL SELECT ts, vc, sc, ar, is_new, 0, 0, 0, 0, 1 FROM jumps)"""


TRAFFIC_SUMS = """, a1 AS (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, vc, sc, ar, is_new, CAST(sum(uv) AS BIGINT) AS uv_count,
    CAST(sum(se) AS BIGINT) AS total_session_count, CAST(sum(pv) AS BIGINT) AS page_view_count,
    CAST(sum(du) AS BIGINT) AS total_during_time, CAST(sum(ju) AS BIGINT) AS jump_session_count
  FROM measures GROUP BY 1, 2, 3, 4, 5), traffic AS (
  SELECT w, vc AS version_code, sc AS source_id, coalesce(r_name, '-') AS source_name, ar,
    coalesce(n_name, '-') AS province_name, is_new, uv_count, total_session_count, page_view_count, total_during_time, jump_session_count
  FROM a1 LEFT JOIN region ON sc = CAST(r_regionkey AS VARCHAR) LEFT JOIN nation ON ar = CAST(n_nationkey AS VARCHAR))"""

TRAFFIC = FIXED + ", " + traffic_parts("fixed") + TRAFFIC_SUMS

LINES = EV + """, good AS (SELECT * FROM ev WHERE k % 10 <> 0)"""

CHANGES = """changes AS (
  SELECT 'order_info' AS tab, CASE WHEN o_orderkey % 5 = 0 THEN 'update' ELSE 'insert' END AS type,
    CAST(o_orderkey AS VARCHAR) AS id, CAST(epoch(o_orderdate) AS BIGINT) AS ts, CAST(o_custkey AS VARCHAR) AS user_id, o_orderpriority AS body, NULL AS name, NULL AS extra FROM orders
  UNION ALL SELECT 'payment_info', 'update', CAST(o_orderkey AS VARCHAR), CAST(epoch(o_orderdate) AS BIGINT), NULL, CASE WHEN o_orderstatus = 'F' THEN '1602' ELSE '1601' END, NULL, NULL FROM orders
  UNION ALL SELECT 'cart_info', 'insert', CAST(event_id AS VARCHAR), CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT), CAST(user_id AS VARCHAR), NULL, NULL, NULL FROM events WHERE event_type = 'purchase'
  UNION ALL SELECT 'user_info', 'bootstrap-insert', CAST(c_custkey AS VARCHAR), 0, NULL, NULL, c_name, NULL FROM customer
  UNION ALL SELECT 'base_province', 'bootstrap-insert', CAST(n_nationkey AS VARCHAR), 0, NULL, NULL, n_name, NULL FROM nation
  UNION ALL SELECT 'base_source', 'bootstrap-start', CAST(r_regionkey AS VARCHAR), 0, NULL, NULL, r_name, NULL FROM region
  UNION ALL SELECT 'course_info', CASE WHEN s_suppkey % 4 = 0 THEN 'delete' ELSE 'update' END, CAST(s_suppkey AS VARCHAR), 1, NULL, NULL, s_name, CAST(s_nationkey AS VARCHAR) FROM supplier)"""

ORD = """ord AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS user_id, CAST(c_nationkey AS VARCHAR) AS province_id,
    'trade-' || o_orderkey AS out_trade_no, o_orderpriority AS trade_body, CAST(o_totalprice AS DECIMAL(16,2)) AS final_amount,
    o_orderdate AS ts, CAST(o_orderdate AS DATE) AS d, o_orderkey, o_orderstatus
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

DET = """det AS (
  SELECT *, CAST(origin_amount - final_amount AS DECIMAL(16,2)) AS coupon_reduce FROM (
  SELECT l_orderkey || '-' || l_linenumber AS id, CAST(l_suppkey AS VARCHAR) AS course_id, 'course ' || l_suppkey AS course_name,
    CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_extendedprice AS DECIMAL(16,2)) AS origin_amount,
    CAST(CAST(l_extendedprice AS DECIMAL(16,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(16,2)) AS final_amount,
    strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS create_time, l_shipdate AS row_op_ts FROM lineitem))"""

FACTS = EV + ", " + ORD + ", " + DET + """, src AS (
  SELECT sid AS session_id, arg_max(sc, ts) AS source_id FROM ev WHERE page_id = 'order' GROUP BY sid), heads AS (
  SELECT ord.id AS order_id, user_id, province_id, out_trade_no, trade_body, user_id AS session_id, source_id, ts
  FROM ord LEFT JOIN src ON ord.user_id = src.session_id), facts AS (
  SELECT det.*, h.user_id, h.province_id, h.out_trade_no, h.trade_body, h.session_id, h.source_id, h.ts, CAST(h.ts AS DATE) AS d
  FROM det JOIN heads h ON det.order_id = h.order_id), kept AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_op_ts DESC, course_id DESC, final_amount DESC) AS rn FROM facts) WHERE rn = 1)"""

PAID = FACTS + """, pays AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, 'ali-' || o_orderkey AS alipay_trade_no, o_orderpriority AS payment_type,
    o_orderdate + to_seconds(o_orderkey % 1200) AS pts FROM orders WHERE o_orderstatus = 'F'), paid AS (
  SELECT f.* EXCLUDE (ts, d), alipay_trade_no, payment_type, strftime(pts, '%Y-%m-%d %H:%M:%S') AS callback_time, pts AS ts, CAST(pts AS DATE) AS d
  FROM facts f JOIN pays p ON f.order_id = p.order_id
  WHERE epoch_us(pts) - epoch_us(f.ts) BETWEEN 0 AND 905000000)"""

MICROS = "'%Y-%m-%d %H:%M:%S.%f'"
SECONDS = "'%Y-%m-%d %H:%M:%S'"




def bounds(expr: str, width: str) -> str:
    return (f"strftime({expr}, {SECONDS}) AS stt, strftime({expr} + INTERVAL {width}, {SECONDS}) AS edt")


HOUR, TEN = "1 HOUR", "10 SECOND"


def buyers(source: str, uv: str, new: str, width: str = TEN) -> str:
    """Window totals of daily unique and new users of ``source(user_id, d, ts)``."""
    return f"""days AS (SELECT user_id, d, min(ts) AS ts FROM {source} GROUP BY 1, 2), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d) AS rn FROM days), out AS (
  SELECT time_bucket(INTERVAL {width}, ts) AS w, CAST(count(*) AS BIGINT) AS {uv}, CAST(sum(CASE WHEN rn = 1 THEN 1 ELSE 0 END) AS BIGINT) AS {new}
  FROM ranked GROUP BY 1)"""


KEYWORDS = """hits AS (
  SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS keyword,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS BIGINT)) AS ts FROM documents), a2 AS (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, keyword, CAST(count(*) AS BIGINT) AS keyword_count FROM hits GROUP BY 1, 2)"""

PAGE_VIEWS = EV + """, firsts AS (
  SELECT mid, page_id, d, min(ts) AS ts FROM ev WHERE page_id IN ('home', 'course_list', 'course_detail') GROUP BY 1, 2, 3), a3 AS (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, CAST(count(*) FILTER (page_id = 'home') AS BIGINT) AS home_uv_count,
    CAST(count(*) FILTER (page_id = 'course_list') AS BIGINT) AS list_uv_count,
    CAST(count(*) FILTER (page_id = 'course_detail') AS BIGINT) AS detail_uv_count FROM firsts GROUP BY 1)"""

DUE_LOGIN = "ts + INTERVAL 10 SECOND <= (SELECT max(ts) - INTERVAL 5 SECOND FROM ev WHERE uid IS NOT NULL)"


def login_days(due: str = "TRUE") -> str:
    """Login days of the first-login facts: of a device and day only the first logged-in row counts."""
    return EV + f""", firstl AS (
  SELECT *, row_number() OVER (PARTITION BY mid, d ORDER BY ts, log_id) AS rn FROM ev WHERE uid IS NOT NULL), ldays AS (
  SELECT uid AS user_id, d, min(ts) AS ts FROM firstl WHERE rn = 1 AND {due} GROUP BY 1, 2), lgaps AS (
  SELECT *, CASE WHEN epoch_us(ts) - epoch_us(CAST(lag(d) OVER (PARTITION BY user_id ORDER BY d) AS TIMESTAMP)) > 604800000000 THEN 1 ELSE 0 END AS back FROM ldays), a4 AS (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, CAST(sum(back) AS BIGINT) AS back_count, CAST(count(*) AS BIGINT) AS uv_count FROM lgaps GROUP BY 1)"""


LOGIN_DAYS = login_days()

REGISTERS = """regs AS (
  SELECT user_id, max(ts) AS ts FROM events WHERE event_type = 'signup' GROUP BY 1), a5 AS (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, CAST(count(*) AS BIGINT) AS register_count FROM regs GROUP BY 1)"""

PLAYS = EV + """, plays AS (
  SELECT log_id, mid AS uid, sid, sc, CAST(k AS VARCHAR) AS video_id, CAST(floor(value) AS INTEGER) AS play_sec, k AS position_sec, ts, d
  FROM ev WHERE event_type = 'view')"""

SESSIONS = PLAYS + """, sgaps AS (
  SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 21600000000 THEN 0 ELSE 1 END AS s FROM plays WINDOW w AS (PARTITION BY sid ORDER BY ts, log_id)), snums AS (
  SELECT *, sum(s) OVER (PARTITION BY sid ORDER BY ts, log_id) AS no FROM sgaps), sess AS (
  SELECT sid, arg_min(uid, ts) AS uid, arg_min(video_id, ts) AS video_id, sum(play_sec) AS play_sec, min(ts) AS ts, max(ts) AS last_ts,
    CAST(min(ts) AS DATE) AS d, min(log_id) AS log_id FROM snums GROUP BY sid, no)"""


def chapters(closed_only: str = "TRUE") -> str:
    """Plays per chapter, from play sessions: a session counts once, in the window of its first row."""
    return SESSIONS + f""", rankedp AS (
  SELECT *, row_number() OVER (PARTITION BY uid, d ORDER BY ts, log_id) AS rn FROM sess WHERE {closed_only}), pv AS (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, video_id, count(*) AS pc, sum(play_sec) AS ps, count(*) FILTER (rn = 1) AS pu FROM rankedp GROUP BY 1, 2), a6 AS (
  SELECT w, coalesce(CAST(p_size AS VARCHAR), '-') AS chapter_id, coalesce(s_name, '-') AS chapter_name,
    CAST(pc AS BIGINT) AS play_count, CAST(ps AS BIGINT) AS play_total_sec, CAST(pu AS BIGINT) AS play_uu_count
  FROM pv LEFT JOIN part ON video_id = CAST(p_partkey AS VARCHAR) LEFT JOIN supplier ON p_size = s_suppkey)"""


CHAPTERS = chapters()

CART = EV + """, cdays AS (SELECT mid AS user_id, d, min(ts) AS ts FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2), a7 AS (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, CAST(count(*) AS BIGINT) AS cart_add_uv_count FROM cdays GROUP BY 1)"""

ORDER_BUYERS = FACTS + ", " + buyers("kept", "order_uv_count", "new_order_user_count")

PAYERS = PAID + """, pkept AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_op_ts DESC) AS rn2 FROM paid) WHERE rn2 = 1), """ + buyers(
    "pkept", "pay_suc_uv_count", "pay_suc_new_user_count")

PROVINCES = ORD + """, pfirst AS (
  SELECT *, row_number() OVER (PARTITION BY province_id, user_id, d ORDER BY ts, id) AS rn FROM ord), pw AS (
  SELECT time_bucket(INTERVAL 10 SECOND, ts) AS w, province_id, sum(final_amount) AS amt, count(*) FILTER (rn = 1) AS uu, count(*) AS ct FROM pfirst GROUP BY 1, 2), a10 AS (
  SELECT w, province_id, coalesce(n_name, '-') AS province_name, CAST(amt AS DOUBLE) AS order_total_amount, amt, CAST(uu AS BIGINT) AS order_uu_count, CAST(ct AS BIGINT) AS order_count
  FROM pw LEFT JOIN nation ON province_id = CAST(n_nationkey AS VARCHAR))"""

SOURCES = FACTS + """, k2 AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, source_id, d ORDER BY ts, id) AS ru, row_number() OVER (PARTITION BY order_id ORDER BY ts, id) AS ro
  FROM kept WHERE source_id IS NOT NULL AND order_id IS NOT NULL), sw AS (
  SELECT time_bucket(INTERVAL 10 SECOND, ts) AS w, source_id, sum(final_amount) AS amt, count(*) FILTER (ru = 1) AS uu, count(*) FILTER (ro = 1) AS ct FROM k2 GROUP BY 1, 2), a11 AS (
  SELECT w, source_id, coalesce(r_name, '-') AS source_name, amt, CAST(amt AS DOUBLE) AS order_total_amount, CAST(uu AS BIGINT) AS order_uu_count, CAST(ct AS BIGINT) AS order_count
  FROM sw LEFT JOIN region ON source_id = CAST(r_regionkey AS VARCHAR))"""

COURSES = FACTS + """, cw AS (
  SELECT time_bucket(INTERVAL 10 SECOND, ts) AS w, course_id, sum(final_amount) AS amt FROM (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_op_ts DESC, course_id DESC, final_amount DESC) AS rc FROM facts) WHERE rc = 1) GROUP BY 1, 2), a12 AS (
  SELECT w, course_id, coalesce(s_name, '-') AS course_name, coalesce(CAST(s_nationkey AS VARCHAR), '-') AS subject_id, coalesce(n_name, '-') AS subject_name,
    coalesce(CAST(n_regionkey AS VARCHAR), '-') AS category_id, coalesce(r_name, '-') AS category_name, amt, CAST(amt AS DOUBLE) AS order_total_amount
  FROM cw LEFT JOIN supplier ON course_id = CAST(s_suppkey AS VARCHAR) LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""

EXAMS = """ew AS (
  SELECT time_bucket(INTERVAL 10 SECOND, l_shipdate) AS w, l_partkey, count(*) AS ct, sum(CAST(trunc(l_quantity * 2) AS BIGINT)) AS sc, sum(l_linenumber * 60) AS du FROM lineitem GROUP BY 1, 2), a13 AS (
  SELECT w, CAST(l_partkey AS VARCHAR) AS paper_id, coalesce(p_name, '-') AS paper_title, coalesce(CAST(p_size AS VARCHAR), '-') AS course_id, coalesce(s_name, '-') AS course_name,
    CAST(ct AS BIGINT) AS exam_taken_count, CAST(sc AS BIGINT) AS exam_total_score, CAST(du AS BIGINT) AS exam_total_during_sec
  FROM ew LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON p_size = s_suppkey)"""


def band(score: str) -> str:
    return (f"CASE WHEN {score} < 60 THEN '[0,60)' WHEN {score} < 70 THEN '[60,70)' WHEN {score} < 80 THEN '[70,80)' "
            f"WHEN {score} < 90 THEN '[80,90)' WHEN {score} <= 100 THEN '[90,100]' ELSE '' END")


SCORES = f"""bw AS (
  SELECT time_bucket(INTERVAL 10 SECOND, l_shipdate) AS w, l_partkey, {band('l_quantity * 2')} AS score_duration, count(*) AS ct FROM lineitem GROUP BY 1, 2, 3), a14 AS (
  SELECT w, CAST(l_partkey AS VARCHAR) AS paper_id, coalesce(p_name, '-') AS paper_title, score_duration, CAST(ct AS BIGINT) AS user_count FROM bw LEFT JOIN part ON l_partkey = p_partkey)"""

ANSWERS = EV + """, qw AS (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, k, count(*) FILTER (value > 50) AS c, count(*) AS a FROM ev GROUP BY 1, 2), a15 AS (
  SELECT w, CAST(k AS VARCHAR) AS question_id, coalesce(p_name, '-') AS question_txt, p_name, CAST(c AS BIGINT) AS correct_answer_count, CAST(a AS BIGINT) AS answer_count
  FROM qw LEFT JOIN part ON k = p_partkey)"""

REVIEWS = """vw AS (
  SELECT time_bucket(INTERVAL 10 SECOND, l_shipdate) AS w, l_suppkey, sum(CAST(l_quantity AS INTEGER) % 5 + 1) AS st, count(*) AS ct, count(*) FILTER (CAST(l_quantity AS INTEGER) % 5 + 1 = 5) AS gd FROM lineitem GROUP BY 1, 2), a16 AS (
  SELECT w, CAST(l_suppkey AS VARCHAR) AS course_id, coalesce(s_name, '-') AS course_name, CAST(st AS BIGINT) AS review_total_stars, CAST(ct AS BIGINT) AS review_user_count, CAST(gd AS BIGINT) AS good_review_user_count
  FROM vw LEFT JOIN supplier ON l_suppkey = s_suppkey)"""


def big(expr: str, name: str) -> str:
    return f"CAST(sum({expr}) AS BIGINT) AS {name}"


ORACLES: dict[str, str] = {
    # messages, parsing, filters
    "p1_good_records": f"WITH {EV} SELECT k, CAST(count(*) AS BIGINT) AS record_count FROM ev WHERE k % 10 <> 0 GROUP BY 1",
    "p1_dirty_records": f"WITH {EV} SELECT substring(props, 2) AS value FROM ev WHERE k % 10 = 0",
    "p2_parse_or_drop": f"WITH {EV} SELECT k FROM ev WHERE k % 10 <> 0",
    "s1_message_filter": f"WITH {EV} SELECT props AS value, CAST(count(*) AS BIGINT) AS message_count FROM ev WHERE k % 10 > 1 GROUP BY 1",
    "s2_json_view_sql": f"""WITH {LINES} SELECT uid AS user_id, page_id, CAST(count(*) AS BIGINT) AS view_count, CAST(sum(during_time) AS BIGINT) AS during_time
        FROM good WHERE event_type IN ('click', 'purchase') GROUP BY 1, 2""",
    "s3_change_row_counts": f"""WITH {CHANGES} SELECT 'edu' AS database, tab AS "table", type, CAST(count(*) AS BIGINT) AS row_count, max(ts) AS last_ts FROM changes GROUP BY 2, 3""",
    "p3_dimension_changes": f"""WITH {CHANGES} SELECT tab AS "table", type, CAST(count(*) AS BIGINT) AS row_count FROM changes WHERE type <> 'bootstrap-start' GROUP BY 1, 2""",
    "p4_fact_changes": f"""WITH {CHANGES} SELECT tab AS "table", type, CAST(count(*) AS BIGINT) AS row_count FROM changes WHERE type NOT LIKE 'bootstrap%' GROUP BY 1, 2""",
    "p5_tombstone_filter": "SELECT event_id, props AS value FROM events WHERE event_type <> 'error'",
    "p6_required_ids": f"WITH {FACTS} SELECT id, source_id, order_id FROM facts WHERE source_id IS NOT NULL AND order_id IS NOT NULL",
    "p7_order_insert_rows": f"WITH {CHANGES} SELECT id, user_id AS buyer, body AS trade_body, CAST(ts AS VARCHAR) AS ts FROM changes WHERE tab = 'order_info' AND type = 'insert'",
    "p8_payment_success": "SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderkey AS VARCHAR) AS order_id FROM orders WHERE o_orderstatus = 'F'",
    "p9_map_entry_projection": f"WITH {CHANGES} SELECT id AS cart_id, user_id AS buyer_id, '-' AS missing, CAST(ts AS VARCHAR) AS ts FROM changes WHERE tab = 'cart_info'",
    "p10_entry_pages": f"WITH {PAGES} SELECT log_id, mid, page_id FROM pages WHERE last_page_id IS NULL",
    "p11_logged_in_pages": f"WITH {EV} SELECT log_id, uid FROM ev WHERE uid IS NOT NULL",
    "p12_view_pages": f"WITH {EV} SELECT log_id, page_id FROM ev WHERE page_id IN ('home', 'course_list', 'course_detail')",
    "p13_order_pages": f"WITH {EV} SELECT log_id, sid, sc FROM ev WHERE page_id = 'order'",
    "p14_searches": f"SELECT md5(text) AS text_md5, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS BIGINT)), {MICROS}) AS ts FROM documents",
    "p15_error_log": f"WITH {LINES} SELECT k AS error_code FROM good WHERE event_type = 'error'",
    "p15_start_log": f"WITH {LINES} SELECT mid, 'icon' AS entry, millis AS ts FROM good WHERE event_type = 'signup'",
    "p15_video_log": f"WITH {LINES} SELECT mid, CAST(k AS VARCHAR) AS video_id, CAST(floor(value) AS INTEGER) AS play_sec, k AS position_sec, millis AS ts FROM good WHERE event_type = 'view'",
    "p15_page_log": f"""WITH {LINES} SELECT mid, is_new, page_id, during_time, strftime(make_timestamp(millis * 1000), {MICROS}) AS ts
        FROM good WHERE event_type IN ('click', 'purchase', 'error')""",
    "p16_display_log": f"""WITH {LINES} SELECT page_id AS item, k AS pos_id, mid, page_id, millis AS ts FROM good WHERE event_type = 'click'
        UNION ALL SELECT page_id, k, mid, page_id, millis FROM good WHERE event_type = 'click'""",
    "p16_action_log": f"WITH {LINES} SELECT page_id AS item, k AS pos_id, mid, page_id, millis AS ts FROM good WHERE event_type = 'click'",
    "p17_record_without_error": f"""WITH {LINES} SELECT '{{"page_id":"' || page_id || '","ts":' || millis || '}}' AS value FROM good WHERE event_type IN ('click', 'purchase', 'error')""",
    "p18_flat_plays": f"""WITH {LINES} SELECT sc, ar, uid, os, ch, is_new, md, mid, vc, ba, sid, CAST(floor(value) AS INTEGER) AS play_sec, k AS position_sec,
        CAST(k AS VARCHAR) AS video_id, strftime(make_timestamp(millis * 1000), {MICROS}) AS ts FROM good WHERE event_type = 'view'""",
    "p19_login_facts": f"""WITH {EV}, f AS (SELECT *, row_number() OVER (PARTITION BY mid, d ORDER BY ts, log_id) AS rn FROM ev WHERE uid IS NOT NULL)
        SELECT uid AS user_id, strftime(ts, '%Y-%m-%d') AS date_id, strftime(ts, {SECONDS}) AS login_time, ch AS channel, ar AS province_id, vc AS version_code,
        mid AS mid_id, ba AS brand, md AS model, sc AS source_id, os AS operating_system, strftime(ts, {MICROS}) AS ts FROM f WHERE rn = 1""",
    "p20_column_pruning": f"""WITH {CHANGES} SELECT CASE tab WHEN 'base_province' THEN 'dim_base_province' ELSE 'dim_course_info' END AS sink_table,
        CASE tab WHEN 'base_province' THEN 'id,name' ELSE 'course_name,id,subject_id' END AS columns, CAST(count(*) AS BIGINT) AS row_count
        FROM changes WHERE tab IN ('base_province', 'course_info') GROUP BY 1, 2""",
    "p21_measure_rows": f"""WITH {PAGES}, {traffic_parts('pages')} SELECT strftime(ts, '%Y-%m-%d') AS day, vc, sc, ar, is_new, {big('uv', 'uv_count')}, {big('se', 'total_session_count')},
        {big('pv', 'page_view_count')}, {big('du', 'total_during_time')}, {big('ju', 'jump_session_count')} FROM measures GROUP BY 1, 2, 3, 4, 5""",
    "p22_score_bands": f"SELECT CAST(l_partkey AS VARCHAR) AS paper_id, {band('(l_quantity * 2 + 2)')} AS score_duration, CAST(count(*) AS BIGINT) AS user_count FROM lineitem GROUP BY 1, 2",
    "p23_condition_counts": f"""WITH {PAGES} SELECT sc, CAST(count(*) FILTER (last_page_id IS NULL) AS BIGINT) AS entries,
        CAST(count(*) FILTER (last_page_id = 'home') AS BIGINT) AS from_home FROM pages GROUP BY 1""",
    # routing
    "j5_dimension_routing": f"""WITH {CHANGES} SELECT 'dim_base_province' AS sink_table, 'id' AS sink_pk, type AS _op, id, name, '-' AS course_name, '-' AS subject_id, CAST(ts AS VARCHAR) AS ts
        FROM changes WHERE tab = 'base_province'
        UNION ALL SELECT 'dim_course_info', 'id', type, id, '-', name, extra, CAST(ts AS VARCHAR) FROM changes WHERE tab = 'course_info'""",
    "j5_fact_routing": f"""WITH {CHANGES} SELECT 'dwd_trade_cart_add' AS sink_table, '-' AS id, user_id, CAST(ts AS VARCHAR) AS ts FROM changes WHERE tab = 'cart_info'
        UNION ALL SELECT 'dwd_trade_order_head', id, user_id, CAST(ts AS VARCHAR) FROM changes WHERE tab = 'order_info' AND type = 'insert'
        UNION ALL SELECT 'dwd_trade_order_change', id, '-', CAST(ts AS VARCHAR) FROM changes WHERE tab = 'order_info' AND type = 'update'""",
    "s4_config_in_force": f"""WITH {CHANGES} SELECT tab AS source_table, 'dim_' || tab AS sink_table, CASE tab WHEN 'base_province' THEN 'id,name' ELSE 'id,course_name,subject_id' END AS sink_columns,
        CAST(count(*) AS BIGINT) AS row_count FROM changes WHERE tab IN ('base_province', 'course_info') GROUP BY 1""",
    # joins
    "j1_j2_order_details": f"""WITH {FACTS} SELECT id, course_id, course_name, order_id, CAST(origin_amount AS DOUBLE) AS origin_amount, CAST(coupon_reduce AS DOUBLE) AS coupon_reduce,
        CAST(final_amount AS DOUBLE) AS final_amount, create_time, user_id, province_id, out_trade_no, trade_body, session_id, coalesce(source_id, '-') AS source_id, strftime(ts, {MICROS}) AS ts FROM facts""",
    "j3_paid_details": f"""WITH {PAID} SELECT id, order_id, user_id, CAST(final_amount AS DOUBLE) AS final_amount, alipay_trade_no, payment_type, callback_time, strftime(ts, {MICROS}) AS ts FROM paid""",
    "j4_registrations": f"""WITH {EV}, dev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ts DESC) AS rn FROM ev WHERE uid IS NOT NULL) WHERE rn = 1)
        SELECT e.mid AS user_id, strftime(e.ts, '%Y-%m-%d') AS register_date, coalesce(d.ch, '-') AS channel, coalesce(d.ar, '-') AS province_id, coalesce(d.vc, '-') AS version_code,
        coalesce(d.sc, '-') AS source_id, coalesce(d.mid, '-') AS mid_id, coalesce(d.ba, '-') AS brand, coalesce(d.md, '-') AS model, coalesce(d.os, '-') AS operate_system, strftime(e.ts, {MICROS}) AS ts
        FROM ev e LEFT JOIN dev d ON e.mid = d.uid WHERE e.event_type = 'signup'""",
    "j6_source_and_province_names": f"""WITH {EV} SELECT sc, ar, r_name AS source_name, n_name AS province_name, CAST(count(*) AS BIGINT) AS page_count
        FROM ev LEFT JOIN region ON sc = CAST(r_regionkey AS VARCHAR) LEFT JOIN nation ON ar = CAST(n_nationkey AS VARCHAR) GROUP BY 1, 2, 3, 4""",
    "j6_composite_key_lookup": "SELECT c_custkey, c_nationkey, coalesce(s_name, '-') AS found FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey AND c_nationkey = s_nationkey",
    "j7_course_subject_category": f"""WITH {DET} SELECT course_id, CAST(sum(final_amount) AS DOUBLE) AS amount, s_name AS course_name, CAST(s_nationkey AS VARCHAR) AS subject_id, n_name AS subject_name,
        CAST(n_regionkey AS VARCHAR) AS category_id, r_name AS category_name FROM det LEFT JOIN supplier ON course_id = CAST(s_suppkey AS VARCHAR)
        LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
    "j7b_paper_course_and_video_chapter": f"""WITH {PLAYS} SELECT 'paper' AS kind, CAST(l_partkey AS VARCHAR) AS id, coalesce(CAST(p_size AS VARCHAR), '-') AS parent_id, coalesce(s_name, '-') AS parent_name, CAST(count(*) AS BIGINT) AS row_count
        FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON p_size = s_suppkey GROUP BY ALL
        UNION ALL SELECT 'video', video_id, coalesce(CAST(p_size AS VARCHAR), '-'), coalesce(s_name, '-'), CAST(count(*) AS BIGINT)
        FROM plays LEFT JOIN part ON video_id = CAST(p_partkey AS VARCHAR) LEFT JOIN supplier ON p_size = s_suppkey GROUP BY ALL""",
    "j8_f1_keyword_rows": f"WITH {KEYWORDS} SELECT keyword, CAST(count(*) AS BIGINT) AS hits, strftime(min(ts), {MICROS}) AS first_ts FROM hits GROUP BY 1",
    # stateful
    "t1_new_visitor_repair": f"WITH {FIXED} SELECT log_id, mid, is_new FROM fixed",
    "t2_daily_unique_visitor": f"WITH {PAGES}, {traffic_parts('pages')} SELECT mid, log_id, page_id, strftime(ts, {MICROS}) AS ts FROM uv",
    "t3_unique_visitor_per_page": f"""WITH {EV}, f AS (SELECT *, row_number() OVER (PARTITION BY mid, page_id, d ORDER BY ts, log_id) AS rn FROM ev
        WHERE page_id IN ('home', 'course_list', 'course_detail')) SELECT mid, page_id, log_id FROM f WHERE rn = 1""",
    "t4_bounces": f"WITH {PAGES}, {traffic_parts('pages')} SELECT mid, log_id, page_id, strftime(ts, {MICROS}) AS ts FROM jumps",
    "t5_first_logins": f"""WITH {EV}, f AS (SELECT *, row_number() OVER (PARTITION BY mid, d ORDER BY ts, log_id) AS rn FROM ev WHERE uid IS NOT NULL)
        SELECT mid, uid, log_id, strftime(ts, {MICROS}) AS ts FROM f WHERE rn = 1""",
    "t6_latest_version": f"""WITH {DET}, f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_op_ts DESC, course_id DESC, course_name DESC, order_id DESC,
        origin_amount DESC, coupon_reduce DESC, final_amount DESC, create_time DESC) AS rn FROM det)
        SELECT id, course_id, course_name, order_id, CAST(origin_amount AS DOUBLE) AS origin_amount, CAST(coupon_reduce AS DOUBLE) AS coupon_reduce,
        CAST(final_amount AS DOUBLE) AS final_amount, create_time, strftime(row_op_ts, {MICROS}) AS row_op_ts FROM f WHERE rn = 1""",
    "t7_login_returns": f"WITH {LOGIN_DAYS} SELECT user_id, strftime(ts, {MICROS}) AS ts, CAST(1 AS BIGINT) AS uv_count, CAST(back AS BIGINT) AS back_count FROM lgaps",
    "t8_cart_unique_users": f"WITH {CART} SELECT user_id, strftime(ts, {MICROS}) AS ts FROM cdays",
    "t9_order_buyers": f"""WITH {ORD}, {buyers('ord', 'uv', 'nw')} SELECT user_id, strftime(ts, {MICROS}) AS ts, CAST(1 AS BIGINT) AS uv_count, CAST(CASE WHEN rn = 1 THEN 1 ELSE 0 END AS BIGINT) AS new_count FROM ranked""",
    "t10_payers": f"""WITH {ORD}, po AS (SELECT user_id, ts + to_seconds(o_orderkey % 1200) AS ts, d FROM ord WHERE o_orderstatus = 'F'), {buyers('po', 'uv', 'nw')}
        SELECT user_id, strftime(ts, {MICROS}) AS ts, CAST(1 AS BIGINT) AS uv_count, CAST(CASE WHEN rn = 1 THEN 1 ELSE 0 END AS BIGINT) AS new_count FROM ranked""",
    "t11_province_buyer_flag": f"""WITH {ORD} SELECT id, province_id, user_id, CAST(CASE WHEN row_number() OVER (PARTITION BY province_id, user_id, d ORDER BY ts, id) = 1 THEN 1 ELSE 0 END AS BIGINT) AS order_uu_count FROM ord""",
    "t12_source_buyer_flag": f"""WITH {EV} SELECT log_id, mid, sc, CAST(CASE WHEN row_number() OVER (PARTITION BY mid, sc, d ORDER BY ts, log_id) = 1 THEN 1 ELSE 0 END AS BIGINT) AS order_uu_count FROM ev WHERE page_id = 'order'""",
    "t13_order_counting": f"""WITH {DET}, f AS (SELECT id, order_id, max(row_op_ts) AS row_op_ts FROM det GROUP BY 1, 2)
        SELECT id, order_id, CAST(CASE WHEN row_number() OVER (PARTITION BY order_id ORDER BY row_op_ts, id) = 1 THEN 1 ELSE 0 END AS BIGINT) AS order_count FROM f""",
    "t14_unique_viewer_flag": f"""WITH {PLAYS} SELECT log_id, uid, CAST(CASE WHEN row_number() OVER (PARTITION BY uid, d ORDER BY ts, log_id) = 1 THEN 1 ELSE 0 END AS BIGINT) AS play_uu_count FROM plays""",
    "w5_keyed_tumbling_window": f"""WITH {EV}, o AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS w, page_id, CAST(count(*) AS BIGINT) AS views, CAST(sum(during_time) AS BIGINT) AS during_time FROM ev GROUP BY 1, 2)
        SELECT {bounds('w', '10 MINUTE')}, page_id, views, during_time FROM o""",
    "w6_global_tumbling_window": f"""WITH {EV}, o AS (SELECT time_bucket(INTERVAL 10 SECOND, ts) AS w, CAST(count(*) AS BIGINT) AS views FROM ev GROUP BY 1)
        SELECT {bounds('w', TEN)}, views FROM o""",
    # window tables
    "a0_play_sessions": f"""WITH {PLAYS}, g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 21600000000 THEN 0 ELSE 1 END AS s FROM plays WINDOW w AS (PARTITION BY sid ORDER BY ts, log_id)),
        n AS (SELECT *, sum(s) OVER (PARTITION BY sid ORDER BY ts, log_id) AS no FROM g)
        SELECT sid, arg_min(uid, ts) AS uid, arg_min(sc, ts) AS sc, arg_min(video_id, ts) AS video_id, CAST(sum(play_sec) AS BIGINT) AS play_sec, arg_max(position_sec, ts) AS position_sec,
        strftime(min(ts), {MICROS}) AS ts FROM n GROUP BY sid, no""",
    "a1_traffic_window": f"WITH {TRAFFIC} SELECT {bounds('w', HOUR)}, * EXCLUDE (w) FROM traffic",
    "a2_keyword_window": f"WITH {KEYWORDS} SELECT {bounds('w', HOUR)}, 'SEARCH' AS source, keyword, keyword_count FROM a2",
    "a3_page_view_window": f"WITH {PAGE_VIEWS} SELECT {bounds('w', HOUR)}, * EXCLUDE (w) FROM a3",
    "a4_user_login_window": f"WITH {LOGIN_DAYS} SELECT {bounds('w', HOUR)}, * EXCLUDE (w) FROM a4",
    "a5_user_register_window": f"WITH {REGISTERS} SELECT {bounds('w', HOUR)}, register_count FROM a5",
    "a6_chapter_play_window": f"WITH {CHAPTERS} SELECT {bounds('w', HOUR)}, * EXCLUDE (w) FROM a6",
    "a7_cart_add_window": f"WITH {CART} SELECT {bounds('w', HOUR)}, cart_add_uv_count FROM a7",
    "a8_order_buyer_window": f"WITH {ORDER_BUYERS} SELECT {bounds('w', TEN)}, * EXCLUDE (w) FROM out",
    "a9_payer_window": f"WITH {PAYERS} SELECT {bounds('w', TEN)}, * EXCLUDE (w) FROM out",
    "a10_province_order_window": f"WITH {PROVINCES} SELECT {bounds('w', TEN)}, * EXCLUDE (w, amt) FROM a10",
    "a11_source_order_window": f"WITH {SOURCES} SELECT {bounds('w', TEN)}, * EXCLUDE (w, amt) FROM a11",
    "a12_course_order_window": f"WITH {COURSES} SELECT {bounds('w', TEN)}, * EXCLUDE (w, amt) FROM a12",
    "a13_paper_exam_window": f"WITH {EXAMS} SELECT {bounds('w', TEN)}, * EXCLUDE (w) FROM a13",
    "a14_paper_score_window": f"WITH {SCORES} SELECT {bounds('w', TEN)}, * EXCLUDE (w) FROM a14",
    "a15_question_answer_window": f"WITH {ANSWERS} SELECT {bounds('w', HOUR)}, * EXCLUDE (w, p_name) FROM a15",
    "a16_course_review_window": f"WITH {REVIEWS} SELECT {bounds('w', TEN)}, * EXCLUDE (w) FROM a16",
    # scalar functions
    "f_time_functions": f"""SELECT event_id, CAST(floor(epoch_us(ts) / 1000.0) AS BIGINT) AS millis, strftime(make_timestamp(CAST(floor(epoch_us(ts) / 1000.0) AS BIGINT) * 1000) + INTERVAL 8 HOUR, {MICROS}) AS local_ts, strftime(ts, '%Y-%m-%d') AS date_id,
        CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS date_number, epoch_ms(CAST(CAST(ts AS DATE) AS TIMESTAMP)) - 28800000 AS day_start_millis,
        strftime(date_trunc('second', ts), {SECONDS}) AS row_time, strftime(ts, '%H') AS hour_label, strftime(ts, '%Y-%m-%d') AS date_part FROM events""",
    "f_version_compare": "SELECT event_id, event_id % 3 - 1 < 0 AS is_newer FROM events",
    "f_text_functions": r"SELECT doc_id, substring(md5(text), 1, 10) AS digest, CAST(len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS INTEGER) AS word_count FROM documents",
    "f_keyword_weights": """SELECT CASE event_type WHEN 'purchase' THEN 'ORDER' WHEN 'view' THEN 'SEARCH' ELSE upper(event_type) END AS source,
        CAST(sum(CASE event_type WHEN 'view' THEN 10 WHEN 'purchase' THEN 5 WHEN 'click' THEN 1 ELSE 0 END) AS BIGINT) AS weight FROM events GROUP BY 1""",
    "f_json_encode": f"""WITH {PLAYS} SELECT log_id, '{{"uid":"' || uid || '","video_id":"' || video_id || '","play_sec":' || play_sec || '}}' AS value FROM plays""",
}


# --- reports ---------------------------------------------------------------------------------------

def by_source(measure: str, name: str) -> str:
    return f"WITH {TRAFFIC} SELECT source_id, source_name, {measure} AS {name} FROM traffic GROUP BY 1, 2 ORDER BY 3 DESC, 1"


def share(a: str, b: str) -> str:
    return f"round(CAST(sum({a}) AS DOUBLE) / nullif(sum({b}), 0), 6)"


def by_hour(where: str) -> str:
    return f"""WITH {TRAFFIC}, h AS (SELECT hour(w) AS hr, sum(uv_count) AS uv, sum(page_view_count) AS pv, sum(CASE WHEN is_new = '1' THEN uv_count ELSE 0 END) AS nu FROM traffic {where} GROUP BY 1)
        SELECT lpad(CAST(g AS VARCHAR), 2, '0') AS hr, CAST(coalesce(uv, 0) AS BIGINT) AS uv_count, CAST(coalesce(pv, 0) AS BIGINT) AS page_view_count, CAST(coalesce(nu, 0) AS BIGINT) AS new_uv_count
        FROM range(24) t(g) LEFT JOIN h ON h.hr = g ORDER BY 1"""


def totals(ctes: str, rows: list[tuple[str, str, str]], label: str, value: str, where: str = "") -> str:
    return f"WITH {ctes} " + " UNION ALL ".join(
        f"SELECT '{n}' AS {label}, CAST(coalesce(sum({c}), 0) AS BIGINT) AS {value} FROM {t} {where}" for n, t, c in rows)


USER_ROWS = [("back_count", "a4", "back_count"), ("activeUserCt", "a4", "uv_count"), ("newUserCt", "a5", "register_count")]


def ratio_of(kind: str, part: str, scale: str = "") -> str:
    return (f"round(coalesce(CAST(sum({part}) FILTER (is_new = '{kind}') AS DOUBLE) / "
            f"nullif(sum(total_session_count) FILTER (is_new = '{kind}'), 0){scale}, 0), 6)")


def total_of(kind: str, part: str) -> str:
    return f"CAST(coalesce(sum({part}) FILTER (is_new = '{kind}'), 0) AS DOUBLE)"


def type_row(name: str, fn) -> str:
    return f"SELECT '{name}' AS indicator, {fn('1')} AS new_visitor, {fn('0')} AS old_visitor FROM traffic"


BUYER_CTES = (PAYERS.replace("days AS", "pdays AS").replace("FROM days", "FROM pdays").replace("ranked AS", "pranked AS")
              .replace("FROM ranked", "FROM pranked").replace(" out AS", " a9 AS"))
ORDER_CTES = buyers("kept", "order_uv_count", "new_order_user_count").replace(" out AS", " a8 AS")
PAGE_CTES = PAGE_VIEWS[len(EV) + 2:]
CART_CTES = CART[len(EV) + 2:]

ORACLES |= {
    "r1_uv_by_source": by_source("CAST(sum(uv_count) AS BIGINT)", "uv_count"),
    "r2_sessions_by_source": by_source("CAST(sum(total_session_count) AS BIGINT)", "total_session_count"),
    "r3_pages_per_session_by_source": by_source(share("page_view_count", "total_session_count"), "pv_per_session"),
    "r4_time_per_session_by_source": by_source(share("total_during_time", "total_session_count"), "dur_per_session"),
    "r5_bounce_rate_by_source": by_source(share("jump_session_count", "total_session_count"), "jump_rate"),
    "r6_visitors_by_hour": by_hour(""),
    "r6_visitors_by_hour_of_day": by_hour("WHERE CAST(w AS DATE) = DATE '2024-01-15'"),
    "r7_visitors_by_type": f"WITH {TRAFFIC} " + " UNION ALL ".join([
        type_row("uv_count", lambda k: total_of(k, "uv_count")),
        type_row("page_view_count", lambda k: total_of(k, "page_view_count")),
        type_row("jump_rate", lambda k: ratio_of(k, "jump_session_count")),
        type_row("avg_during_sec", lambda k: ratio_of(k, "total_during_time", " / 1000")),
        type_row("avg_page_count", lambda k: ratio_of(k, "page_view_count")),
    ]),
    "r8_keyword_scores": f"WITH {KEYWORDS} SELECT keyword, CAST(sum(keyword_count * 10) AS BIGINT) AS keyword_score FROM a2 GROUP BY 1 ORDER BY 2 DESC, 1",
    "r9_user_changes": totals(f"{LOGIN_DAYS}, {REGISTERS}", USER_ROWS, "type", "user_count"),
    "r9_user_changes_of_day": totals(f"{LOGIN_DAYS}, {REGISTERS}", USER_ROWS, "type", "user_count", "WHERE CAST(w AS DATE) = DATE '2024-01-15'"),
    "r10_funnel": totals(f"{BUYER_CTES}, {ORDER_CTES}, {PAGE_CTES}, {CART_CTES}", [
        ("home", "a3", "home_uv_count"), ("list_uv", "a3", "list_uv_count"), ("detail_uv", "a3", "detail_uv_count"),
        ("cart", "a7", "cart_add_uv_count"), ("trade", "a8", "order_uv_count"), ("payment", "a9", "pay_suc_uv_count"),
    ], "page_id", "uv_count"),
    "r11_new_buyers": totals(f"{BUYER_CTES}, {ORDER_CTES}", [
        ("order", "a8", "new_order_user_count"), ("payment", "a9", "pay_suc_new_user_count"),
    ], "trade_type", "user_count"),
    "r12_trade_by_source": f"""WITH {SOURCES} SELECT source_id, source_name, CAST(sum(amt) AS DOUBLE) AS order_total_amount, {big('order_uu_count', 'order_uu_count')}, {big('order_count', 'order_count')}
        FROM a11 GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 10""",
    "r13_amount_by_province": f"WITH {PROVINCES} SELECT province_id, province_name, CAST(sum(amt) AS DOUBLE) AS order_total_amount FROM a10 GROUP BY 1, 2",
    "r13_amount_by_province_of_day": f"WITH {PROVINCES} SELECT province_id, province_name, CAST(sum(amt) AS DOUBLE) AS order_total_amount FROM a10 WHERE CAST(w AS DATE) = DATE '1998-03-02' GROUP BY 1, 2",
    "r14_buyers_by_province": f"WITH {PROVINCES} SELECT province_id, province_name, {big('order_uu_count', 'order_uu_count')} FROM a10 GROUP BY 1, 2",
    "r15_orders_by_province": f"WITH {PROVINCES} SELECT province_id, province_name, {big('order_count', 'order_count')} FROM a10 GROUP BY 1, 2",
    "r16_total_amount": f"WITH {PROVINCES} SELECT CAST(sum(amt) AS DOUBLE) AS order_total_amount FROM a10",
    "r17_total_orders": f"WITH {PROVINCES} SELECT {big('order_count', 'order_count')} FROM a10",
    "r18_amount_by_course": f"WITH {COURSES} SELECT course_id, course_name, CAST(sum(amt) AS DOUBLE) AS order_total_amount FROM a12 GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 10",
    "r19_amount_by_subject": f"WITH {COURSES} SELECT subject_id, subject_name, CAST(sum(amt) AS DOUBLE) AS order_total_amount FROM a12 GROUP BY 1, 2 ORDER BY 3 DESC, 1",
    "r20_amount_by_category": f"WITH {COURSES} SELECT category_id, category_name, CAST(sum(amt) AS DOUBLE) AS order_total_amount FROM a12 GROUP BY 1, 2 ORDER BY 3 DESC, 1",
    "r21_reviews_by_course": f"""WITH {REVIEWS} SELECT course_id, course_name, {big('review_total_stars', 'review_total_stars')}, {big('review_user_count', 'review_user_count')}, {big('good_review_user_count', 'good_review_user_count')},
        {share('review_total_stars', 'review_user_count')} AS avg_stars, {share('good_review_user_count', 'review_user_count')} AS good_review_rate FROM a16 GROUP BY 1, 2 ORDER BY 5 DESC, 1 LIMIT 10""",
    "r22_exams_by_paper": f"""WITH {EXAMS} SELECT paper_id, paper_title, {big('exam_taken_count', 'exam_taken_count')}, {share('exam_total_score', 'exam_taken_count')} AS exam_avg_score,
        {share('exam_total_during_sec', 'exam_taken_count')} AS exam_avg_sec FROM a13 GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 10""",
    "r23_exams_by_course": f"""WITH {EXAMS} SELECT course_id, course_name, {big('exam_taken_count', 'exam_taken_count')}, {share('exam_total_score', 'exam_taken_count')} AS exam_avg_score,
        {share('exam_total_during_sec', 'exam_taken_count')} AS exam_avg_sec FROM a13 GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 10""",
    "r24_score_distribution": f"WITH {SCORES} SELECT score_duration, {big('user_count', 'exam_taken_count')} FROM a14 GROUP BY 1 ORDER BY 1",
    "r25_questions_by_accuracy": f"""WITH {ANSWERS} SELECT question_id, {big('correct_answer_count', 'correct_answer_count')}, {big('answer_count', 'answer_count')}, {share('correct_answer_count', 'answer_count')} AS accuracy_rate,
        substring(md5(max(p_name)), 1, 10) AS question_digest FROM a15 GROUP BY question_id ORDER BY CAST(sum(a15.correct_answer_count) AS DOUBLE) / sum(a15.answer_count) DESC, 1 LIMIT 10""",
    "r26_chapters": f"""WITH {CHAPTERS} SELECT coalesce(chapter_name, '-') AS chapter_name, {big('play_count', 'play_count')}, {big('play_total_sec', 'play_total_sec')}, {big('play_uu_count', 'play_uu_count')},
        {share('play_total_sec', 'play_uu_count')} AS sec_per_user FROM (SELECT nullif(chapter_name, '-') AS chapter_name, play_count, play_total_sec, play_uu_count FROM a6) a6x GROUP BY a6x.chapter_name ORDER BY 3 DESC, 2 DESC, 4 DESC, 1 LIMIT 10""",
}


# --- streams: the batch answer, without what the watermark has not reached -------------------------

CLOSED_SESSION = "last_ts + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 5 SECOND FROM plays)"


def closed(window: str, width: str, source: str, late: str) -> str:
    return f"{window} + INTERVAL {width} <= (SELECT max(ts) - INTERVAL {late} FROM {source})"


def arrivals(source: str) -> str:
    """The micro-batch ``part`` of each row: a third of the time, one later for every seventeenth row."""
    return f"""span AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM {source}), parts AS (
  SELECT s.*, CAST(least(2, floor(CAST((epoch_us(ts) - lo) * 3 AS DOUBLE) / CAST(hi - lo + 1 AS DOUBLE))) AS BIGINT)
    + CASE WHEN log_id % 17 = 0 THEN 1 ELSE 0 END AS part FROM {source} s, span)"""


def flags(source: str) -> str:
    """Flags by the earliest row of the first micro-batch that has the device."""
    return f"""ft AS (SELECT *, first_value(d - CASE WHEN is_new = '1' THEN 0 ELSE 1 END) OVER (PARTITION BY mid ORDER BY part, ts, log_id) AS first_day
  FROM {source}), flagged AS (SELECT * REPLACE (CASE WHEN is_new = '1' AND first_day <> d THEN '0' ELSE is_new END AS is_new) FROM ft)"""


def daily(where: str, keys: str) -> str:
    """The first row to arrive of each key and day, unless a later day of the key came in an earlier micro-batch."""
    same = " AND ".join(f"e2.{k} = f.{k}" for k in keys.split(", "))
    return f"""e AS (SELECT * FROM parts WHERE {where}), f AS (
  SELECT *, row_number() OVER (PARTITION BY {keys}, d ORDER BY part, ts, log_id) AS rn FROM e), k AS (
  SELECT f.*, (SELECT max(e2.d) FROM e e2 WHERE {same} AND e2.part < f.part) AS before FROM f WHERE rn = 1), kept AS (
  SELECT * FROM k WHERE before IS NULL OR d > before)"""


def marks(source: str, late: str) -> str:
    """The watermark that each micro-batch starts with; the last one has no rows."""
    return f"""wm AS (SELECT b, (SELECT max(ts) - INTERVAL {late} FROM {source} WHERE part < b) AS mark FROM (SELECT unnest(range(0, 6)) AS b))"""


LAYERS = {
    "error": "event_type = 'error'", "start": "event_type = 'signup'", "video": "event_type = 'view'",
    "page": "event_type IN ('click', 'purchase', 'error')",
}

ORACLES |= {
    "stream_t1_new_visitor_repair": f"WITH {EV}, {arrivals('ev')}, {flags('parts')} SELECT log_id, mid, is_new FROM flagged",
    "stream_t2_daily_unique_visitor": f"""WITH {PAGES}, {arrivals('pages')}, {daily('last_page_id IS NULL', 'mid')}
        SELECT mid, log_id, page_id, strftime(ts, {MICROS}) AS ts FROM kept""",
    "stream_t3_unique_visitor_per_page": f"""WITH {EV}, {arrivals('ev')}, {daily("page_id IN ('home', 'course_list', 'course_detail')", 'mid, page_id')}
        SELECT mid, page_id, log_id FROM kept""",
    "stream_t4_bounces": ORACLES["t4_bounces"] + " WHERE nts IS NOT NULL OR ts + INTERVAL 3 HOUR <= (SELECT max(ts) - INTERVAL 15 SECOND FROM pages)",
    "stream_t5_first_logins": f"""WITH {EV}, {arrivals('ev')}, l AS (SELECT * FROM parts WHERE uid IS NOT NULL), {marks('l', '5 SECOND')}, z AS (
        SELECT mid, d, part AS p0, ts AS ts0 FROM (SELECT *, row_number() OVER (PARTITION BY mid, d ORDER BY part, ts, log_id) AS rn FROM l) WHERE rn = 1), s AS (
        SELECT z.*, (SELECT min(b) FROM wm WHERE b >= p0 AND mark >= ts0 + INTERVAL 10 SECOND) AS sent FROM z), r AS (
        SELECT l.*, row_number() OVER (PARTITION BY l.mid, l.d ORDER BY l.ts, l.log_id) AS rn FROM l JOIN s ON l.mid = s.mid AND l.d = s.d AND l.part <= s.sent)
        SELECT mid, uid, log_id, strftime(ts, {MICROS}) AS ts FROM r WHERE rn = 1""",
    "stream_p15_log_split": f"WITH {EV}, {arrivals('ev')}, lines AS (SELECT * FROM parts WHERE k % 10 <> 0), {flags('lines')} " + " UNION ALL ".join(
        f"SELECT '{layer}' AS layer, CAST({times} * count(*) AS BIGINT) AS line_count, CAST({times if layer != 'error' else 0} * count(*) FILTER (is_new = '1') AS BIGINT) AS new_count FROM flagged WHERE {which}"
        for layer, which, times in [*((n, w, 1) for n, w in LAYERS.items()), ("display", "event_type = 'click'", 2), ("action", "event_type = 'click'", 1)]
    ) + " UNION ALL SELECT 'dirty', CAST(count(*) AS BIGINT), CAST(0 AS BIGINT) FROM parts WHERE k % 10 = 0",
    "stream_t15_kept_days": f"""WITH {EV}, b AS (SELECT mid, d, ts FROM ev WHERE event_type = 'purchase')
        SELECT mid, strftime(max(d), '%Y-%m-%d') AS last_day, epoch_ms(max(d) + INTERVAL 2 DAY) > (SELECT epoch_ms(max(ts)) - 5000 FROM b) AS kept FROM b GROUP BY mid""",
    "stream_t7_login_returns": f"WITH {login_days(DUE_LOGIN)} SELECT user_id, strftime(ts, {MICROS}) AS ts, CAST(1 AS BIGINT) AS uv_count, CAST(back AS BIGINT) AS back_count FROM lgaps",
    "stream_t9_buyer_days": f"""WITH {EV}, b AS (SELECT mid AS user_id, d, ts FROM ev WHERE event_type = 'purchase'), {buyers('b', 'uv', 'nw')}
        SELECT user_id, strftime(ts, {MICROS}) AS ts, CAST(1 AS BIGINT) AS uv_count, CAST(CASE WHEN rn = 1 THEN 1 ELSE 0 END AS BIGINT) AS new_count FROM ranked""",
    # rows are lost if their window lies behind the watermark of the micro-batch before theirs
    "stream_w5_keyed_tumbling_window": f"""WITH {EV}, {arrivals('ev')}, {marks('parts', '5 SECOND')}, x AS (
        SELECT *, time_bucket(INTERVAL 10 MINUTE, ts) AS w FROM parts), o AS (
        SELECT w, page_id, CAST(count(*) AS BIGINT) AS views, CAST(sum(during_time) AS BIGINT) AS during_time FROM x
        WHERE NOT coalesce(w + INTERVAL 10 MINUTE <= (SELECT mark FROM wm WHERE b = x.part - 1), FALSE) GROUP BY 1, 2)
        SELECT {bounds('w', '10 MINUTE')}, * EXCLUDE (w) FROM o WHERE """ + closed("w", "10 MINUTE", "ev", "5 SECOND"),
    "stream_a0_play_sessions": f"""WITH {PLAYS}, g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 21600000000 THEN 0 ELSE 1 END AS s FROM plays WINDOW w AS (PARTITION BY sid ORDER BY ts, log_id)),
        n AS (SELECT *, sum(s) OVER (PARTITION BY sid ORDER BY ts, log_id) AS no FROM g)
        SELECT sid, arg_min(video_id, ts) AS video_id, CAST(sum(play_sec) AS BIGINT) AS play_sec, arg_max(position_sec, ts) AS position_sec,
        strftime(min(ts), {MICROS}) AS ts FROM n GROUP BY sid, no HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 5 SECOND FROM plays)""",
    "stream_a2_keyword_window": ORACLES["a2_keyword_window"] + " WHERE " + closed("w", HOUR, "hits", "3 SECOND"),
    "stream_a3_page_view_window": ORACLES["a3_page_view_window"] + " WHERE " + closed("w", HOUR, "(SELECT ts FROM ev WHERE page_id IN ('home', 'course_list', 'course_detail'))", "5 SECOND"),
    "stream_a4_user_login_window": f"WITH {login_days(DUE_LOGIN)} SELECT {bounds('w', HOUR)}, * EXCLUDE (w) FROM a4 WHERE " + closed("w", HOUR, "ldays", "5 SECOND"),
    "stream_a1_traffic_window": f"WITH {TRAFFIC} SELECT {bounds('w', HOUR)}, * EXCLUDE (w) FROM traffic WHERE " + closed("w", HOUR, "measures", "10805 SECOND"),
    "stream_a6_video_play_window": f"WITH {chapters(CLOSED_SESSION)} SELECT {bounds('w', HOUR)}, video_id, CAST(pc AS BIGINT) AS play_count, CAST(ps AS BIGINT) AS play_total_sec, CAST(pu AS BIGINT) AS play_uu_count FROM pv WHERE " + closed("w", HOUR, "rankedp", "5 SECOND"),
    "stream_a7_cart_add_window": ORACLES["a7_cart_add_window"] + " WHERE " + closed("w", HOUR, "(SELECT ts FROM ev WHERE event_type = 'purchase')", "5 SECOND"),
    "stream_a10_province_order_window": f"WITH {PROVINCES} SELECT {bounds('w', TEN)}, province_id, order_total_amount, order_uu_count, order_count FROM a10 WHERE " + closed("w", TEN, "ord", "5 SECOND"),
    "stream_a13_paper_exam_window": f"WITH {EXAMS} SELECT {bounds('w', TEN)}, paper_id, exam_taken_count, exam_total_score, exam_total_during_sec FROM a13 WHERE "
        + "w + INTERVAL 10 SECOND <= (SELECT max(l_shipdate) - INTERVAL 5 SECOND FROM lineitem)",
    "stream_a14_paper_score_window": ORACLES["a14_paper_score_window"] + " WHERE w + INTERVAL 10 SECOND <= (SELECT max(l_shipdate) - INTERVAL 5 SECOND FROM lineitem)",
    "stream_a15_question_answer_window": f"WITH {ANSWERS} SELECT {bounds('w', HOUR)}, question_id, correct_answer_count, answer_count FROM a15 WHERE " + closed("w", HOUR, "ev", "5 SECOND"),
    "stream_a16_course_review_window": ORACLES["a16_course_review_window"] + " WHERE w + INTERVAL 10 SECOND <= (SELECT max(l_shipdate) - INTERVAL 5 SECOND FROM lineitem)",
    "stream_j3_bounded_join": """SELECT c.user_id, c.event_id AS click_id, b.event_id AS buy_id FROM events c JOIN events b ON c.user_id = b.user_id
        AND b.ts BETWEEN c.ts AND c.ts + INTERVAL 2 HOUR WHERE c.event_type = 'click' AND b.event_type = 'purchase'""",
}

# --- sinks -----------------------------------------------------------------------------------------

ORACLES |= {
    "k1_message_values": f"""WITH {CHANGES} SELECT 'dwd_trade_cart_add' AS topic, '{{"data":{{"user_id":"' || user_id || '"}},"ts":"' || ts || '"}}' AS value
        FROM changes WHERE tab = 'cart_info'""",
    "k2_messages_by_topic": f"""WITH {CHANGES} SELECT CASE WHEN tab = 'cart_info' THEN 'dwd_trade_cart_add' WHEN type = 'insert' THEN 'dwd_trade_order_head' ELSE 'dwd_trade_order_change' END AS topic,
        CAST(count(*) AS BIGINT) AS message_count FROM changes WHERE tab IN ('cart_info', 'order_info') GROUP BY 1""",
    "k3_upsert_messages": f"""WITH {DET}, f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_op_ts DESC, final_amount DESC) AS rn FROM det)
        SELECT id, strftime(row_op_ts, {MICROS}) AS row_op_ts, CAST(final_amount AS DOUBLE) AS final_amount FROM f WHERE rn = 1""",
    "k4_dimension_upsert": """SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_acctbal > 5000 THEN s_name || ' v2' ELSE s_name END AS course_name,
        CAST(s_nationkey AS VARCHAR) AS subject_id FROM supplier""",
    "k5_dimension_columns": "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation",
    "k6_k7_stored_window_table": ORACLES["r13_amount_by_province_of_day"],
    "k8_dead_letters": ORACLES["p1_dirty_records"],
}

# --- live routing ----------------------------------------------------------------------------------

_START = [("r", *r, None) for r in LIVE_ROUTES]
_LISTED = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in [*_START, *LIVE_CHANGES])
_TABLES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TABLE_OF_EVENT.items())
LIVE = f"""{EV}, span AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM ev), cfg AS (
  SELECT op, tab, type, sink, cols, coalesce(lo + (hi - lo) * part // 100, -1) AS since, CASE op WHEN 'd' THEN 2 WHEN 'u' THEN 1 ELSE 0 END AS stage
  FROM (VALUES {_LISTED}) AS c(op, tab, type, sink, cols, part), span), spans AS (
  SELECT *, lead(since) OVER (PARTITION BY tab, type ORDER BY since, stage) AS until FROM cfg), rows_ AS (
  SELECT CASE event_type {_TABLES} END AS tab, CASE WHEN log_id % 5 = 0 THEN 'update' ELSE 'insert' END AS type,
    CAST(log_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id, CAST(k AS VARCHAR) AS number, ts FROM ev), routed AS (
  SELECT s.sink AS sink_table, r.type AS _op, r.ts, {', '.join(f"CASE WHEN list_contains(string_split(cols, ','), '{c}') THEN coalesce(r.{c}, '-') ELSE '-' END AS {c}" for c in ('id', 'user_id', 'number'))}
  FROM rows_ r JOIN spans s ON r.tab = s.tab AND r.type = s.type AND s.op <> 'd' AND epoch_us(r.ts) >= s.since AND (s.until IS NULL OR epoch_us(r.ts) < s.until))"""
ROUTED = f"WITH {LIVE} SELECT sink_table, _op, id, user_id, number, strftime(ts, {MICROS}) AS ts FROM routed"

ORACLES |= {
    "j5_routing_by_time": ROUTED,
    # a fact goes out when the clock has passed its hour
    "stream_j5_live_routing": ROUTED + " WHERE (epoch_us(ts) + 3599999999) // 3600000000 * 3600000000 <= (SELECT (hi - 5000000) // 1000 * 1000 FROM span)",
}

# --- changelogs --------------------------------------------------------------------------------------

ORACLES |= {
    "stream_j2_order_sources": f"""WITH {EV}, {ORD}, src AS (SELECT sid AS session_id, arg_max(sc, ts) AS source_id FROM ev WHERE page_id = 'order' GROUP BY sid)
        SELECT ord.id, user_id AS session_id, CAST(final_amount AS DOUBLE) AS final_amount, strftime(ts, {MICROS}) AS ts, coalesce(source_id, '-') AS source_id
        FROM ord LEFT JOIN src ON user_id = session_id""",
    # a session's orders of earlier micro-batches change when a later one brings a later page
    "stream_k3_upsert_messages": f"""WITH {EV}, {arrivals('ev')}, pages AS (SELECT sid, part, max(ts) AS ts FROM parts WHERE page_id = 'order' GROUP BY 1, 2), turns AS (
        SELECT sid, part FROM (SELECT *, max(ts) OVER (PARTITION BY sid ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM pages) WHERE before IS NULL OR ts > before), ospan AS (
        SELECT min(epoch_us(o_orderdate)) AS olo, max(epoch_us(o_orderdate)) AS ohi FROM orders), heads AS (
        SELECT CAST(o_custkey AS VARCHAR) AS sid, CAST(least(2, floor(CAST((epoch_us(o_orderdate) - olo) * 3 AS DOUBLE) / CAST(ohi - olo + 1 AS DOUBLE))) AS BIGINT) AS part FROM orders, ospan), changed AS (
        SELECT count(*) AS n FROM heads h JOIN turns t ON h.sid = t.sid AND t.part > h.part)
        SELECT '+I' AS kind, count(*) AS message_count, count(*) AS value_count FROM orders
        UNION ALL SELECT '-U', n, 0 FROM changed WHERE n > 0 UNION ALL SELECT '+U', n, n FROM changed WHERE n > 0
        UNION ALL SELECT 'in force', count(*), count(*) FROM orders""",
    "stream_j4_registrations": ORACLES["j4_registrations"],
}

# --- segmentation ------------------------------------------------------------------------------------

def _edge(n: int) -> str:
    return f"{{'c': CASE WHEN i + 1 >= {n} THEN cs[{n}] + d{n}.cost END, 'p': ps[{n}] || '|' || d{n}.dw || '|'}}"


ORACLES |= {
    # the best path to each place of every word, from the best paths to the four places before
    "f1_segmented_keywords": r"""WITH RECURSIVE w AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM documents) GROUP BY 1),
        t AS MATERIALIZED (SELECT length(bin(CAST(sum(n) AS BIGINT))) AS bits FROM w),
        dict AS MATERIALIZED (SELECT word AS dw, bits - length(bin(n)) + 1 AS cost FROM w, t WHERE length(word) BETWEEN 2 AND 4 AND n >= 8),
        steps AS (SELECT word, n, bits, 0 AS i, [CAST(0 AS BIGINT)] AS cs, [''] AS ps FROM w, t
        UNION ALL SELECT word, n, bits, i + 1, list_concat([b.c], cs)[1:4], list_concat([b.p], ps)[1:4] FROM (
          SELECT s.*, list_sort(list_filter([{'c': cs[1] + bits + 1, 'p': ps[1] || substr(word, i + 1, 1)}, EDGE2, EDGE3, EDGE4], lambda x: x.c IS NOT NULL))[1] AS b
          FROM steps s LEFT JOIN dict d2 ON d2.dw = substr(word, i, 2) AND i >= 1 LEFT JOIN dict d3 ON d3.dw = substr(word, i - 1, 3) AND i >= 2 LEFT JOIN dict d4 ON d4.dw = substr(word, i - 2, 4) AND i >= 3
          WHERE i < length(word)))
        SELECT keyword, CAST(sum(n) AS BIGINT) AS keyword_count FROM (SELECT unnest(string_split(ps[1], '|')) AS keyword, n FROM steps WHERE i = length(word)) WHERE keyword <> '' GROUP BY 1"""
    .replace("EDGE2", _edge(2)).replace("EDGE3", _edge(3)).replace("EDGE4", _edge(4)),
}

# --- the order path as streams -----------------------------------------------------------------------


def compacted(rows: str, key: str, hold: str, best: str, name: str = "kept") -> str:
    """``rows`` (with ts the version and log_id) in micro-batches: of each key the greatest version that has arrived when
    the watermark is ``hold`` past the earliest one of its first micro-batch."""
    return f"""{arrivals(rows)}, {marks('parts', '5 SECOND')}, zero AS (
  SELECT p.{key}, p0, min(ts) AS ts0 FROM parts p JOIN (SELECT {key}, min(part) AS p0 FROM parts GROUP BY 1) f ON p.{key} = f.{key} AND part = p0 GROUP BY 1, 2), sent AS (
  SELECT *, (SELECT min(b) FROM wm WHERE b >= p0 AND mark >= ts0 + INTERVAL {hold}) AS sent FROM zero), {name} AS (
  SELECT * RENAME (ts AS row_op_ts, event AS ts), CAST(event AS DATE) AS d FROM (
    SELECT p.*, row_number() OVER (PARTITION BY p.{key} ORDER BY {best}) AS rn FROM parts p JOIN sent s ON p.{key} = s.{key} AND p.part <= s.sent) WHERE rn = 1)"""


_VERSIONS = "SELECT id, course_id, order_id, final_amount, user_id, {source} ts AS event, row_op_ts AS ts, CAST(order_id AS BIGINT) AS log_id FROM {rows}"
_BEST = "ts DESC, course_id DESC, final_amount DESC"
STREAM_FACTS = FACTS[:FACTS.index(", kept AS (")] + ", versions AS (" + _VERSIONS.format(source="source_id,", rows="facts") + "), " + compacted("versions", "id", "30 DAY", _BEST)
STREAM_PAID = PAID + ", versions AS (" + _VERSIONS.format(source="", rows="paid") + "), " + compacted("versions", "id", "30 DAY", _BEST, "pkept")
STREAM_COURSES = STREAM_FACTS + """, cw AS (SELECT time_bucket(INTERVAL 10 SECOND, ts) AS w, course_id, sum(final_amount) AS amt FROM kept GROUP BY 1, 2)"""
STREAM_REGISTERS = f"""{EV}, versions AS (SELECT mid AS user_id, ts AS event, ts, user_id AS log_id FROM ev WHERE event_type = 'signup'), {compacted('versions', 'user_id', '1 DAY', 'ts DESC')}, a5 AS (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, CAST(count(*) AS BIGINT) AS register_count FROM kept GROUP BY 1)"""

ORACLES |= {
    "stream_a5_user_register_window": f"WITH {STREAM_REGISTERS} SELECT {bounds('w', HOUR)}, register_count FROM a5 WHERE " + closed("w", HOUR, "kept", "5 SECOND"),
    "stream_a8_order_buyer_window": f"WITH {STREAM_FACTS}, {buyers('kept', 'order_uv_count', 'new_order_user_count')} SELECT {bounds('w', TEN)}, * EXCLUDE (w) FROM out WHERE " + closed("w", TEN, "kept", "5 SECOND"),
    "stream_a9_payer_window": f"WITH {STREAM_PAID}, {buyers('pkept', 'pay_suc_uv_count', 'pay_suc_new_user_count')} SELECT {bounds('w', TEN)}, * EXCLUDE (w) FROM out WHERE " + closed("w", TEN, "pkept", "5 SECOND"),
    "stream_a11_source_order_window": f"WITH {SOURCES.replace(FACTS, STREAM_FACTS)} SELECT {bounds('w', TEN)}, source_id, order_total_amount, order_uu_count, order_count FROM a11 WHERE "
        + closed("w", TEN, "kept WHERE source_id IS NOT NULL", "5 SECOND"),
    "stream_a12_course_order_window": f"WITH {STREAM_COURSES} SELECT {bounds('w', TEN)}, course_id, CAST(amt AS DOUBLE) AS order_total_amount FROM cw WHERE " + closed("w", TEN, "kept", "5 SECOND"),
}
