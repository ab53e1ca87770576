"""Schemas of the messages and of the layers between jobs."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, IntegerType, LongType, MapType, StringType, StructField, StructType,
)


def _strings(*names: str) -> list[StructField]:
    return [StructField(n, StringType()) for n in names]


# Field names of the behaviour log. Sub-objects whose fields nobody reads are kept
# as their JSON text.
COMMON = StructType(_strings("mid", "uid", "sid", "is_new", "ar", "ba", "ch", "md", "os", "sc", "vc"))
PAGE = StructType([
    *_strings("page_id", "last_page_id", "item", "item_type"), StructField("during_time", LongType()),
])
APP_VIDEO = StructType([
    StructField("video_id", StringType()), StructField("play_sec", IntegerType()),
    StructField("position_sec", IntegerType()),
])
TOPIC_LOG = StructType([
    StructField("common", COMMON), StructField("page", PAGE), StructField("start", StringType()),
    StructField("appVideo", APP_VIDEO), StructField("displays", ArrayType(StringType())),
    StructField("actions", ArrayType(StringType())), StructField("err", StringType()),
    StructField("ts", LongType()),
])

# The envelope of a database change row.
TOPIC_DB = StructType([
    *_strings("database", "table", "type"), StructField("data", MapType(StringType(), StringType())),
    StructField("ts", StringType()),
])

# Routing configuration rows and their change envelope.
DIM_CONFIG = StructType(_strings("source_table", "sink_table", "sink_columns", "sink_pk", "sink_extend"))
FACT_CONFIG = StructType(_strings("source_table", "source_type", "sink_table", "sink_columns"))


def config_change(config: StructType) -> StructType:
    return StructType([
        StructField("op", StringType()), StructField("before", config), StructField("after", config),
        StructField("ts_ms", LongType()),
    ])


# Map keys of the change rows and the columns they become.
ORDER_DETAIL_FIELDS = {
    "id": "id", "course_id": "course_id", "course_name": "course_name", "order_id": "order_id",
    "user_id": "user_id", "origin_amount": "origin_amount", "coupon_reduce": "coupon_reduce",
    "final_amount": "final_amount", "create_time": "create_time",
}
ORDER_INFO_FIELDS = {
    "id": "id", "out_trade_no": "out_trade_no", "trade_body": "trade_body",
    "session_id": "session_id", "province_id": "province_id",
}
PAYMENT_FIELDS = {
    "id": "id", "order_id": "order_id", "alipay_trade_no": "alipay_trade_no",
    "payment_type": "payment_type", "payment_status": "payment_status",
    "callback_content": "callback_content", "callback_time": "callback_time",
}
PAID = "1602"

# Columns of the log's common part and what the registered-user facts call them.
DEVICE_FIELDS = {
    "user_id": "uid", "channel": "ch", "province_id": "ar", "version_code": "vc", "source_id": "sc",
    "mid_id": "mid", "brand": "ba", "model": "md", "operate_system": "os",
}

# Columns of the window tables, in order; each starts with stt, edt and ends with ts.
WINDOW_TABLES = {
    "dws_traffic_vc_source_ar_is_new_page_view_window": [
        "version_code", "source_id", "source_name", "ar", "province_name", "is_new", "uv_count",
        "total_session_count", "page_view_count", "total_during_time", "jump_session_count"],
    "dws_traffic_source_keyword_page_view_window": ["source", "keyword", "keyword_count"],
    "dws_traffic_page_view_window": ["home_uv_count", "list_uv_count", "detail_uv_count"],
    "dws_user_login_window": ["back_count", "uv_count"],
    "dws_user_register_window": ["register_count"],
    "dws_learn_chapter_play_window": [
        "chapter_id", "chapter_name", "play_count", "play_total_sec", "play_uu_count"],
    "dws_trade_cart_add_window": ["cart_add_uv_count"],
    "dws_trade_order_window": ["order_uv_count", "new_order_user_count"],
    "dws_trade_pay_suc_window": ["pay_suc_uv_count", "pay_suc_new_user_count"],
    "dws_trade_province_order_window": [
        "province_id", "province_name", "order_total_amount", "order_uu_count", "order_count"],
    "dws_trade_source_order_window": [
        "source_id", "source_name", "order_total_amount", "order_uu_count", "order_count"],
    "dws_trade_course_order_window": [
        "course_id", "course_name", "subject_id", "subject_name", "category_id", "category_name",
        "order_total_amount"],
    "dws_examination_paper_exam_window": [
        "paper_id", "paper_title", "course_id", "course_name", "exam_taken_count",
        "exam_total_score", "exam_total_during_sec"],
    "dws_examination_paper_score_duration_exam_window": [
        "paper_id", "paper_title", "score_duration", "user_count"],
    "dws_examination_question_answer_window": [
        "question_id", "question_txt", "correct_answer_count", "answer_count"],
    "dws_interaction_course_review_window": [
        "course_id", "course_name", "review_total_stars", "review_user_count", "good_review_user_count"],
}
