"""The driver's queries over its tables, through the engine, and the SQL that gives the same rows.

``events`` are bound as packets: ``pur_value`` is there on purchases only, ``nan_value`` is NaN on each tenth, ``ui_port`` occurs twice on
clicks and views and never else.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake import capture_queries
from wirelake.binding import Query, query_over
from wirelake.expr import FieldRef
from wirelake.ftypes import from_text, interval_text
from wirelake.operators import annotations as notes
from wirelake.operators import keysets
from wirelake.operators.rollup import duration, first_occurrence, rolled
from wirelake.scratch import scratch_folder
from wirelake.sources import ek_json, fields_text
from wirelake.sources.capture import Dumped, with_values
from wirelake.workspace import Workspace

USER = FieldRef("user", "FT_INT64")
TYPE = FieldRef("type")
PUR = FieldRef("pur.value", "FT_DOUBLE")
NAN = FieldRef("nan.value", "FT_DOUBLE")
PORT = FieldRef("ui.port", "FT_INT64", True)
PROPS = FieldRef("props")
TIME = FieldRef("frame.time", "FT_ABSOLUTE_TIME")
_EVENTS = (
    (USER, "user_id"), (TYPE, "event_type"), (PROPS, "props"),
    (PUR, "CASE WHEN event_type = 'purchase' THEN value END"),
    (NAN, "CASE WHEN event_id % 10 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END"),
    (PORT, "CASE WHEN event_type IN ('click', 'view') THEN array(user_id, event_id % 1000) ELSE CAST(array() AS ARRAY<BIGINT>) END"),
)
_EV = "WITH ev AS (SELECT event_id AS frame_number, ts AS frame_time, user_id, event_type, props, CASE WHEN event_type='purchase' THEN value END AS pur_value, CASE WHEN event_id % 10 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS nan_value, CASE WHEN event_type IN ('click','view') THEN [user_id, event_id % 1000] ELSE CAST([] AS BIGINT[]) END AS ui_port FROM events) "
PairOf = tuple[Callable[[SparkSession, str], DataFrame], str]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> Query:
    df = _table(spark, sf, "events").withColumnsRenamed({"event_id": "frame_number", "ts": "frame_time"})
    return query_over(df, "frame_number", "frame_time", [(r, x.replace("event_id", "frame_number")) for r, x in _EVENTS])


def _ev(term, *select: FieldRef, keep: tuple[str, ...] = ("frame_number",)) -> Callable:
    return lambda spark, sf: events(spark, sf).filter(*([] if term is None else [term])).select(*select).dataframe(ordered=False).select(*keep)


def _over(table: str, key: str, fields: tuple, term) -> Callable:
    return lambda spark, sf: query_over(_table(spark, sf, table), key, None, fields).filter(term).select().dataframe(ordered=False)


TEXT, URL, NAME = FieldRef("text"), FieldRef("url"), FieldRef("name")
WORDS = FieldRef("words", "FT_STRING", True)
EMBEDDING = FieldRef("embedding", "FT_FLOAT", True)
_WORDS = ((WORDS, "split(p_name, ' ')"),)


def _lowest_purchase(spark: SparkSession, sf: str) -> DataFrame:
    least = events(spark, sf).select(PUR).dataframe(False).agg(F.min("pur_value")).first()[0]
    return events(spark, sf).filter(PUR != least).select(PUR).dataframe(False).select("frame_number", "pur_value")


def _first_port(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(PORT).dataframe(False).select("frame_number", first_occurrence(F.col("ui_port")).alias("first_port"))


def _streams(spark: SparkSession, sf: str) -> DataFrame:
    ev = events(spark, sf).filter(TYPE != "error").select(USER, TYPE, PUR, PROPS).dataframe(False)
    each = ev.select(F.col("user").alias("stream_id"), F.when(F.col("type").isin("click", "view"), "tcp").otherwise("udp").alias("protocol"), F.col("pur_value").alias("src_value"), F.col("type").alias("src_type"), "frame_number", "frame_time", F.length("props").cast("long").alias("size"))
    return rolled(each, ["stream_id", "protocol"], ("src_value", "src_type"), "frame_number", "frame_time", "size")


def _durations(spark: SparkSession, sf: str) -> DataFrame:
    ev = events(spark, sf).select(USER).dataframe(False).groupBy(F.col("user").alias("user_id")).agg(F.min("frame_time").alias("a"), F.max("frame_time").alias("b"))
    micros = F.timestamp_diff("MICROSECOND", F.col("a").cast("timestamp"), F.col("b").cast("timestamp"))
    return ev.select("user_id", micros.alias("duration_us"))


def _interval_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Aggregates of intervals, without a detour through numbers."""
    ev = events(spark, sf).select(USER).dataframe(False).groupBy("user").agg(F.min("frame_time").alias("a"), F.max("frame_time").alias("b"))
    d = ev.select(duration(F.col("a"), F.col("b")).alias("d")).agg(F.max("d").alias("most"), F.min("d").alias("least"), F.sum("d").alias("total"))
    return d.select(interval_text(F.col("most")).alias("most"), interval_text(F.col("least")).alias("least"), interval_text(F.col("total")).alias("total"))


def _interval_sql() -> str:
    def text(us: str) -> str:
        day = f"CASE WHEN {us} // 86400000000 = 0 THEN '' WHEN {us} // 86400000000 = 1 THEN '1 day ' ELSE ({us} // 86400000000) || ' days ' END"
        two = lambda x: f"lpad(CAST({x} AS VARCHAR), 2, '0')"
        clock = " || ':' || ".join((two(f"{us} % 86400000000 // 3600000000"), two(f"{us} // 60000000 % 60"), two(f"{us} // 1000000 % 60")))
        return f"{day} || {clock} || CASE WHEN {us} % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST({us} % 1000000 AS VARCHAR), 6, '0') END"

    return f"WITH d AS (SELECT epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM events GROUP BY user_id), m AS (SELECT max(us) AS a, min(us) AS b, CAST(sum(us) AS BIGINT) AS c FROM d) SELECT {text('a')} AS most, {text('b')} AS least, {text('c')} AS total FROM m"


def _repeated_keys(spark: SparkSession, sf: str) -> DataFrame:
    li = _table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("frame_number"))
    return keysets.duplicates(li, "frame_number", 5).select("frame_number")


def _drift(spark: SparkSession, sf: str) -> DataFrame:
    return keysets.missing(_table(spark, sf, "documents").select("doc_id"), _table(spark, sf, "labels").select("doc_id"), "doc_id", 5)


def _key_equality(spark: SparkSession, sf: str) -> DataFrame:
    """How the key sets of two tables differ, in counts."""
    a, b = (_table(spark, sf, t).select("doc_id") for t in ("documents", "labels"))
    of = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return of(keysets.missing(a, b, "doc_id"), "unseen").crossJoin(of(keysets.missing(b, a, "doc_id"), "unknown")).crossJoin(of(keysets.duplicates(b, "doc_id"), "repeated"))


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    lab = _table(spark, sf, "labels").select(F.lit("packet").alias("scope"), F.col("doc_id").alias("target_id"), F.lit(None).cast("string").alias("protocol"), "quality")
    there = _table(spark, sf, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("frame_number"))
    none = spark.createDataFrame([], "stream_id long, protocol string")
    return notes.orphaned(lab, there, none).select("target_id", "quality", "orphaned")


def _top(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).filter(TYPE == "error").select().dataframe().select("frame_number").limit(20)


def _covered(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "part").select("p_partkey", keysets.covers(F.split("p_name", " "), ["red"]).alias("covered"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a dissector would print them."""
    e = events(spark, sf).select(USER, TYPE, PUR, PORT).dataframe(False)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    micros = F.unix_micros(F.col("frame_time").cast("timestamp"))
    epoch = F.concat(F.floor(micros / 1_000_000).cast("string"), F.lit("."), F.lpad((micros % 1_000_000).cast("string"), 6, "0"), F.lit("000"))
    return e.select(F.concat_ws("\x1f", text("frame_number"), epoch, text("user"), text("type"), text("pur_value"), F.array_join(F.transform("ui_port", lambda x: x.cast("string")), "\x1e")).alias("value"))


_PRINTED = (FieldRef("frame.number", "FT_FRAMENUM"), FieldRef("frame.time_epoch", "FT_ABSOLUTE_TIME"), USER, TYPE, PUR, PORT)


def _typed(raw: DataFrame) -> DataFrame:
    df = with_values(raw, _PRINTED)
    return df.select(F.col("`frame.number`").alias("frame_number"), F.col("`frame.time_epoch`").alias("frame_time"), F.col("user").alias("user_id"), F.col("type").alias("event_type"), F.col("`pur.value`").alias("pur_value"), F.get(F.col("`ui.port`"), F.lit(1)).alias("second_port"))


def _fields_text(spark: SparkSession, sf: str) -> DataFrame:
    return _typed(fields_text.raw_fields(_lines(spark, sf), _PRINTED))


def _ek(spark: SparkSession, sf: str) -> DataFrame:
    cols = fields_text.raw_fields(_lines(spark, sf), _PRINTED)
    flat = lambda n: n.replace(".", "_")
    fields = [F.struct(F.col(f"`{r.name}`").alias(f"{r.name.partition('.')[0]}_{flat(r.name)}")).alias(r.name.partition(".")[0]) for r in _PRINTED[1:]]
    layers = F.struct(F.struct(F.col("`frame.number`").alias("frame_frame_number"), F.col("`frame.time_epoch`").alias("frame_frame_time_epoch")).alias("frame"), *fields[1:])
    return _typed(ek_json.raw_fields(cols.select(F.to_json(F.struct(layers.alias("layers"))).alias("value")), _PRINTED))


_TYPED_SQL = _EV + "SELECT frame_number, frame_time, user_id, event_type, pur_value, ui_port[2] AS second_port FROM ev"


def _workspace(spark: SparkSession, sf: str, first: tuple[FieldRef, ...], then: tuple[FieldRef, ...] = ()) -> Workspace:
    at = scratch_folder(spark, "workspace")
    _lines(spark, sf).write.text(f"{at}-text", lineSep="\n")
    ws = Workspace(spark, at, "rw")
    dump = Dumped(f"{at}-text", _PRINTED)
    ws.materialize(f"{at}-text", first, dissector=dump)
    if then:
        ws.materialize(f"{at}-text", (*first, *then), dissector=dump)
    return ws


def _materialized(spark: SparkSession, sf: str) -> DataFrame:
    return _workspace(spark, sf, (USER, PORT)).query().filter(PORT.in_([(100, 120)])).select(USER).dataframe(False).select("frame_number", "frame_time", F.col("user").alias("user_id"))


def _backfilled(spark: SparkSession, sf: str) -> DataFrame:
    return _workspace(spark, sf, (USER,), (TYPE, PUR)).query().filter(PUR < 20.0).select(TYPE, PUR).dataframe(False).select("frame_number", F.col("type").alias("event_type"), "pur_value")


def _passthrough(spark: SparkSession, sf: str) -> DataFrame:
    return _workspace(spark, sf, (USER, TYPE)).sql("SELECT `type` AS event_type, count(*) AS n, count(DISTINCT user) AS users FROM pkts WHERE user < ? GROUP BY `type`", [100])


def _exported(spark: SparkSession, sf: str) -> DataFrame:
    ws = _workspace(spark, sf, (USER, PORT))
    return spark.read.parquet(ws.export_parquet("pkts", f"{ws.path}-export.parquet")).select("frame_number", "frame_time", F.col("user").alias("user_id"), F.size("ui_port").alias("ports"))


def _parsed_text(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses, hardware addresses, truth values and times from text."""
    k = F.col("c_custkey")
    ip = F.concat_ws(".", F.lit("10"), (k % 256).cast("string"), (F.floor(k / 256) % 256).cast("string"), F.lit("7"))
    mac = F.concat_ws(":", F.lit("02:00:00:00"), F.lpad(F.lower(F.hex(F.floor(k / 256) % 256)), 2, "0"), F.lpad(F.lower(F.hex(k % 256)), 2, "0"))
    c = _table(spark, sf, "customer").select("c_custkey", ip.alias("ip"), mac.alias("mac"), F.concat(F.lit("0x"), F.lower(F.hex(k))).alias("hexed"), (k % 2).cast("string").alias("bit"), F.concat(k.cast("string"), F.lit(".25")).alias("t"))
    return c.select(
        "c_custkey", from_text(F.col("ip"), "FT_IPv4", "ip").alias("address"), F.lower(F.hex(from_text(F.col("mac"), "FT_ETHER", "mac"))).alias("hardware"), from_text(F.col("hexed"), "FT_UINT32", "hexed").alias("number"),
        from_text(F.col("bit"), "FT_BOOLEAN", "bit").alias("odd"), from_text(F.col("t"), "FT_ABSOLUTE_TIME", "t").alias("at"),
    )


_PARSED_SQL = "SELECT c_custkey, 10 * 16777216 + (c_custkey % 256) * 65536 + (c_custkey // 256 % 256) * 256 + 7 AS address, '02000000' || lpad(lower(hex(c_custkey // 256 % 256)), 2, '0') || lpad(lower(hex(c_custkey % 256)), 2, '0') AS hardware, c_custkey AS number, c_custkey % 2 = 1 AS odd, TIMESTAMP '1970-01-01' + to_microseconds(c_custkey * 1000000 + 250000) AS at FROM customer"


def _sql_text(spark: SparkSession, sf: str) -> DataFrame:
    """A query by its own SQL text and parameters."""
    q = events(spark, sf).filter((TYPE == "click") | ~(NAN > 50.0), PORT.present()).select(USER)
    b = q.bind()
    b.df.createOrReplaceTempView("pkts")
    text, args = q.sql()
    return spark.sql(text, args=args).select("frame_number", F.col("user").alias("user_id"))


_ID = "SELECT frame_number FROM ev WHERE "
PAIRS: dict[str, PairOf] = {
    "flt_eq_scalar": (_ev(USER == 7), _EV + _ID + "user_id = 7"),
    "flt_eq_multi": (_ev(PORT == 42), _EV + _ID + "list_contains(ui_port, 42)"),
    "flt_lt_scalar_absent": (_ev(PUR < 20.0), _EV + _ID + "pur_value < 20.0"),
    "flt_le_scalar": (_ev(USER <= 7), _EV + _ID + "user_id <= 7"),
    "flt_ge_time": (_ev(TIME >= datetime(2024, 1, 15)), _EV + _ID + "frame_time >= TIMESTAMP '2024-01-15 00:00:00'"),
    "flt_lt_multi": (_ev(PORT < 10), _EV + _ID + "len(list_filter(ui_port, lambda x: x < 10)) > 0"),
    "flt_le_multi": (_ev(PORT <= 10), _EV + _ID + "len(list_filter(ui_port, lambda x: x <= 10)) > 0"),
    "flt_ge_multi": (_ev(PORT >= 990), _EV + _ID + "len(list_filter(ui_port, lambda x: x >= 990)) > 0"),
    "flt_gt_nan_guard": (_ev(NAN > 50.0), _EV + _ID + "nan_value > 50 AND NOT isnan(nan_value)"),
    "flt_not_gt_nan": (_ev(~(NAN > 50.0)), _EV + _ID + "NOT coalesce(nan_value > 50 AND NOT isnan(nan_value), FALSE)"),
    "flt_nan_literal": (_ev(NAN != float("nan")), _EV + _ID + "TRUE"),
    "flt_ne_scalar_absent": (_lowest_purchase, _EV + "SELECT frame_number, pur_value FROM ev WHERE NOT coalesce(pur_value = (SELECT min(pur_value) FROM ev), FALSE)"),
    "flt_ne_multi": (_ev(PORT != 42), _EV + _ID + "NOT coalesce(list_contains(ui_port, 42), FALSE)"),
    "flt_not_lt_absent": (_ev(~(PUR < 20.0)), _EV + _ID + "NOT coalesce(pur_value < 20.0, FALSE)"),
    "flt_double_neg": (_ev(~~(PUR < 20.0)), _EV + _ID + "NOT (NOT coalesce(pur_value < 20.0, FALSE))"),
    "flt_present_scalar": (_ev(PUR.present()), _EV + _ID + "pur_value IS NOT NULL"),
    "flt_present_multi": (_ev(PORT.present()), _EV + _ID + "len(coalesce(ui_port, [])) > 0"),
    "flt_in_set_range": (_ev(USER.in_([3, (10, 19)])), _EV + _ID + "(user_id = 3 OR user_id BETWEEN 10 AND 19)"),
    "flt_in_range_multi": (_ev(PORT.in_([(100, 120)])), _EV + _ID + "len(list_filter(ui_port, lambda x: x BETWEEN 100 AND 120)) > 0"),
    "flt_not_in": (_ev(~USER.in_([3, range(10, 20)])), _EV + _ID + "NOT coalesce((user_id = 3 OR user_id BETWEEN 10 AND 19), FALSE)"),
    "flt_and_or_not": (_ev(((TYPE == "click") & (USER < 20)) | ~(PUR >= 5.0)), _EV + _ID + "((event_type = 'click' AND user_id < 20) OR NOT coalesce(pur_value >= 5.0, FALSE))"),
    "flt_contains_str": (_over("documents", "doc_id", ((TEXT, "text"),), TEXT.contains("ation")), "SELECT doc_id FROM documents WHERE contains(text, 'ation')"),
    "flt_contains_bytes": (_over("part", "p_partkey", ((FieldRef("raw", "FT_BYTES"), "encode(p_name, 'UTF-8')"),), FieldRef("raw", "FT_BYTES").contains(b"idge")), "SELECT p_partkey FROM part WHERE contains(p_name, 'idge')"),
    "flt_contains_multi": (_over("part", "p_partkey", _WORDS, WORDS.contains("idge")), "SELECT p_partkey FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) WHERE len(list_filter(w, lambda x: contains(x, 'idge'))) > 0"),
    "flt_matches_ascii": (_over("part", "p_partkey", ((NAME, "p_name"),), NAME.matches("^(?:RED|blue) w")), "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^(?:RED|blue) w', 'i')"),
    "flt_not_matches": (_over("pages", "page_id", ((URL, "url"),), ~URL.matches("^https?://m[.][a-z]{2,}")), "SELECT page_id FROM pages WHERE NOT coalesce(regexp_matches(url, '^https?://m[.][a-z]{2,}', 'i'), FALSE)"),
    "flt_matches_multi": (_over("part", "p_partkey", _WORDS, WORDS.matches("^w[a-z]+t$")), "SELECT p_partkey FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) WHERE len(list_filter(w, lambda x: regexp_matches(x, '^w[a-z]+t$', 'i'))) > 0"),
    "flt_matches_deep": (_over("documents", "doc_id", ((TEXT, "text"),), TEXT.matches(r"(?:.|\n){2000}")), "SELECT doc_id FROM documents WHERE strlen(text) >= 2000"),
    "flt_sql_text": (_sql_text, _EV + "SELECT frame_number, user_id FROM ev WHERE (event_type = 'click' OR NOT coalesce(nan_value > 50 AND NOT isnan(nan_value), FALSE)) AND len(ui_port) > 0"),
    "prj_first_occurrence": (_first_port, _EV + "SELECT frame_number, ui_port[1] AS first_port FROM ev"),
    "prj_select_rowkey": (lambda s, d: events(s, d).filter(USER == 7).select(USER, USER).dataframe(False).withColumnRenamed("user", "user_id"), _EV + "SELECT frame_number, frame_time, user_id FROM ev WHERE user_id = 7"),
    "agg_streams": (_streams, _EV + "SELECT user_id AS stream_id, CASE WHEN event_type IN ('click','view') THEN 'tcp' ELSE 'udp' END AS protocol, first(pur_value ORDER BY frame_number) AS src_value, first(event_type ORDER BY frame_number) AS src_type, min(frame_number) AS first_frame, max(frame_number) AS last_frame, count(*) AS pkt_count, CAST(sum(length(props)) AS BIGINT) AS byte_count, min(frame_time) AS first_time, max(frame_time) AS last_time FROM ev WHERE event_type <> 'error' GROUP BY 1, 2"),
    "agg_stream_duration": (_durations, _EV + "SELECT user_id, CAST(epoch_us(max(frame_time)) - epoch_us(min(frame_time)) AS BIGINT) AS duration_us FROM ev GROUP BY 1"),
    "agg_interval": (_interval_mean, _interval_sql()),
    "agg_dup_keys_topk": (_repeated_keys, "SELECT l_orderkey * 10 + l_linenumber AS frame_number FROM lineitem GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 5"),
    "jon_drift_missing": (_drift, "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels s WHERE s.doc_id = d.doc_id) ORDER BY 1 LIMIT 5"),
    "jon_annotation_orphans": (_orphans, "SELECT l.doc_id AS target_id, l.quality, NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'en') AS orphaned FROM labels l"),
    "set_key_equality": (_key_equality, "SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS unseen, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS unknown, (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1)) AS repeated"),
    "srt_top_frames": (_top, _EV + "SELECT frame_number FROM ev WHERE event_type = 'error' ORDER BY frame_number LIMIT 20"),
    "set_list_subset": (_covered, "SELECT p_partkey, list_has_all(string_split(p_name, ' '), ['red']) AS covered FROM part"),
    "multi_float_gt": (_over("embeddings", "vec_id", ((EMBEDDING, "CAST(embedding AS ARRAY<DOUBLE>)"),), EMBEDDING > 0.25), "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.25 AND NOT isnan(x))) > 0"),
    "src_fields_text": (_fields_text, _TYPED_SQL),
    "src_ek_json": (_ek, _TYPED_SQL),
    "fn_text_values": (_parsed_text, _PARSED_SQL),
    "snk_materialize": (_materialized, _EV + "SELECT frame_number, frame_time, user_id FROM ev WHERE len(list_filter(ui_port, lambda x: x BETWEEN 100 AND 120)) > 0"),
    "snk_backfill": (_backfilled, _EV + "SELECT frame_number, event_type, pur_value FROM ev WHERE pur_value < 20.0"),
    "snk_export_parquet": (_exported, _EV + "SELECT frame_number, frame_time, user_id, CAST(len(ui_port) AS INTEGER) AS ports FROM ev"),
    "raw_sql_passthrough": (_passthrough, _EV + "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM ev WHERE user_id < 100 GROUP BY 1"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in (PAIRS | capture_queries.PAIRS).items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in (PAIRS | capture_queries.PAIRS).items()}
