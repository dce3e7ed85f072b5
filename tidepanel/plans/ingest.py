"""Queries for raw payloads, scalar normalisation and text classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel import fixtures as X
from tidepanel.functions import classify as C
from tidepanel.functions import scalars as S
from tidepanel.operators import merge as M
from tidepanel.operators import panel as P
from tidepanel.plans.registry import query, r6
from tidepanel.session import scratch_path
from tidepanel.sources import files as I

# --- raw market objects, made untidy on purpose from the customers that trade ------------------

X.add_cte("raw", """
    SELECT CAST(market_id AS VARCHAR) AS id, 'c' || market_id AS condition_id,
      CASE WHEN market_id % 10 = 0 THEN '' ELSE 'Will ' || family || ' win?' END AS question,
      'Title ' || market_id AS title, CASE WHEN market_id % 3 = 0 THEN '' ELSE family END AS category,
      CASE WHEN market_id % 11 = 0 THEN '["Up","Down"]' WHEN market_id % 7 = 0 THEN '[" YES ","No"]'
           WHEN market_id % 13 = 0 THEN '  ' WHEN market_id % 17 = 0 THEN '{bad' WHEN market_id % 5 = 0 THEN '["No","Yes"]'
           ELSE '["Yes","No"]' END AS outcomes,
      CASE WHEN market_id % 23 = 0 THEN '["1"]' WHEN market_id % 29 = 0 THEN '["1","1"]' WHEN market_id % 31 = 0 THEN '["x","0.995"]'
           WHEN volume >= 7000 THEN '["0.995","0.005"]'
           WHEN volume < 0 THEN '["0.004","0.996"]' ELSE '["0.4","0.6"]' END AS prices,
      CASE WHEN market_id % 19 = 0 THEN '[]' ELSE '["t' || market_id || 'y","t' || market_id || 'n"]' END AS tokens,
      CASE WHEN market_id % 4 = 0 THEN 0.0 ELSE volume END AS volume_num, volume + 1 AS volume,
      CASE WHEN market_id % 6 = 0 THEN NULL ELSE volume * 2 END AS volume_clob,
      family, domain, start_ts, close_ts FROM markets""", ["markets"])
X.add_cte("parsed", """
    SELECT *, CASE WHEN json_valid(outcomes) THEN from_json(outcomes, '["VARCHAR"]') ELSE [] END AS o,
      CASE WHEN json_valid(tokens) THEN from_json(tokens, '["VARCHAR"]') ELSE [] END AS k,
      list_transform(from_json(prices, '["VARCHAR"]'), lambda v: TRY_CAST(v AS DOUBLE)) AS q FROM raw""", ["raw"])
X.add_cte("placed", """
    SELECT *, list_position(list_transform(o, lambda v: lower(trim(v))), 'yes') AS yes_at,
      CASE WHEN len(q) = len(o) AND len(o) > 0 AND list_max(q) >= 0.99 THEN o[list_position(q, list_max(q))] END AS outcome
    FROM parsed""", ["parsed"])


def raw_markets(spark, d):
    m = X.markets(spark, d)
    k = F.col("market_id")
    mod = lambda n: k % n == 0
    q = lambda text: F.lit(text)
    none = F.lit(None).cast("string")
    tag = lambda label, slug: F.struct(label.alias("label"), slug.alias("slug"))
    event_tags = F.array(tag(F.col("domain"), none), tag(none, F.lower(F.col("family"))))
    event = F.struct(F.concat(q("e"), k % 20).alias("id"), F.col("domain").alias("category"), event_tags.alias("tags"))
    blank = F.struct(none.alias("id"), q("").alias("category"), event_tags.alias("tags"))
    return m.select(
        k.cast("string").alias("id"), F.concat(q("c"), k).alias("conditionId"),
        F.when(mod(10), "").otherwise(F.concat(q("Will "), "family", q(" win?"))).alias("question"),
        F.concat(q("Title "), k).alias("title"), F.when(mod(3), "").otherwise(F.col("family")).alias("category"),
        F.when(mod(11), '["Up","Down"]').when(mod(7), '[" YES ","No"]').when(mod(13), "  ").when(mod(17), "{bad")
        .when(mod(5), '["No","Yes"]').otherwise('["Yes","No"]').alias("outcomes"),
        F.when(mod(23), '["1"]').when(mod(29), '["1","1"]').when(mod(31), '["x","0.995"]').when(F.col("volume") >= 7000, '["0.995","0.005"]')
        .when(F.col("volume") < 0, '["0.004","0.996"]').otherwise('["0.4","0.6"]').alias("outcomePrices"),
        F.when(mod(19), "[]").otherwise(F.concat(q('["t'), k, q('y","t'), k, q('n"]'))).alias("clobTokenIds"),
        F.date_format("start_ts", "yyyy-MM-dd").alias("startDate"), F.date_format("close_ts", "MM/dd/yyyy").alias("closedTime"),
        F.lit(True).alias("active"), mod(2).alias("closed"), F.lit(False).alias("archived"),
        F.when(mod(4), 0.0).otherwise(F.col("volume")).alias("volumeNum"), (F.col("volume") + 1).cast("string").alias("volume"),
        F.when(mod(6), None).otherwise(F.col("volume") * 2).alias("volumeClob"),
        F.when(mod(9), F.array(event.alias("e"))).otherwise(F.array(blank, event)).alias("events"),
        F.array(tag(q("x"), q("y")), tag(F.concat(q("t"), k % 5), none), tag(q("x"), none)).alias("tags"),
        F.lit("s").alias("slug"),
    )


def written_markets(spark, d):
    """The raw objects as files of one indented JSON array each, a hundred markets to the file, read back."""
    path = scratch_path(spark, "raw-markets")
    objects = raw_markets(spark, d)
    each = F.to_json(F.struct(*objects.columns), {"pretty": "true"})
    text = F.concat(F.lit("[\n"), F.array_join(F.collect_list(each), ",\n"), F.lit("\n]"))
    bunches = objects.groupBy(F.floor(F.col("id").cast("long") / 100).alias("bunch")).agg(text.alias("value"))
    bunches.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return I.scan_raw_markets(spark, path)


@query("scan_parquet", """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment, round(c_acctbal, 6) AS c_acctbal FROM customer""")
def scan_parquet(spark, d):
    return I.scan_parquet(spark, f"{d}/customer.parquet", ids=["c_custkey"]).select("c_custkey", "c_mktsegment", r6("c_acctbal"))


@query("scan_raw_markets", X.with_views("raw", """
    SELECT id, condition_id AS "conditionId", question, category, outcomes, prices AS "outcomePrices", tokens AS "clobTokenIds",
      round(volume_num, 6) AS volume_num FROM raw"""))
def scan_raw_markets(spark, d):
    return written_markets(spark, d).select(
        "id", "conditionId", "question", "category", "outcomes", "outcomePrices", "clobTokenIds",
        r6(F.col("volumeNum").cast("double"), "volume_num"))


@query("parse_jsonish", X.with_views("parsed", "SELECT id, array_to_string(o, '|') AS outcomes, len(o) AS n FROM parsed"))
def parse_jsonish(spark, d):
    o = S.parse_jsonish("outcomes")
    return raw_markets(spark, d).select("id", F.array_join(o, "|").alias("outcomes"), F.size(o).cast("long").alias("n"))


@query("safe_float", """
    SELECT event_id, round(TRY_CAST(CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 11 = 0 THEN 'n/a'
      ELSE CAST(value AS VARCHAR) END AS DOUBLE), 6) AS v FROM events""")
def safe_float(spark, d):
    text = F.when(F.col("event_id") % 7 == 0, "").when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return X.table(spark, d, "events").select("event_id", r6(S.safe_float(text), "v"))


@query("yes_position", X.with_views("placed", """
    SELECT id, CAST(yes_at AS INTEGER) AS yes_at, k[yes_at] AS yes_token, round(q[yes_at], 6) AS yes_price FROM placed"""))
def yes_position(spark, d):
    o, k, q = S.parse_jsonish("outcomes"), S.parse_jsonish("clobTokenIds"), S.parse_jsonish("outcomePrices")
    return raw_markets(spark, d).select(
        "id", S.yes_position(o).alias("yes_at"), S.at_yes(k, o).alias("yes_token"),
        r6(S.safe_float(S.at_yes(q, o)), "yes_price"))


@query("resolved_outcome", X.with_views("placed", "SELECT id, outcome FROM placed"))
def resolved_outcome(spark, d):
    prices = F.transform(S.parse_jsonish("outcomePrices"), S.safe_float)
    return raw_markets(spark, d).select("id", S.resolved_outcome(S.parse_jsonish("outcomes"), prices).alias("outcome"))


TAGS_SQL = """array_to_string(list_sort(list_distinct(['x', 't' || (CAST(id AS BIGINT) % 5), domain, lower(family)])), '|')"""


@query("collect_tags", X.with_views("raw", f"SELECT id, {TAGS_SQL} AS tags FROM raw"))
def collect_tags(spark, d):
    return raw_markets(spark, d).select("id", F.array_join(S.collect_tags("tags", "events"), "|").alias("tags"))


@query("first_category", X.with_views("raw", "SELECT id, coalesce(nullif(category, ''), domain) AS category FROM raw"))
def first_category(spark, d):
    return raw_markets(spark, d).select("id", S.first_category("category", "events").alias("category"))


EVENT_SQL = "CASE WHEN CAST(id AS BIGINT) % 9 = 0 THEN 'e' || (CAST(id AS BIGINT) % 20) END"


@query("first_event_id", X.with_views("raw", f"SELECT id, {EVENT_SQL} AS event_id FROM raw"))
def first_event_id(spark, d):
    return raw_markets(spark, d).select("id", S.first_event_id("events").alias("event_id"))


@query("is_binary_yes_no", X.with_views("parsed", """
    SELECT id, len(o) = 2 AND list_sort(list_transform(o, lambda v: lower(v))) = ['no', 'yes'] AS is_binary FROM parsed"""))
def is_binary_yes_no(spark, d):
    return raw_markets(spark, d).select("id", S.is_binary_yes_no(S.parse_jsonish("outcomes")).alias("is_binary"))


@query("first_nonzero", X.with_views("raw", """
    SELECT id, round(CASE WHEN volume_num = 0 OR volume_num IS NULL THEN volume ELSE volume_num END, 6) AS volume FROM raw"""))
def first_nonzero(spark, d):
    return raw_markets(spark, d).select("id", r6(S.first_nonzero(S.safe_float("volumeNum"), S.safe_float("volume")), "volume"))


X.add_cte("normal", f"""
    SELECT id AS market_id, condition_id, {EVENT_SQL} AS event_id, coalesce(nullif(question, ''), title) AS question,
      coalesce(nullif(category, ''), domain) AS category, {TAGS_SQL} AS tags, array_to_string(o, '|') AS outcomes,
      len(q) AS n_prices, k[yes_at] AS yes_token_id, round(q[yes_at], 6) AS yes_price_current, outcome AS resolved_outcome,
      strftime(start_ts, '%Y-%m-%d') AS start_date, strftime(close_ts, '%m/%d/%Y') AS close_date,
      round(CASE WHEN volume_num = 0 THEN volume ELSE volume_num END, 6) AS volume, round(volume_clob, 6) AS volume_clob
    FROM placed WHERE k[yes_at] IS NOT NULL AND len(o) = 2
      AND list_sort(list_transform(o, lambda v: lower(v))) = ['no', 'yes']""", ["placed"])


@query("normalize_markets", X.with_views("normal", "SELECT * FROM normal"))
def normalize_markets(spark, d):
    n = I.normalize_markets(written_markets(spark, d))
    return n.select(
        "market_id", "condition_id", "event_id", "question", "category", F.array_join("tags", "|").alias("tags"),
        F.array_join("outcomes", "|").alias("outcomes"), F.size("outcome_prices").cast("long").alias("n_prices"),
        "yes_token_id", r6("yes_price_current"), "resolved_outcome", "start_date", "close_date", r6("volume"), r6("volume_clob"))


@query("epoch_to_ts", "SELECT event_id, date_trunc('second', ts) AS ts FROM events")
def epoch_to_ts(spark, d):
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return X.table(spark, d, "events").select("event_id", S.epoch_to_ts(seconds).alias("ts"))


# --- trades and histories ----------------------------------------------------------------------

X.add_cte("yes_trades", """
    SELECT event_id, market_id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE date_trunc('second', ts) END AS ts,
      CASE event_id % 4 WHEN 0 THEN p WHEN 1 THEN 1 - p WHEN 2 THEN CASE WHEN event_id % 50 = 2 THEN NULL ELSE p END
           ELSE 1 - p END AS yes_price FROM prices""", ["prices"])


def raw_trades(spark, d):
    e = F.col("event_id")
    own = lambda side: F.concat(F.lit("t"), "market_id", F.lit(side))
    return X.prices(spark, d).select(
        "event_id", "market_id", "ts", F.col("p").cast("string").alias("price"),
        F.when(e % 97 != 0, F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("timestamp"),
        F.when(e % 4 == 0, own("y")).when(e % 4 == 1, own("n")).otherwise("other").alias("asset"),
        F.when(e % 50 == 2, "?").when(e % 4 == 2, " Yes").when(e % 4 == 3, "NO").alias("outcome"),
        F.lit("BUY").alias("side"), F.col("p").alias("size"), F.concat(F.lit("h"), e).alias("transactionHash"),
    )


def trade_markets(spark, d):
    m = X.markets(spark, d)
    tokens = F.array(F.concat(F.lit("t"), "market_id", F.lit("y")), F.concat(F.lit("t"), "market_id", F.lit("n")))
    return m.select(
        F.col("market_id").cast("string").alias("market_id"), tokens[0].alias("yes_token_id"), tokens.alias("clob_token_ids"),
        F.col("family").alias("market_family"), F.col("domain").alias("category"))


def written_trades(spark, d):
    path = scratch_path(spark, "raw-trades")
    t = raw_trades(spark, d)
    item = F.struct("price", "timestamp", "asset", "outcome", "side", "size", "transactionHash")
    t.groupBy("market_id", F.date_trunc("hour", "ts").alias("h")).agg(F.collect_list(item).alias("payload")).select(
        F.col("market_id").cast("string"), F.lit("c").alias("condition_id"), "payload").write.json(path)
    return I.scan_raw_trades(spark, path)


@query("trade_to_yes_price", X.with_views("yes_trades", "SELECT event_id, round(yes_price, 6) AS yes_price FROM yes_trades"))
def trade_to_yes_price(spark, d):
    own = lambda side: F.concat(F.lit("t"), "market_id", F.lit(side))
    price = S.trade_to_yes_price("price", "asset", "outcome", own("y"), own("n"))
    return raw_trades(spark, d).select("event_id", r6(price, "yes_price"))


@query("scan_raw_trades_jsonl", X.with_views("yes_trades prices", """
    SELECT CAST(t.market_id AS VARCHAR) AS market_id, 'h' || t.event_id AS "transactionHash", round(p.p, 6) AS price,
      CAST(epoch(t.ts) AS BIGINT) AS "timestamp" FROM yes_trades t JOIN prices p USING (event_id)"""))
def scan_raw_trades_jsonl(spark, d):
    return written_trades(spark, d).select("market_id", "transactionHash", r6(F.col("price").cast("double"), "price"), "timestamp")


@query("explode_trades", X.with_views("yes_trades markets", """
    SELECT ts AS "timestamp", CAST(market_id AS VARCHAR) AS market_id, 't' || market_id || 'y' AS token_id,
      round(yes_price, 6) AS yes_price, m.family AS market_family, m.domain AS category, 'h' || event_id AS transaction_hash,
      'data_api_trades' AS source FROM yes_trades JOIN markets m USING (market_id)
    WHERE ts IS NOT NULL AND yes_price IS NOT NULL"""))
def explode_trades(spark, d):
    return I.explode_trades(written_trades(spark, d), trade_markets(spark, d)).select(
        "timestamp", "market_id", "token_id", r6("yes_price"), "market_family", "category", "transaction_hash", "source")


def written_history(spark, d):
    path = scratch_path(spark, "raw-history")
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    p = F.when(F.col("event_id") % 41 == 0, 0.0).otherwise(F.col("p"))
    odd = F.col("market_id") % 2 == 1
    none_t, none_p = F.lit(None).cast("bigint"), F.lit(None).cast("double")
    item = F.struct(
        F.when(odd, none_t).otherwise(seconds).alias("t"), F.when(odd, seconds).otherwise(none_t).alias("timestamp"),
        F.when(odd, none_p).otherwise(p).alias("p"), F.when(odd, p).otherwise(none_p).alias("price"))
    rows = X.prices(spark, d).groupBy("market_id", F.date_trunc("hour", "ts").alias("h")).agg(F.to_json(F.collect_list(item)).alias("points"))
    head = F.concat(F.lit('{"market_id":"'), "market_id", F.lit('","token_id":"t'), "market_id", F.lit('y","params":{"fidelity":60},"payload":'))
    body = F.when(odd, F.col("points")).otherwise(F.concat(F.lit('{"history":'), "points", F.lit("}")))
    rows.select(F.concat(head, body, F.lit("}")).alias("value")).write.text(path)
    return I.scan_raw_history(spark, path)


HISTORY = """SELECT CAST(market_id AS VARCHAR) AS market_id, date_trunc('second', ts) AS "timestamp",
      round(CASE WHEN event_id % 41 = 0 THEN 0.0 ELSE p END, 6) AS yes_price, event_id, market_id % 2 AS odd FROM prices"""


@query("scan_raw_history_jsonl", X.with_views("prices", f"""
    SELECT market_id, 't' || market_id || 'y' AS token_id, CAST(epoch("timestamp") AS BIGINT) AS t, yes_price AS p FROM ({HISTORY})"""))
def scan_raw_history_jsonl(spark, d):
    return written_history(spark, d).select(
        "market_id", "token_id", F.coalesce("t", "timestamp").alias("t"), r6(F.coalesce("p", "price"), "p"))


@query("explode_history", X.with_views("prices markets", f"""
    SELECT h.market_id, h."timestamp", h.yes_price, m.family AS market_family FROM ({HISTORY}) h
    JOIN markets m ON CAST(m.market_id AS VARCHAR) = h.market_id"""))
def explode_history(spark, d):
    return I.explode_history(written_history(spark, d), trade_markets(spark, d)).select(
        "market_id", "timestamp", r6("yes_price"), "market_family")


@query("explode_history_legacy", X.with_views("prices", f"""
    SELECT market_id, "timestamp", yes_price FROM ({HISTORY}) WHERE odd = 1 OR yes_price <> 0 OR event_id % 41 <> 0"""))
def explode_history_legacy(spark, d):
    return I.explode_history(written_history(spark, d), trade_markets(spark, d), legacy=True).select(
        "market_id", "timestamp", r6("yes_price"))


X.add_cte("bounds", """
    SELECT market_id, CASE WHEN stop > start_ts THEN start_ts END AS bound_start, CASE WHEN stop > start_ts THEN stop END AS bound_stop
    FROM (SELECT market_id, start_ts, CASE WHEN market_id % 12 = 0 THEN NULL WHEN market_id % 7 = 0 THEN start_ts - INTERVAL 1 DAY
          ELSE close_ts + to_hours(CAST(market_id % 24 AS INTEGER)) END AS stop FROM markets)""", ["markets"])


def bounds(spark, d):
    m = X.markets(spark, d)
    k = F.col("market_id")
    stop = F.when(k % 12 == 0, None).when(k % 7 == 0, F.col("start_ts") - F.expr("interval 1 day")).otherwise(
        F.col("close_ts") + F.make_dt_interval(F.lit(0), (k % 24).cast("int")))
    return I.active_bounds(m.withColumn("close_ts", stop))


@query("active_bounds", X.with_views("bounds", "SELECT * FROM bounds"))
def active_bounds(spark, d):
    return bounds(spark, d)


@query("chunk_time_range", X.with_views("bounds", """
    SELECT market_id, c AS chunk_start, least(c + INTERVAL 5 DAY, bound_stop) AS chunk_stop FROM (
      SELECT market_id, bound_stop, unnest(generate_series(bound_start, bound_stop, INTERVAL 5 DAY)) AS c
      FROM bounds WHERE bound_start IS NOT NULL) WHERE c < bound_stop"""))
def chunk_time_range(spark, d):
    return I.chunk_time_range(bounds(spark, d), 5)


@query("tolerant_timestamp", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 4 THEN NULL WHEN o_orderkey % 8 = 7 THEN date_trunc('day', o_orderdate) - INTERVAL 1 DAY
      ELSE date_trunc('day', o_orderdate) END AS day FROM orders""")
def tolerant_timestamp(spark, d):
    k = F.col("o_orderkey") % 8
    text = (
        F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
        .when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 3, F.date_format("o_orderdate", "MM/dd/yyyy")).when(k == 4, "soon")
        .when(k == 5, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T16:10:01.538Z")))
        .when(k == 6, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 16:31:01+00")))
        .otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:30:00+02:00"))))
    return X.table(spark, d, "orders").select("o_orderkey", P.floor_to(S.tolerant_timestamp(text), "day").alias("day"))


@query("label_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS y FROM orders")
def label_map(spark, d):
    outcome = F.when(F.col("o_orderstatus") == "F", "Yes").when(F.col("o_orderstatus") == "O", "No").otherwise("Maybe")
    return X.table(spark, d, "orders").select("o_orderkey", S.label_map(outcome).alias("y"))


@query("price_bounds_filter", "SELECT event_id, round(value / 50, 6) AS p FROM events WHERE value / 50 BETWEEN 0 AND 1")
def price_bounds_filter(spark, d):
    return M.in_bounds(X.table(spark, d, "events").select("event_id", (F.col("value") / 50).alias("p"))).select("event_id", r6("p"))


@query("clean_values", """
    SELECT event_id, round(CASE WHEN event_id % 9 = 0 OR event_id % 10 = 0 THEN NULL
      ELSE greatest(0.0, least(1.0, value / 50 - 0.2)) END, 6) AS v FROM events""")
def clean_values(spark, d):
    v = F.when(F.col("event_id") % 9 == 0, float("inf")).when(F.col("event_id") % 10 == 0, float("nan")).otherwise(F.col("value") / 50 - 0.2)
    return X.table(spark, d, "events").select("event_id", r6(S.clean_value(v), "v"))


@query("probability_clip", "SELECT event_id, round(greatest(1e-6, least(1 - 1e-6, value / 50)), 6) AS p FROM events")
def probability_clip(spark, d):
    return X.table(spark, d, "events").select("event_id", r6(S.probability_clip(F.col("value") / 50), "p"))


@query("binary_entropy", """
    SELECT event_id, round(CASE WHEN v > 0 AND v < 1 THEN -(v * log2(v) + (1 - v) * log2(1 - v)) ELSE 0 END, 6) AS h
    FROM (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE least(1.0, value / 50) END AS v FROM events)""")
def binary_entropy(spark, d):
    v = F.when(F.col("event_id") % 13 == 0, None).otherwise(F.least(F.lit(1.0), F.col("value") / 50))
    return X.table(spark, d, "events").select("event_id", r6(S.binary_entropy(v), "h"))


@query("parse_window_from_name", """
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END AS window_hours FROM part""")
def parse_window_from_name(spark, d):
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("plain_"), "p_name")).otherwise(
        F.concat(F.lit("tda_"), "p_size", F.lit("h_C1")))
    return X.table(spark, d, "part").select("p_partkey", S.window_from_name(name).alias("window_hours"))


@query("interaction_features", X.with_views("sup", """
    SELECT ts, market_id, round(p * volume, 6) AS p_x_volume, round(p * y, 6) AS p_x_y,
      round(n_active * volume, 6) AS n_active_x_volume, CAST(n_active * y AS BIGINT) AS n_active_x_y FROM sup"""))
def interaction_features(spark, d):
    pairs = [F.round(F.col(a) * F.col(b), 6).alias(f"{a}_x_{b}") for a in ("p", "n_active") for b in ("volume", "y")]
    return X.supervised(spark, d).select("ts", "market_id", *pairs)


# --- sources and sinks -------------------------------------------------------------------------


@query("align_source_schema", X.with_views("prices", """
    SELECT ts AS "timestamp", CAST(market_id AS VARCHAR) AS market_id, round(p, 6) AS yes_price, source, 17 AS n_columns,
      CAST(NULL AS VARCHAR) AS asset FROM prices
    UNION ALL SELECT ts, CAST(market_id AS VARCHAR), round(p, 6), 'clob_prices_history', 17, NULL FROM prices WHERE source = 'sampled'"""))
def align_source_schema(spark, d):
    p = X.prices(spark, d).withColumnsRenamed({"ts": "timestamp", "p": "yes_price"})
    parts = [M.align_source(p, "data_api_trades"), M.align_source(None, "missing", spark),
             M.align_source(p.where("source = 'sampled'").drop("source"), "clob_prices_history")]
    out = M.union_models(parts)
    return out.select("timestamp", "market_id", r6("yes_price"), "source", F.lit(len(out.columns)).alias("n_columns"), "asset")


@query("csv_source_sink", X.with_views("hourly", "SELECT ts, market_id, round(p, 6) AS p FROM hourly"))
def csv_source_sink(spark, d):
    path = scratch_path(spark, "csv")
    I.write_csv(X.hourly(spark, d), path)
    return I.read_csv(spark, path, "ts timestamp_ntz, market_id bigint, p double").select("ts", "market_id", r6("p"))


@query("parquet_sink_with_stats", X.with_views("hours panel", """
    SELECT count(*) AS timestamp_count, CAST((SELECT count(DISTINCT market_id) FROM hourly) AS BIGINT) AS market_count,
      round(1 - sum(n) / (count(*) * (SELECT count(DISTINCT market_id) FROM hourly)), 6) AS missingness
    FROM (SELECT h.ts, count(p.p) AS n FROM hours h LEFT JOIN panel p ON p.ts = h.ts GROUP BY h.ts)"""))
def parquet_sink_with_stats(spark, d):
    h = X.hourly(spark, d)
    cells = P.active_ffill(h, P.active_windows(h, X.markets(spark, d)))
    stats = P.panel_stats(cells, P.hour_index(h), h)
    return I.write_panel(cells, stats, scratch_path(spark, "panel")).select("timestamp_count", "market_count", r6("missingness"))


@query("fold_partitioned_sink", X.with_views("prices", """
    SELECT CAST(event_id % 4 AS INTEGER) AS fold, count(*) AS n, round(sum(p), 6) AS total FROM prices GROUP BY 1"""))
def fold_partitioned_sink(spark, d):
    path = scratch_path(spark, "folds")
    rows = X.prices(spark, d).withColumn("fold", (F.col("event_id") % 4).cast("int"))
    I.write_folds(rows.where("fold < 2"), path)
    return I.write_folds(rows, path).groupBy("fold").agg(F.count("*").alias("n"), r6(F.sum("p"), "total"))


# --- text classification -----------------------------------------------------------------------

# Words dropped into the titles so that every rule meets some document; every text is read whole.
TITLE_WORDS = [
    "bitcoin", "ethereum", "mstr", "bitcoin etf", "eth etf", "stablecoin", "crypto bill", "crypto", "reserve", "solana",
    "btc accused", "fed rate cut", "cpi", "gdp", "election", "nba", "supreme court", "snowfall", "doge", "binance approval",
    "data source degraded", "klga", "weather", "usdc", "garden",
]
VERBS = ["reach", "dip to", "stay above", "fall below", "meet"]
X.add_cte("texts", f"""
    SELECT doc_id, ({TITLE_WORDS})[doc_id % {len(TITLE_WORDS)} + 1] AS word,
      lower('Will ' || ({TITLE_WORDS})[doc_id % {len(TITLE_WORDS)} + 1] || ' ' || ({VERBS})[doc_id % {len(VERBS)} + 1] || ' ' ||
        CASE WHEN doc_id % 3 = 0 THEN '$' || n_chars || ',000.5' WHEN doc_id % 3 = 1 THEN '$' || n_chars || ' k'
             WHEN doc_id % 9 = 2 THEN n_chars || 'm' ELSE 'more' END || '?') AS question,
      lower(text) AS body, lower(source) AS category, lower(lang) AS tag FROM documents""", [])
X.add_cte("matched", """
    SELECT doc_id, question, question || ' ' || body || ' ' || category || ' ' || tag AS text,
      question || ' ' || category || ' ' || tag AS title FROM texts""", ["texts"])


def texts(spark, d):
    k, n = F.col("doc_id"), F.col("n_chars").cast("string")
    word = F.element_at(F.array([F.lit(w) for w in TITLE_WORDS]), (k % len(TITLE_WORDS) + 1).cast("int"))
    verb = F.element_at(F.array([F.lit(w) for w in VERBS]), (k % len(VERBS) + 1).cast("int"))
    amount = F.when(k % 3 == 0, F.concat(F.lit("$"), n, F.lit(",000.5"))).when(k % 3 == 1, F.concat(F.lit("$"), n, F.lit(" k"))) \
        .when(k % 9 == 2, F.concat(n, F.lit("m"))).otherwise("more")
    question = F.concat(F.lit("Will "), word, F.lit(" "), verb, F.lit(" "), amount, F.lit("?"))
    rows = X.table(spark, d, "documents").select(
        "doc_id", question.alias("question"), F.col("text").alias("description"), F.col("source").alias("category"), F.array("lang").alias("tags"))
    return rows.select(
        "doc_id", F.lower("question").alias("question"), C.match_text("question", "description", "category", tags="tags").alias("text"),
        C.match_text("question", "category", tags="tags").alias("title"))


def rx(words):
    return C.word_pattern(words).replace("'", "''")


def hit(column, words):
    return f"regexp_matches({column}, '{rx(words)}')"


@query("build_match_text", X.with_views("matched", "SELECT doc_id, md5(text) AS text, md5(title) AS title FROM matched"))
def build_match_text(spark, d):
    return texts(spark, d).select("doc_id", F.md5("text").alias("text"), F.md5("title").alias("title"))


KEYWORDS = ["the", "eth", "cryptocurrency", "rate cut", "ouve", "nt"]


@query("keyword_filter", X.with_views("matched", r"""
    SELECT doc_id, regexp_matches(text, '\bthe\b|\beth\b|cryptocurrency|rate cut|\bouve\b|\bnt\b') AS kept FROM matched"""))
def keyword_filter(spark, d):
    return texts(spark, d).select("doc_id", C.keyword_filter(F.col("text"), KEYWORDS).alias("kept"))


@query("candidate_flag", X.with_views("matched", f"SELECT doc_id, {hit('text', C.CANDIDATE_WORDS)} AS candidate FROM matched"))
def candidate_flag(spark, d):
    return texts(spark, d).select("doc_id", C.has_word(F.col("text"), C.CANDIDATE_WORDS).alias("candidate"))


@query("exclusion_rules", X.with_views("matched", f"SELECT doc_id, {hit('text', C.EXCLUDED_PHRASES)} AS excluded FROM matched"))
def exclusion_rules(spark, d):
    return texts(spark, d).select("doc_id", C.has_word(F.col("text"), C.EXCLUDED_PHRASES).alias("excluded"))


THRESHOLD_SQL = r"""CASE
      WHEN doc_id % 3 = 0 THEN CAST(regexp_replace(regexp_extract(question, '\$([0-9]+(,[0-9][0-9][0-9])*)', 1), ',', '', 'g') AS DOUBLE)
        + CASE WHEN regexp_matches(question, '\$[0-9]+,000\.5') AND regexp_matches(question, '\$[0-9]+(,[0-9]{3})+\.5') THEN 0.5 ELSE 0 END
      WHEN doc_id % 3 = 1 THEN CAST(regexp_extract(question, '\$([0-9]+)', 1) AS DOUBLE) * 1000
      WHEN doc_id % 9 = 2 THEN CAST(regexp_extract(question, ' ([0-9]+)m', 1) AS DOUBLE) * 1000000 END"""


@query("extract_threshold", X.with_views("matched", f"SELECT doc_id, round({THRESHOLD_SQL}, 6) AS threshold FROM matched"))
def extract_threshold(spark, d):
    return texts(spark, d).select("doc_id", r6(C.extract_threshold(F.col("question")), "threshold"))


DIRECTION_SQL = f"CASE WHEN {hit('question', C.BELOW_WORDS)} THEN 'below' WHEN {hit('question', C.ABOVE_WORDS)} THEN 'above' END"


@query("infer_direction", X.with_views("matched", f"SELECT doc_id, {DIRECTION_SQL} AS direction FROM matched"))
def infer_direction(spark, d):
    return texts(spark, d).select("doc_id", C.infer_direction(F.col("question")).alias("direction"))


X.add_cte("selection", f"""
    SELECT doc_id, rule, CASE WHEN rule > 2 THEN round(threshold, 6) END AS threshold, CASE WHEN rule > 2 THEN direction END AS direction,
      CASE rule WHEN 3 THEN 'btc_price' WHEN 4 THEN 'eth_price' WHEN 5 THEN 'microstrategy' WHEN 6 THEN 'crypto_etf'
                WHEN 7 THEN 'crypto_policy' ELSE 'excluded' END AS market_family,
      CASE rule WHEN 3 THEN 'BTC' WHEN 4 THEN 'ETH' WHEN 5 THEN 'MSTR' WHEN 6 THEN CASE WHEN btc THEN 'BTC' WHEN eth THEN 'ETH' END END AS asset,
      rule IN (3, 4) AS is_core, rule IN (5, 6, 7) AS is_satellite,
      CASE rule WHEN 3 THEN 'btc_price_threshold' WHEN 4 THEN 'eth_price_threshold' WHEN 5 THEN 'microstrategy_crypto_exposure'
                WHEN 6 THEN 'crypto_etf_policy' WHEN 7 THEN 'crypto_policy' END AS selection_reason,
      CASE rule WHEN 1 THEN 'not_crypto_candidate' WHEN 2 THEN 'crypto_news_or_identity_false_positive'
                WHEN 8 THEN 'generic_crypto_not_core_or_satellite' END AS exclusion_reason
    FROM (SELECT *, CASE WHEN NOT {hit('text', C.CANDIDATE_WORDS)} THEN 1 WHEN {hit('text', C.EXCLUDED_PHRASES)} THEN 2
            WHEN btc AND priced THEN 3 WHEN eth AND priced THEN 4 WHEN {hit('text', C.MSTR_WORDS)} THEN 5
            WHEN {hit('text', ['etf'])} THEN 6 WHEN {hit('text', C.SELECTION_POLICY_WORDS)} THEN 7 ELSE 8 END AS rule
          FROM (SELECT *, threshold IS NOT NULL AND direction IS NOT NULL AS priced FROM (
            SELECT *, {hit('text', C.BTC_WORDS)} AS btc, {hit('text', C.ETH_WORDS)} AS eth, {THRESHOLD_SQL} AS threshold,
              {DIRECTION_SQL} AS direction FROM matched)))""", ["matched"])


def selection(spark, d):
    t = texts(spark, d)
    return t.select("doc_id", C.classify_selection(F.col("text"), F.col("question")).alias("c")).select("doc_id", "c.*")


@query("classify_market", X.with_views("selection", "SELECT * EXCLUDE (rule) FROM selection"))
def classify_market(spark, d):
    return selection(spark, d).withColumn("threshold", r6("threshold"))


@query("split_selected_excluded", X.with_views("selection", """
    SELECT is_core OR is_satellite AS selected, market_family, count(*) AS markets FROM selection GROUP BY 1, 2"""))
def split_selected_excluded(spark, d):
    s = selection(spark, d)
    chosen = F.col("is_core") | F.col("is_satellite")
    parts = [s.where(chosen).withColumn("selected", F.lit(True)), s.where(~chosen).withColumn("selected", F.lit(False))]
    return M.union_models(parts).groupBy("selected", "market_family").agg(F.count("*").alias("markets"))


X.add_cte("domains", f"""
    SELECT doc_id, CASE WHEN weather THEN 'weather/weather' WHEN {hit('text', C.MSTR_WORDS)} THEN 'crypto/crypto_microstrategy'
      WHEN {hit('title', C.STABLECOIN_TITLE_WORDS)} THEN 'crypto/crypto_stablecoin' WHEN asset AND {hit('text', ['etf'])} THEN 'crypto/crypto_etf'
      WHEN asset AND context AND {hit('text', C.CRYPTO_REGULATION_WORDS)} THEN 'crypto/crypto_regulation'
      WHEN asset AND context THEN 'crypto/crypto_policy' WHEN {hit('text', C.BTC_WORDS)} THEN 'crypto/crypto_btc'
      WHEN {hit('text', C.ETH_WORDS)} THEN 'crypto/crypto_eth' WHEN asset THEN 'crypto/crypto_other'
      WHEN {hit('text', C.FED_WORDS)} THEN 'macro/macro_fed_rates' WHEN {hit('text', C.INFLATION_WORDS)} THEN 'macro/macro_inflation'
      WHEN {hit('text', C.GROWTH_WORDS)} THEN 'macro/macro_growth_policy' WHEN {hit('text', C.ELECTION_WORDS)} THEN 'elections/elections'
      WHEN {hit('text', C.SPORT_WORDS)} THEN 'sports/sports' WHEN {hit('text', C.OTHER_POLICY_WORDS)} THEN 'policy_other/policy_other'
      ELSE 'other/other' END AS label,
      CASE WHEN {hit('text', C.DEGRADED_PHRASES)} THEN 'explicit_source_degraded_notice'
           WHEN weather THEN 'external_weather_source_dependency' END AS source_quality_reason
    FROM (SELECT *, {hit('text', C.WEATHER_SOURCE_WORDS)} OR {hit('title', C.WEATHER_TITLE_WORDS)} AS weather,
      {hit('text', C.CRYPTO_ASSET_WORDS)} AS asset, {hit('text', C.CRYPTO_CONTEXT_WORDS)} AS context FROM matched)""", ["matched"])


@query("classify_domain_family", X.with_views("domains", """
    SELECT doc_id, split_part(label, '/', 1) AS broad_domain, split_part(label, '/', 2) AS broad_family FROM domains"""))
def classify_domain_family(spark, d):
    t = texts(spark, d)
    return t.select("doc_id", C.classify_domain(F.col("text"), F.col("title")).alias("c")).select("doc_id", "c.*")


@query("source_quality_flag", X.with_views("domains", """
    SELECT doc_id, source_quality_reason IS NOT NULL AS exclude_source_quality, source_quality_reason FROM domains"""))
def source_quality_flag(spark, d):
    t = texts(spark, d)
    return t.select("doc_id", C.source_quality(F.col("text"), F.col("title")).alias("c")).select("doc_id", "c.*")
