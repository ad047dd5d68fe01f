"""Analytics queries over the event messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.catalog import fixtures as fx
from talkweave.operators import analytics as an
from talkweave.operators import turns as tn
from talkweave.plans.ordered import dense_position, time_levels
from talkweave.session import materialise

WS = an.WS


def usable(spark: SparkSession, folder: str) -> DataFrame:
    return tn.usable_messages(fx.messages_ev(spark, folder))


def turn_table(spark: SparkSession, folder: str) -> DataFrame:
    return tn.turns(usable(spark, folder), fx.BLOCK)


def events(spark: SparkSession, folder: str) -> DataFrame:
    return tn.turn_events(turn_table(spark, folder), fx.BLOCK)


def numbered(spark: SparkSession, folder: str) -> DataFrame:
    """Messages with their turns, numbered once for all that is told from them."""
    rows = usable(spark, folder).select(WS, "seq", "sender", "ts", "text")
    return materialise(tn.number_turns(rows, fx.BLOCK))


def attributed_to(rows: DataFrame, turn_rows: DataFrame) -> DataFrame:
    people = tn.people_of(rows)
    return tn.attributed_events(tn.turn_events(turn_rows, fx.BLOCK), tn.mentions(rows, people, fx.BLOCK, rows))


def attributed(spark: SparkSession, folder: str) -> DataFrame:
    rows = numbered(spark, folder)
    return attributed_to(rows, tn.turns_of(rows))


def pairs_of(rows: DataFrame, turn_rows: DataFrame) -> DataFrame:
    return an.connection_scores(an.pair_stats(attributed_to(rows, turn_rows)), turn_rows)


def scored_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = numbered(spark, folder)
    return pairs_of(rows, tn.turns_of(rows))


def spelled(cells, key):
    """``key:count`` pairs of a list, joined."""
    return F.array_join(F.transform(cells, lambda c: F.concat_ws(":", c[key].cast("string"), c["message_count"].cast("string"))), ",")


def _sender_counts(spark, folder):
    return an.sender_counts(usable(spark, folder))


def _sender_share(spark, folder):
    return an.sender_share(_sender_counts(spark, folder)).select(
        WS, "sender", F.round("share_percent", 6).alias("share_percent")
    )


def _cube(spark, folder, *keys):
    return an.activity_counts(usable(spark, folder), *keys)


def _weeks(spark, folder):
    return an.weekly_series(usable(spark, folder))


def _busiest(spark, folder):
    cube = _cube(spark, folder, WS)
    hours = an.busiest(an.roll_up(cube, WS, "hour"), [WS], "hour", "busiest_hour")
    days = an.busiest(an.roll_up(cube, WS, "weekday"), [WS], "weekday", "busiest_weekday")
    return hours.join(days, WS)


def _turn_texts(spark, folder):
    parts = tn.turn_texts(usable(spark, folder), fx.BLOCK)
    return parts.select(WS, "turn_no", "part_no", "text")


def _known_senders(spark, folder):
    messages = usable(spark, folder)
    known = an.sender_counts(messages).filter("message_count >= 175").select(WS, "sender")
    kept = messages.join(known, [WS, "sender"], "left_semi")
    return kept.select(WS, "seq", "sender")


def _sender_person_join(spark, folder):
    messages = usable(spark, folder)
    people = messages.select(WS, "sender").distinct().withColumn("person_id", an.person_id())
    return messages.join(people, [WS, "sender"]).select("message_id", "person_id")


def _person_messages(spark, folder):
    messages = usable(spark, folder)
    ranked = dense_position(
        messages, [WS, "sender"], [F.col("ts"), F.col("seq")], time_levels("ts", "seq", fx.BLOCK)
    )
    return ranked.select(WS, "sender", "pos", "message_id")


def _timeline_positions(spark, folder):
    ranked = dense_position(
        fx.messages_ev(spark, folder), [WS], [F.col("ts"), F.col("seq")], time_levels("ts", "seq", fx.BLOCK)
    )
    return ranked.select(WS, "message_id", "pos")


def _workspace_partners(spark, folder):
    roster = an.people_roster(usable(spark, folder))
    asked = an.top_speakers(an.sender_counts(usable(spark, folder)), 1).select(WS, "sender")
    return roster.join(asked, [WS, "sender"], "left_anti").select(WS, "sender", "message_count")


def _roster(spark, folder):
    return an.people_roster(usable(spark, folder)).select(
        WS, "sender", "message_count", "first_seen", "last_seen", "status"
    )


def _summary(spark, folder):
    return an.workspace_summary(usable(spark, folder))


def _scorecard(spark, folder):
    return an.person_scorecard(usable(spark, folder), events(spark, folder)).select(
        WS, "sender", "message_count", F.round("share_percent", 6).alias("share_percent"), "median_length",
        "peak_hour", "replies_given", "replies_received", "initiations", "pickup_median", "burst_median",
        spelled("active_hours", "bucket").alias("active_hours"), spelled("active_days", "bucket").alias("active_days"),
        F.array_join("response_bins", ",").alias("response_bins"),
    )


def _group_scorecard(spark, folder):
    rows = numbered(spark, folder)
    turn_rows = tn.turns_of(rows)
    card = an.group_scorecard(rows, tn.turn_events(turn_rows, fx.BLOCK), pairs_of(rows, turn_rows))
    return card.withColumns(
        {
            "messages_per_day": F.round("messages_per_day", 6), "active_hours": spelled("active_hours", "bucket"),
            "active_days": spelled("active_days", "bucket"), "top_weeks": spelled("top_weeks", "week"),
        }
    )


W = f"with {fx.SQL_USABLE} "
T = f"with {fx.SQL_TURNS} "
E = f"with {fx.SQL_EVENTS} "
GIVEN = "case when kind in ('pickup','burst') then 1 else 0 end"
OPENED = "case when kind in ('first','initiation','pickup') then 1 else 0 end"
PICKUP = "case when count(*) filter (kind = 'pickup') >= 3 then median(gap_seconds) filter (kind = 'pickup') end"
BURST = (
    "case when count(*) filter (kind = 'burst' and gap_seconds > 0) >= 3 "
    "then median(gap_seconds) filter (kind = 'burst' and gap_seconds > 0) end"
)
HOUR = "cast(hour(ts) as bigint)"
DAY = "cast(isodow(ts) - 1 as bigint)"
WEEKS = (
    W[:-1]
    + """, weeks as (select workspace_id, date_trunc('week', ts) as monday, count(*) as message_count
 from usable group by 1, 2), series as (select workspace_id, strftime(monday, '%G-W%V') as week,
 strftime(monday, '%b %d') as label, cast(monday as timestamp) as monday, message_count from weeks) """
)
CELLS = W[:-1] + f""", cells as (select workspace_id, {DAY} as weekday, {HOUR} as hour, count(*) as message_count
 from usable group by 1, 2, 3) """
BINS = " || ',' || ".join(
    f"count(*) filter (kind = 'burst' and gap_seconds > 0 and gap_seconds >= {low}" + (f" and gap_seconds < {high})" if high else ")")
    for low, high, _ in an.RESPONSE_BINS
)


def _best_sql(name: str, keys: str, bucket: str, n: int) -> str:
    return f"""{name} as (select {keys}, string_agg(b || ':' || n, ',' order by n desc, b) as cells from (
  select *, row_number() over (partition by {keys} order by n desc, b) as rn from (
   select {keys}, {bucket} as b, count(*) as n from usable group by {keys}, b) x) y where rn <= {n} group by {keys})"""


CARD = f"""
 base as (select workspace_id, sender, count(*) as message_count,
   coalesce(median(length(text)) filter (length(text) >= 2), 0) as median_length from usable group by 1, 2),
 hours as (select workspace_id, sender, hour, row_number() over (partition by workspace_id, sender order by n desc, hour) as rn
   from (select workspace_id, sender, {HOUR} as hour, count(*) as n from usable group by 1, 2, 3) h),
 sent as (select workspace_id, sender, cast(sum({GIVEN}) as bigint) as replies_given,
   cast(sum({OPENED}) as bigint) as initiations, {PICKUP} as pickup_median, {BURST} as burst_median, {BINS} as bins
   from turn_events group by 1, 2),
 {_best_sql("ah", "workspace_id, sender", HOUR, 3)}, {_best_sql("ad", "workspace_id, sender", DAY, 3)},
 got as (select workspace_id, previous_sender as sender, count(*) as replies_received from turn_events
   where kind in ('pickup','burst') group by 1, 2)
"""

ENTRIES = {
    "sender_counts": (_sender_counts, W + "select workspace_id, sender, count(*) as message_count from usable group by 1, 2"),
    "sender_share": (
        _sender_share,
        W + "select workspace_id, sender, round(count(*) * 100.0 / sum(count(*)) over (partition by workspace_id), 6) as share_percent from usable group by 1, 2",
    ),
    "median_length": (
        lambda s, d: an.median_length(usable(s, d)),
        W + "select workspace_id, sender, coalesce(median(length(text)) filter (length(text) >= 2), 0) as median_length from usable group by 1, 2",
    ),
    "hour_histogram": (
        lambda s, d: an.roll_up(_cube(s, d, WS, "sender"), WS, "sender", "hour"),
        W + f"select workspace_id, sender, {HOUR} as hour, count(*) as message_count from usable group by 1, 2, 3",
    ),
    "weekday_histogram": (
        lambda s, d: an.roll_up(_cube(s, d, WS, "sender"), WS, "sender", "weekday"),
        W + f"select workspace_id, sender, {DAY} as weekday, count(*) as message_count from usable group by 1, 2, 3",
    ),
    "heatmap": (
        lambda s, d: _cube(s, d, WS).select(WS, "weekday", "hour", "message_count"),
        CELLS + "select * from cells",
    ),
    "heatmap_dense": (
        lambda s, d: an.dense_heatmap(_cube(s, d, WS)),
        CELLS
        + """select g.workspace_id, g.weekday, g.hour, coalesce(c.message_count, 0) as message_count
 from (select w.workspace_id, cast(a.d as bigint) as weekday, cast(b.h as bigint) as hour
       from (select distinct workspace_id from cells) w, range(7) a(d), range(24) b(h)) g
 left join cells c using (workspace_id, weekday, hour)""",
    ),
    "heatmap_levels": (
        lambda s, d: _heat_levels(s, d),
        CELLS
        + """select workspace_id, weekday, hour, cast(case when r < 0.2 then 1 when r < 0.4 then 2 when r < 0.65 then 3
 when r < 0.85 then 4 else 5 end as bigint) as level
 from (select *, message_count / cast(max(message_count) over (partition by workspace_id) as double) as r from cells) x""",
    ),
    "weekly_series": (
        lambda s, d: _weeks(s, d).select(WS, "week", "label", "message_count"),
        WEEKS + "select workspace_id, week, label, message_count from series",
    ),
    "monthly_series": (
        lambda s, d: an.monthly_series(_weeks(s, d)),
        WEEKS + "select workspace_id, strftime(monday, '%Y-%m') as month, cast(sum(message_count) as bigint) as message_count from series group by 1, 2",
    ),
    "weekly_last52": (
        lambda s, d: an.trailing_weeks(_weeks(s, d), F.lit("2024-01-24").cast("timestamp_ntz")).select(
            WS, "week", "message_count", F.col("recency").cast("bigint").alias("recency")
        ),
        WEEKS
        + """select workspace_id, week, message_count, recency from (select *, row_number() over (partition by workspace_id order by monday desc) as recency
 from series where monday <= timestamp '2024-01-24') x where recency <= 52""",
    ),
    "top_weeks": (
        lambda s, d: an.top_weeks(_weeks(s, d)).select(WS, "week", "message_count", F.col("rank").cast("bigint").alias("rank")),
        WEEKS
        + """select workspace_id, week, message_count, rank from (select *, row_number() over (partition by workspace_id order by message_count desc, monday) as rank
 from series) x where rank <= 5""",
    ),
    "busiest_bucket": (
        _busiest,
        CELLS
        + """select h.workspace_id, h.hour as busiest_hour, d.weekday as busiest_weekday from
 (select workspace_id, hour, row_number() over (partition by workspace_id order by sum(message_count) desc, hour) as rn from cells group by 1, 2) h
 join (select workspace_id, weekday, row_number() over (partition by workspace_id order by sum(message_count) desc, weekday) as rn from cells group by 1, 2) d
 on h.workspace_id = d.workspace_id and h.rn = 1 and d.rn = 1""",
    ),
    "active_hours_topn": (
        lambda s, d: an.top_buckets(an.roll_up(_cube(s, d, WS, "sender"), WS, "sender", "hour"), [WS, "sender"], "hour", 3).withColumn(
            "rank", F.col("rank").cast("bigint")
        ),
        W
        + f"""select workspace_id, sender, hour, message_count, rank from (
 select workspace_id, sender, {HOUR} as hour, count(*) as message_count,
 row_number() over (partition by workspace_id, sender order by count(*) desc, {HOUR}) as rank from usable group by 1, 2, 3) x where rank <= 3""",
    ),
    "messages_per_day": (
        lambda s, d: an.messages_per_day(usable(s, d)).withColumn("messages_per_day", F.round("messages_per_day", 6)),
        W
        + """select workspace_id, count(*) as message_count,
 cast(greatest(1, date_diff('day', cast(arg_min(ts, seq) as date), cast(arg_max(ts, seq) as date)) + 1) as bigint) as span_days,
 round(count(*) / cast(greatest(1, date_diff('day', cast(arg_min(ts, seq) as date), cast(arg_max(ts, seq) as date)) + 1) as double), 6) as messages_per_day
 from usable group by 1""",
    ),
    "turns": (
        turn_table,
        T + "select workspace_id, turn_no, sender, first_seq, first_ts, msg_count, length(text) as text_length from turns",
    ),
    "turn_texts": (
        _turn_texts,
        T[:-1]
        + f""", parts as (select *, (row_number() over (partition by workspace_id, turn_no order by seq) - 1) // {tn.TURN_PART} as part_no from numbered)
 select workspace_id, turn_no, part_no, string_agg(text, ' ' order by seq) as text from parts group by 1, 2, 3""",
    ),
    "turn_events": (
        lambda s, d: events(s, d).select(WS, "turn_no", "sender", "previous_sender", F.col("gap_seconds").cast("double").alias("gap_seconds"), "kind"),
        E + "select workspace_id, turn_no, sender, previous_sender, cast(gap_seconds as double) as gap_seconds, kind from turn_events",
    ),
    "initiations": (
        lambda s, d: an.initiations(events(s, d)),
        E + f"select workspace_id, sender, cast(sum({OPENED}) as bigint) as initiations from turn_events group by 1, 2",
    ),
    "replies_given_received": (
        lambda s, d: an.replies_given_received(events(s, d)),
        E
        + """select workspace_id, who as sender, cast(sum(g) as bigint) as replies_given, cast(sum(r) as bigint) as replies_received from (
 select workspace_id, sender as who, 1 as g, 0 as r from turn_events where kind in ('pickup','burst')
 union all select workspace_id, previous_sender, 0, 1 from turn_events where kind in ('pickup','burst')) x group by 1, 2""",
    ),
    "pickup_reply_median": (
        lambda s, d: an.reply_medians(events(s, d)).select(WS, "sender", "pickup_median"),
        E + f"select workspace_id, sender, {PICKUP} as pickup_median from turn_events group by 1, 2",
    ),
    "burst_reply_median": (
        lambda s, d: an.reply_medians(events(s, d)).select(WS, "sender", "burst_median"),
        E + f"select workspace_id, sender, {BURST} as burst_median from turn_events group by 1, 2",
    ),
    "group_pickup_median": (
        lambda s, d: an.group_pickup_median(events(s, d)),
        E + f"select workspace_id, {PICKUP} as pickup_median from turn_events group by 1",
    ),
    "response_histogram": (
        lambda s, d: _histogram(s, d),
        E
        + """select p.workspace_id, p.sender, cast(b.bin as bigint) as bin, b.label, count(e.gap_seconds) as replies
 from (select distinct workspace_id, sender from turn_events) p
 cross join (values (0, 0, 60, '<1m'), (1, 60, 300, '1-5m'), (2, 300, 1800, '5-30m'), (3, 1800, 1000000000, '30m+')) b(bin, lo, hi, label)
 left join turn_events e on e.workspace_id = p.workspace_id and e.sender = p.sender and e.kind = 'burst'
   and e.gap_seconds > 0 and e.gap_seconds >= b.lo and e.gap_seconds < b.hi
 group by 1, 2, 3, 4""",
    ),
    "mention_attribution": (
        lambda s, d: attributed(s, d).select(WS, "turn_no", "sender", "previous_sender", "target", "kind"),
        E + "select workspace_id, turn_no, sender, previous_sender, target, kind from attributed",
    ),
    "reply_edges": (
        lambda s, d: an.reply_edges(attributed(s, d)),
        E + "select workspace_id, target, sender as replier, count(*) as replies from attributed group by 1, 2, 3",
    ),
    "pair_stats": (
        lambda s, d: an.pair_stats(attributed(s, d)),
        E + "select * from pairs",
    ),
    "connection_score": (
        lambda s, d: scored_pairs(s, d).select(WS, "person_a", "person_b", "exchanges", "turns_a", "turns_b", "connection_score"),
        E
        + """select s.workspace_id, person_a, person_b, exchanges, a.turns as turns_a, b.turns as turns_b, connection_score from scored s
 left join spoken a on a.workspace_id = s.workspace_id and a.sender = person_a
 left join spoken b on b.workspace_id = s.workspace_id and b.sender = person_b""",
    ),
    "strongest_pair": (
        lambda s, d: an.strongest_pair(scored_pairs(s, d)).select(WS, "person_a", "person_b", "connection_score"),
        E
        + """select workspace_id, person_a, person_b, connection_score from (select *, row_number() over (partition by workspace_id
 order by connection_score desc, person_a, person_b) as rn from scored) x where rn = 1""",
    ),
    "people_roster": (
        _roster,
        W
        + """select workspace_id, sender, count(*) as message_count, min(ts) as first_seen, max(ts) as last_seen,
 case when count(*) < 50 then 'not_enough' when count(*) < 200 then 'thin' else 'ready' end as status from usable group by 1, 2""",
    ),
    "persona_status": (
        lambda s, d: _roster(s, d).select(WS, "sender", "status"),
        W + "select workspace_id, sender, case when count(*) < 50 then 'not_enough' when count(*) < 200 then 'thin' else 'ready' end as status from usable group by 1, 2",
    ),
    "top_speakers": (
        lambda s, d: an.top_speakers(_sender_counts(s, d)).withColumn("rank", F.col("rank").cast("bigint")),
        W
        + """select workspace_id, sender, message_count, rank from (select workspace_id, sender, count(*) as message_count,
 row_number() over (partition by workspace_id order by count(*) desc, sender) as rank from usable group by 1, 2) x where rank <= 5""",
    ),
    "workspace_summary": (
        _summary,
        W
        + """select workspace_id, count(*) as message_count, count(distinct sender) as speaker_count, min(ts) as date_from,
 max(ts) as date_to, count(distinct sender) > 2 as is_group from usable group by 1""",
    ),
    "workspace_partners": (
        _workspace_partners,
        W
        + """, counts as (select workspace_id, sender, count(*) as message_count, row_number() over (partition by workspace_id
 order by count(*) desc, sender) as rn from usable group by 1, 2) select workspace_id, sender, message_count from counts where rn > 1""",
    ),
    "person_messages": (
        _person_messages,
        W + "select workspace_id, sender, row_number() over (partition by workspace_id, sender order by ts, seq) - 1 as pos, message_id from usable",
    ),
    "timeline_positions": (
        _timeline_positions,
        W + "select workspace_id, message_id, row_number() over (partition by workspace_id order by ts, seq) - 1 as pos from messages_ev",
    ),
    "known_senders": (
        _known_senders,
        W
        + """select workspace_id, seq, sender from usable where (workspace_id, sender) in
 (select (workspace_id, sender) from usable group by workspace_id, sender having count(*) >= 175)""",
    ),
    "sender_person_join": (
        _sender_person_join,
        W + "select message_id, sha256(concat(workspace_id, '␟', sender)) as person_id from usable",
    ),
    "person_scorecard": (
        _scorecard,
        E[:-1]
        + ", "
        + CARD
        + """select b.workspace_id, b.sender, b.message_count,
 round(b.message_count * 100.0 / sum(b.message_count) over (partition by b.workspace_id), 6) as share_percent,
 b.median_length, h.hour as peak_hour, coalesce(s.replies_given, 0) as replies_given,
 coalesce(g.replies_received, 0) as replies_received, coalesce(s.initiations, 0) as initiations, s.pickup_median, s.burst_median,
 ah.cells as active_hours, ad.cells as active_days, coalesce(s.bins, '0,0,0,0') as response_bins
 from base b join ah on ah.workspace_id = b.workspace_id and ah.sender = b.sender join ad on ad.workspace_id = b.workspace_id and ad.sender = b.sender
 join hours h on h.workspace_id = b.workspace_id and h.sender = b.sender and h.rn = 1
 left join sent s on s.workspace_id = b.workspace_id and s.sender = b.sender
 left join got g on g.workspace_id = b.workspace_id and g.sender = b.sender""",
    ),
    "group_scorecard": (
        _group_scorecard,
        E[:-1]
        + f""", {_best_sql("ah", "workspace_id", HOUR, 5)}, {_best_sql("ad", "workspace_id", DAY, 7)},
 aw as (select workspace_id, string_agg(strftime(monday, '%G-W%V') || ':' || n, ',' order by n desc, monday) as cells from (
  select *, row_number() over (partition by workspace_id order by n desc, monday) as rn from (
   select workspace_id, date_trunc('week', ts) as monday, count(*) as n from usable group by 1, 2) x) y where rn <= 5 group by 1),
 cells as (select workspace_id, {DAY} as weekday, {HOUR} as hour, count(*) as message_count from usable group by 1, 2, 3),
 pace as (select workspace_id, count(*) as message_count,
 cast(greatest(1, date_diff('day', cast(arg_min(ts, seq) as date), cast(arg_max(ts, seq) as date)) + 1) as bigint) as span_days from usable group by 1),
 h as (select workspace_id, hour, row_number() over (partition by workspace_id order by sum(message_count) desc, hour) as rn from cells group by 1, 2),
 d as (select workspace_id, weekday, row_number() over (partition by workspace_id order by sum(message_count) desc, weekday) as rn from cells group by 1, 2),
 m as (select workspace_id, {PICKUP} as pickup_median from turn_events group by 1),
 s as (select *, row_number() over (partition by workspace_id order by connection_score desc, person_a, person_b) as rn from scored)
 select p.workspace_id, p.message_count, p.span_days, round(p.message_count / cast(p.span_days as double), 6) as messages_per_day,
 h.hour as busiest_hour, d.weekday as busiest_weekday, m.pickup_median, s.person_a, s.person_b, s.connection_score,
 ah.cells as active_hours, ad.cells as active_days, aw.cells as top_weeks
 from pace p join ah on ah.workspace_id = p.workspace_id join ad on ad.workspace_id = p.workspace_id join aw on aw.workspace_id = p.workspace_id
 join h on h.workspace_id = p.workspace_id and h.rn = 1 join d on d.workspace_id = p.workspace_id and d.rn = 1
 left join m on m.workspace_id = p.workspace_id left join s on s.workspace_id = p.workspace_id and s.rn = 1""",
    ),
}


def _heat_levels(spark, folder):
    from pyspark.sql import Window

    from talkweave.functions.scores import heat_level

    cube = _cube(spark, folder, WS)
    peak = F.max("message_count").over(Window.partitionBy(WS))
    return cube.select(WS, "weekday", "hour", heat_level(F.col("message_count"), peak).alias("level"))


def _histogram(spark, folder):
    return an.response_histogram(events(spark, folder))
