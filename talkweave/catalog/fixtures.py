"""Adapters from the test tables to messages, corpora, vectors and requests.

Each adapter is written once for Spark and once for the SQL side; both read whole tables.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.session import checkpoint_folder

BLOCK = 4096
# Tables whose rows are expensive to work on.
HEAVY = ("documents", "events", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The whole table; one that lies in fewer splits than there are cores is spread over them."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in HEAVY and df.rdd.getNumPartitions() < cores else df


def stored(spark: SparkSession, name: str) -> str:
    """A new path for a table that a query writes and reads back, in the shared folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid4().hex}"


# One text for both engines: ten workspaces, five senders each, minute precision.
_MESSAGES_EV = """
select concat('w', right(cast(user_id as string), 1)) as workspace_id,
       event_id as seq,
       concat('m', cast(event_id as string)) as message_id,
       date_trunc('minute', ts) as ts,
       event_type as sender,
       case when value >= 100 then '<Media omitted>'
            when value >= 70 then concat('please look @Purchase, says ', event_type)
            when value >= 60 then concat('yaar kya hai ', event_type)
            when value >= 50 then concat('wow 😀🎉 ', event_type, '!')
            when value >= 45 then 'ok'
            when value >= 42 then 'do you remember the plan kab tha?'
            when value >= 39 then 'MAC D?'
            when value >= 37 then '😀 🎉!'
            when value >= 35 then concat('us din ', event_type)
            else concat(event_type, ' ', props) end as text,
       value < 0.3 as is_system
from {events}
"""


def messages_ev(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(_MESSAGES_EV, events=table(spark, folder, "events"))


def messages_conv(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "conversations")
    return c.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("workspace_id"),
        F.col("turn").alias("seq"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"),
        F.expr(
            "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id as int), cast(turn as int), 0)"
        ).alias("ts"),
        F.col("role").alias("sender"),
        "text",
        (F.col("role") == "system").alias("is_system"),
    )


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return d.select(
        F.col("lang").alias("workspace_id"),
        F.col("doc_id").alias("message_id"),
        F.col("source").alias("speaker"),
        F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id as int), 0, 0)").alias("ts"),
        "text",
    )


def lines(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn(
        "line_no", F.col("line_no").cast("bigint")
    )


SQL_MESSAGES_EV = "messages_ev as (" + _MESSAGES_EV.replace("{events}", "events") + ")"

SQL_MESSAGES_CONV = """messages_conv as (
  select concat('c', conv_id) as workspace_id, turn as seq, conv_id * 1000 + turn as message_id,
         timestamp '2024-01-01' + to_hours(cast(conv_id as int)) + to_minutes(cast(turn as int)) as ts,
         role as sender, text, role = 'system' as is_system
  from conversations)"""

SQL_CORPUS = """corpus as (
  select lang as workspace_id, doc_id as message_id, source as speaker,
         timestamp '2024-01-01' + to_hours(cast(doc_id as int)) as ts, text
  from documents)"""

SQL_LINES = r"""lines as (
  select doc_id, cast(i - 1 as bigint) as line_no, parts[i] as line
  from (select doc_id, string_split(text, chr(10)) as parts from documents) d,
       unnest(range(1, len(parts) + 1)) as u(i))"""

NOISE_SQL = (
    r"(?i)^(<Media omitted>|\[message deleted\]|This message was deleted\.?"
    r"|message was deleted|(image|video|audio|document|sticker|GIF)\s+omitted)$"
)


def strip_sql(expr: str) -> str:
    return rf"regexp_replace({expr}, '^\s+|\s+$', '', 'g')"


def noise_sql(expr: str) -> str:
    body = strip_sql(expr)
    return f"({body} = '' or regexp_matches({body}, '{NOISE_SQL}'))"


SQL_USABLE = (
    SQL_MESSAGES_EV
    + ", usable as (select * from messages_ev where not is_system and not "
    + noise_sql("text")
    + ")"
)

SQL_TURNS = (
    SQL_USABLE
    + """, flagged as (
  select *, case when lag(sender) over w is distinct from sender
                  and lag(sender) over w is not null then 1 else 0 end as starts
  from usable window w as (partition by workspace_id order by seq)),
numbered as (
  select *, cast(sum(starts) over (partition by workspace_id order by seq) as bigint) as turn_no from flagged),
turns as (
  select workspace_id, turn_no, min(sender) as sender, min(seq) as first_seq, arg_min(ts, seq) as first_ts,
         count(*) as msg_count, string_agg(text, ' ' order by seq) as text
  from numbered group by workspace_id, turn_no)"""
)

SQL_EVENTS = (
    SQL_TURNS
    + """, lagged as (
  select *, lag(sender) over w as previous_sender,
         cast(date_diff('second', lag(first_ts) over w, first_ts) as bigint) as gap_seconds
  from turns window w as (partition by workspace_id order by turn_no)),
turn_events as (
  select *, case when previous_sender is null then 'first'
                 when gap_seconds < 0 then 'skip'
                 when gap_seconds > 1800 and gap_seconds <= 14400 then 'pickup'
                 when gap_seconds > 1800 then 'initiation'
                 else 'burst' end as kind
  from lagged),
people as (select distinct workspace_id, sender from usable),
mention_table as (
  select t.workspace_id, t.turn_no, min(p.sender) as mentioned
  from turns t join people p on p.workspace_id = t.workspace_id and p.sender <> t.sender
       and contains(lower(t.text), concat('@', lower(p.sender)))
  where t.workspace_id in (select workspace_id from people group by 1 having count(*) > 2)
  group by 1, 2),
attributed as (
  select e.*, coalesce(m.mentioned, e.previous_sender) as target
  from turn_events e left join mention_table m using (workspace_id, turn_no)
  where kind in ('pickup', 'burst')),
pairs as (
  select workspace_id, least(target, sender) as person_a, greatest(target, sender) as person_b,
         cast(sum(case when target < sender then 1 else 0 end) as bigint) as a_to_b,
         cast(sum(case when target < sender then 0 else 1 end) as bigint) as b_to_a,
         count(*) as exchanges,
         case when count(*) filter (kind = 'pickup') >= 3 then median(gap_seconds) filter (kind = 'pickup') end as pickup_median,
         case when count(*) filter (kind = 'burst' and gap_seconds > 0) >= 3
              then median(gap_seconds) filter (kind = 'burst' and gap_seconds > 0) end as burst_median
  from attributed group by 1, 2, 3),
spoken as (select workspace_id, sender, count(*) as turns from turns group by 1, 2),
scored as (
  select p.*, least(100.0, round(exchanges * 100.0 / greatest(1.0, (coalesce(a.turns, 0) + coalesce(b.turns, 0)) / 2.0), 1)) as connection_score
  from pairs p
  left join spoken a on a.workspace_id = p.workspace_id and a.sender = p.person_a
  left join spoken b on b.workspace_id = p.workspace_id and b.sender = p.person_b)"""
)
