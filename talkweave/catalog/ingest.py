"""Source, cleaning and parsing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkweave.catalog import fixtures as fx
from talkweave.functions import text as tx
from talkweave.operators import ingest as ig
from talkweave.operators.turns import usable_messages
from talkweave.sources.tables import upsert

# Export lines rendered from the events; '\n' inside a block makes continuation lines.
_BLOCKS = """
select concat('w', right(cast(user_id as string), 1)) as workspace_id, event_id,
       date_trunc('minute', ts) as ts, event_type as sender, value < 0.3 as is_system,
       case when value < 0.3 then concat(event_type, ' joined')
            when value >= 200 then 'This message was deleted.'
            when value >= 100 then '<Media omitted>'
            else concat(event_type, ' ', props) end as body,
       case when value between 20 and 22 then ' <This message was edited>' else '' end as suffix,
       case when value between 30 and 33 then 'and a second line' else '' end as extra
from {events}
"""

_SQL_BLOCKS = "blocks as (" + _BLOCKS.replace("{events}", "events") + ")"


def raw_lines(spark, folder):
    blocks = spark.sql(_BLOCKS, events=fx.table(spark, folder, "events"))
    ios = F.col("workspace_id").isin("w7", "w8", "w9")
    stamp = F.when(ios, F.date_format("ts", "'['dd/MM/yyyy, HH:mm:ss'] '")).otherwise(
        F.date_format("ts", "dd/MM/yyyy, HH:mm' - '")
    )
    said = F.when(F.col("is_system"), F.col("body")).otherwise(F.concat("sender", F.lit(": "), "body"))
    head = F.concat(F.when(F.col("suffix") != "", "‎").otherwise(""), stamp, said, "suffix")
    text = F.when(F.col("extra") != "", F.concat(head, F.lit("\n  \n"), "extra")).otherwise(head)
    return blocks.select("workspace_id", "event_id", F.posexplode(F.split(text, "\n")).alias("i", "line")).select(
        "workspace_id", (F.col("event_id") * 4 + F.col("i")).alias("seq"), "line"
    )


def _roundtrip(spark, folder):
    messages, _ = ig.parse_exports(raw_lines(spark, folder), fx.BLOCK)
    return messages.select("workspace_id", "seq", "ts", "sender", "text", "is_system")


def _clean_text(spark, folder):
    d = fx.table(spark, folder, "documents")
    # A few dirty ends so that every rule has work to do on every text.
    dirty = F.concat(F.lit("﻿ \r\n"), "text", F.lit("‎  <this message was EDITED> \r\n\r\nThis message was deleted.\r"))
    return d.select("doc_id", ig.clean_text(dirty).alias("text"))


def _stitch(spark, folder):
    rows = fx.lines(spark, folder).select(
        "doc_id", F.col("line_no").alias("seq"), "line", F.col("line").rlike(r"^\p{Lu}\p{L}+ ").alias("is_header")
    )
    return ig.stitch_lines(rows, "doc_id", fx.BLOCK).select("doc_id", "header_seq", "line_count", "text")


def _noise(spark, folder):
    return fx.messages_ev(spark, folder).select("message_id", tx.is_noise(F.col("text")).alias("is_noise"))


def _usable(spark, folder):
    return usable_messages(fx.messages_conv(spark, folder)).select("workspace_id", "message_id", "sender")


def _changes(spark, folder):
    """A second batch: one vector per labelled document, keyed in the same id space."""
    e, l = fx.table(spark, folder, "embeddings"), fx.table(spark, folder, "labels")
    labelled = l.groupBy(F.col("doc_id").alias("message_id")).agg(F.max("quality").alias("label"))
    return labelled.join(e.select(F.col("vec_id").alias("message_id"), "embedding"), "message_id", "left").select(
        "message_id", (F.col("label") + 100).cast("bigint").alias("label"), F.size("embedding").cast("bigint").alias("dims")
    )


def _upsert(spark, folder):
    e = fx.table(spark, folder, "embeddings")
    current = e.select(
        F.col("vec_id").alias("message_id"), F.col("label").cast("bigint").alias("label"),
        F.size("embedding").cast("bigint").alias("dims"),
    )
    return upsert(current, _changes(spark, folder).withColumn("dims", F.coalesce("dims", F.lit(-1))), ["message_id"])


EDITED_SQL = r"regexp_replace(regexp_replace(x, '\s+$', ''), '(?i)\s*<This message was edited>\s*$', '')"
DEL = r"(?i)^This message was deleted\.?$"
HEADISH = r"^\[?\d{1,2}/\d{1,2}/\d{2,4},\s+\d{1,2}:\d{2}"

ENTRIES = {
    "parse_roundtrip": (
        _roundtrip,
        f"""with {_SQL_BLOCKS} select workspace_id, event_id * 4 as seq, ts,
 case when is_system then 'System' else sender end as sender,
 case when body = 'This message was deleted.' and extra = '' then '[message deleted]'
      when extra <> '' then concat(body, chr(10), extra) else body end as text, is_system
 from blocks""",
    ),
    "clean_text": (
        _clean_text,
        rf"""with dirty as (select doc_id, concat(chr(65279), ' ', chr(13), chr(10), text, chr(8206),
   '  <this message was EDITED> ', chr(13), chr(10), chr(13), chr(10), 'This message was deleted.', chr(13)) as t from documents),
 a as (select doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'),
   '[\x{{FEFF}}\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2060}}]', '', 'g'), '[\x{{202F}}\x{{00A0}}]', ' ', 'g'), chr(10)) as ls from dirty),
 l as (select doc_id, i, ls[i] as x from a, unnest(range(1, len(ls) + 1)) as u(i)),
 c as (select doc_id, i, regexp_replace(x, '\s+$', '') = '' as blank, {EDITED_SQL} as b, regexp_matches(x, '{HEADISH}') as h from l),
 f as (select *, min(case when not blank then i end) over (partition by doc_id) as first_text from c)
 select doc_id, string_agg(case when not h and regexp_matches({fx.strip_sql('b')}, '{DEL}') then '[message deleted]'
   when h and contains(b, ': ') and regexp_matches({fx.strip_sql("string_split(b, ': ')[-1]")}, '{DEL}')
   then concat(left(b, length(b) - length(string_split(b, ': ')[-1])), '[message deleted]') else b end, chr(10) order by i) as text
 from f where not blank or first_text is null or i < first_text group by 1""",
    ),
    "stitch_lines": (
        _stitch,
        rf"""with {fx.SQL_LINES}, h as (select *, max(case when regexp_matches(line, '^\p{{Lu}}\p{{L}}+ ') then line_no end)
 over (partition by doc_id order by line_no) as header_seq from lines)
 select doc_id, header_seq, count(*) as line_count, string_agg(line, chr(10) order by line_no) as text
 from h where header_seq is not null group by 1, 2""",
    ),
    "noise_flag": (
        _noise,
        f"with {fx.SQL_MESSAGES_EV} select message_id, {fx.noise_sql('text')} as is_noise from messages_ev",
    ),
    "usable_messages": (
        _usable,
        f"with {fx.SQL_MESSAGES_CONV} select workspace_id, message_id, sender from messages_conv where not is_system and not {fx.noise_sql('text')}",
    ),
    "ingest_gate": (
        lambda s, d: ig.ingest_gate(fx.messages_conv(s, d), 4),
        f"""with {fx.SQL_MESSAGES_CONV} select workspace_id, count(*) filter (not is_system and not {fx.noise_sql('text')}) as usable_count,
 count(*) filter (not is_system and not {fx.noise_sql('text')}) >= 4 as eligible from messages_conv group by 1""",
    ),
    "vector_upsert": (
        _upsert,
        """with changes as (select l.doc_id as message_id, l.label, e.dims from (select doc_id, cast(max(quality) + 100 as bigint) as label from labels group by 1) l
 left join (select vec_id, cast(len(embedding) as bigint) as dims from embeddings) e on e.vec_id = l.doc_id)
 select message_id, label, coalesce(dims, -1) as dims from changes
 union all select vec_id, cast(label as bigint), cast(len(embedding) as bigint) from embeddings where vec_id not in (select message_id from changes)""",
    ),
}
