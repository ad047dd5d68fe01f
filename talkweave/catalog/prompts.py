"""Prompt row, packing, rewrite and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkweave.catalog import fixtures as fx
from talkweave.catalog.analytics import usable
from talkweave.catalog.context import C, even_sql, line
from talkweave.functions import model_output as mo
from talkweave.functions import text as tx
from talkweave.operators import analytics as an
from talkweave.operators import context as cx
from talkweave.operators import packing, prompts, sampling
from talkweave.plans.ordered import dense_position, seq_levels

WS = "workspace_id"


def _chunks(spark, folder):
    d = fx.table(spark, folder, "documents").select("source", "doc_id", tx.token_estimate(F.col("text")).alias("est"))
    newest = dense_position(
        d.withColumn("age", -F.col("doc_id")), ["source"], [F.col("age")], seq_levels("age", fx.BLOCK)
    )
    items = newest.select("source", "doc_id", "pos", (F.col("est") * 2).alias("tokens"))
    return packing.pack(items, ["source"], 20, 30_000, fx.BLOCK).select("source", "doc_id", "chunk_no")


def _recent(spark, folder):
    return cx.recent_turns(line(spark, folder), 2, fx.BLOCK)


def _context_query(spark, folder):
    q = mo.context_query(F.col("text"), F.col("recent"), 12)
    return _recent(spark, folder).select("message_id", F.coalesce(q, F.lit("")).alias("query"))


def _sanity(spark, folder):
    rows = _recent(spark, folder).filter("recent is not null")
    rewrites = F.split("text", r"\. ")
    kept = mo.sane_rewrites(F.col("text"), F.col("recent"), rewrites, 12)
    return rows.select("message_id", F.size(kept).cast("bigint").alias("kept"))


def sampled_exchanges(spark, folder):
    """Recency sample of every person's messages with the exchange that led to each."""
    messages = usable(spark, folder)
    marks = messages.select(WS, "message_id", "sender", "ts", "seq", (~tx.is_noise(F.col("text"))).alias("readable"))
    pairs = cx.exchange_partners(cx.timeline(marks, fx.BLOCK), 8, fx.BLOCK).select(WS, "message_id", "partner_id")
    own = sampling.person_positions(marks, fx.BLOCK)
    sampled = sampling.recency_sample(own, 60).select(WS, "sender", "pos", "message_id").join(pairs, [WS, "message_id"])
    return cx.exchange_texts(sampled, messages).select(WS, "message_id", "sender", "pos", "exchange")


def _prompt_rows(spark, folder):
    rows = prompts.prompt_rows(sampled_exchanges(spark, folder))
    return rows.select(WS, "sender", "task", "est_tokens", F.sha2("prompt", 256).alias("prompt_hash"))


SECTIONS = ("listening", "analysis", "writing", "personality")


def _cap(spark, folder):
    """The turns of a dialogue are dealt to the sections and the voice samples in order, all of them."""
    m = fx.messages_conv(spark, folder)
    own = "listagg(CASE WHEN seq % 5 = {} THEN text END, '\n') WITHIN GROUP (ORDER BY seq)"
    s = m.groupBy(WS).agg(*[F.expr(own.format(i)).alias(c) for i, c in enumerate((*SECTIONS, "voice"))])
    out = prompts.cap_sections(s, ["voice"], 1200)
    return out.select(WS, "size", "capped_size", *[(F.col(c) != "").alias(c) for c in SECTIONS])


def _merge(spark, folder):
    m = usable(spark, folder)
    people = an.people_roster(m).select(WS, "sender", "status", F.lit("none yet").alias("notes"))
    told = m.filter(F.contains("text", F.lit("yaar"))).groupBy(WS, "sender").agg(F.count(F.lit(1)).alias("n"))
    updates = told.select(
        WS, "sender",
        F.when(F.col("n") >= 4, F.concat(F.lit("says yaar "), F.col("n").cast("string"))).alias("notes"),
    )
    return prompts.merge_profiles(people, updates, [WS, "sender"])


TASK_ROWS = ", ".join(f"('{t}', '{i}')" for t, i in prompts.TASKS.items())

ENTRIES = {
    "token_chunks": (
        _chunks,
        """with recursive t as (select source, doc_id, row_number() over (partition by source order by doc_id desc) as i, 2 * greatest(1, length(text) // 4) as tok from documents),
 r as (select source, doc_id, i, 0 as chunk_no, 1 as items, tok as used from t where i = 1
  union all select t.source, t.doc_id, t.i, case when r.items >= 20 or r.used + t.tok > 30000 then r.chunk_no + 1 else r.chunk_no end,
   case when r.items >= 20 or r.used + t.tok > 30000 then 1 else r.items + 1 end,
   case when r.items >= 20 or r.used + t.tok > 30000 then t.tok else r.used + t.tok end
  from r join t on t.source = r.source and t.i = r.i + 1)
 select source, doc_id, cast(chunk_no as bigint) as chunk_no from r""",
    ),
    "context_query": (
        _context_query,
        C
        + rf""", r as (select *, case when pos = 0 then null when pos = 1 then lag(text) over w else concat(lag(text, 2) over w, ' ', lag(text) over w) end as recent
  from line window w as (partition by workspace_id order by pos)),
 q as (select *, left({fx.strip_sql("concat(text, ' ', recent)")}, 200) as combined from r)
 select message_id, case when recent is not null and len(regexp_extract_all(text, '\S+')) <= 12 and combined <> text then combined else '' end as query from q""",
    ),
    "rewrite_sanity": (
        _sanity,
        C
        + rf""", r as (select *, case when pos = 1 then lag(text) over w else concat(lag(text, 2) over w, ' ', lag(text) over w) end as recent
  from line window w as (partition by workspace_id order by pos)),
 q as (select message_id, text, string_split(text, '. ') as rw, [x for x in regexp_split_to_array(lower(recent), '[^\p{{L}}\p{{N}}_]+') if length(x) > 2] as ws from r where pos > 0)
 select message_id, case when len(regexp_extract_all(text, '\S+')) <= 12 and len(ws) > 0 and len([x for x in ws if contains(lower(array_to_string(rw, ' ')), x)]) = 0
  then 0 else len(rw) end as kept from q""",
    ),
    "prompt_rows": (
        _prompt_rows,
        f"""with {fx.SQL_USABLE}, pp as (select *, row_number() over (partition by workspace_id, sender order by ts, seq) - 1 as pos, count(*) over (partition by workspace_id, sender) as n,
  row_number() over (partition by workspace_id order by ts, seq) - 1 as tpos from usable),
 q as (select *, greatest(1, n * 2 // 3) as split from pp), r as (select *, least(36, n - split) as nr, least(60 - least(36, n - split), split) as no from q),
 s as (select * from r where n <= 60 or case when pos < split then {even_sql('pos', 'split', 'no')} else {even_sql('(pos - split)', '(n - split)', 'nr')} end),
 prev as (select a.workspace_id, a.tpos, max(p.tpos) as ppos from s a join pp p on p.workspace_id = a.workspace_id and p.tpos < a.tpos and p.tpos >= a.tpos - 8 and p.sender <> a.sender group by 1, 2),
 ex as (select a.workspace_id, a.sender, a.pos, concat(case when p.tpos is not null then concat('[', p.sender, ']: ', p.text, chr(10)) else '' end, '[', a.sender, ']: ', a.text) as exchange
  from s a left join prev v on v.workspace_id = a.workspace_id and v.tpos = a.tpos left join pp p on p.workspace_id = v.workspace_id and p.tpos = v.ppos),
 body as (select workspace_id, sender, string_agg(exchange, chr(10) || chr(10) order by pos) as body from ex group by 1, 2),
 pr as (select workspace_id, sender, task, concat(replace(instruction, '{{name}}', sender), chr(10), chr(10), body) as prompt from body, (values {TASK_ROWS}) t(task, instruction))
 select workspace_id, sender, task, greatest(1, length(prompt) // 4) as est_tokens, sha256(prompt) as prompt_hash from pr""",
    ),
    "prompt_cap": (
        _cap,
        C
        + """, s as (select workspace_id, """
        + ", ".join(f"coalesce(length(string_agg(text, chr(10) order by seq) filter (seq % 5 = {i})), 0) as {c}" for i, c in enumerate("lawpv"))
        + """ from messages_conv group by 1),
 t as (select *, l + a + w + p + v as s0 from s), t1 as (select *, case when s0 > 1200 then s0 - l else s0 end as s1 from t),
 t2 as (select *, case when s1 > 1200 then s1 - a else s1 end as s2 from t1), t3 as (select *, case when s2 > 1200 then s2 - w else s2 end as s3 from t2),
 t4 as (select *, case when s3 > 1200 then s3 - p else s3 end as s4 from t3)
 select workspace_id, s0 as size, s4 as capped_size, s0 <= 1200 and l > 0 as listening, s1 <= 1200 and a > 0 as analysis, s2 <= 1200 and w > 0 as writing, s3 <= 1200 and p > 0 as personality from t4""",
    ),
    "profile_merge": (
        _merge,
        f"""with {fx.SQL_USABLE}, c as (select workspace_id, sender, count(*) as n, count(*) filter (contains(text, 'yaar')) as y from usable group by 1, 2)
 select workspace_id, sender, case when n < 50 then 'not_enough' when n < 200 then 'thin' else 'ready' end as status,
 case when y >= 4 then concat('says yaar ', y) else 'none yet' end as notes from c""",
    ),
}
