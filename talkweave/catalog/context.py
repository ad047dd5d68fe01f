"""Context, excerpt, sampling and voice queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkweave.catalog import fixtures as fx
from talkweave.catalog.analytics import usable
from talkweave.functions import text as tx
from talkweave.operators import context as cx
from talkweave.operators import sampling, voice
from talkweave.operators.turns import usable_messages

WS = "workspace_id"


def line(spark, folder):
    return cx.timeline(usable_messages(fx.messages_conv(spark, folder)), fx.BLOCK)


def raw_hits(spark, folder):
    """Hits of one request per dialogue; the timeline lacks the system rows among them."""
    m = fx.messages_conv(spark, folder)
    size = F.length("text")
    return m.filter(F.col("is_system") | (F.col("sender") == "user") & tx.strip(F.col("text")).rlike(r"[.,]\s")).select(
        F.col(WS).alias("request_id"), WS, "message_id", (size / (size + 200.0)).alias("score"),
        F.col("sender").alias("speaker"), "ts", tx.snippet(F.col("text")).alias("snippet"),
        F.lit("assistant").alias("target_person"),
    )


# Hits of a chat turn and of a question.
CHAT_HITS, QA_HITS = 8, 20


def hits(spark, folder, k):
    ranked = cx.top_rows(raw_hits(spark, folder), ["request_id"], [F.col("score").desc(), F.col("message_id")], k)
    return ranked.drop("rank")


def _positions(spark, folder):
    placed = raw_hits(spark, folder).join(
        line(spark, folder).select(WS, "message_id", "pos"), [WS, "message_id"], "left"
    )
    return placed.select(WS, "message_id", F.coalesce("pos", F.lit(-1)).alias("pos"))


def _windows(spark, folder):
    return cx.hit_windows(raw_hits(spark, folder), line(spark, folder)).select(WS, "message_id", "start", "end")


def ev_hits(spark, folder):
    """Hits spread over the long event timelines, so that merging has gaps to find."""
    m = usable(spark, folder)
    return m.filter("text like '%@Purchase%'").select(
        F.col(WS).alias("request_id"), WS, "message_id", (F.length("text") / 100.0).alias("score")
    )


def _merged(spark, folder):
    t = cx.timeline(usable(spark, folder), fx.BLOCK)
    merged = cx.merge_intervals(cx.hit_windows(ev_hits(spark, folder), t), fx.BLOCK)
    return merged.select("request_id", "range_no", "start", "end", F.round("score", 6).alias("score"))


def _blocks(spark, folder):
    return cx.context_blocks(hits(spark, folder, CHAT_HITS), line(spark, folder), 0.6, 5, fx.BLOCK)


def _blocks_qa(spark, folder):
    return cx.context_blocks_qa(hits(spark, folder, QA_HITS), line(spark, folder), 5, fx.BLOCK)


def _snippets(spark, folder):
    return cx.conversation_snippets(line(spark, folder), 2, 6, fx.BLOCK).select(WS, "sender", "first_pos", "snippet")


def _tail(spark, folder):
    t = cx.history_tail(fx.messages_conv(spark, folder), 4)
    return t.select(WS, "seq", F.col("back").cast("bigint").alias("back"))


def _budget(spark, folder):
    return cx.history_budget(fx.messages_conv(spark, folder), 6, 3, 1500).select(WS, "seq")


def _split(spark, folder):
    return cx.summary_split(line(spark, folder), 5, 2).select(WS, "seq", "use")


def positioned(spark, folder):
    return sampling.person_positions(usable(spark, folder), fx.BLOCK)


def _monthly(spark, folder):
    # Weeks stand in for months of a longer chat: the month of a message is 28 times its day.
    m = usable(spark, folder).withColumn("ts", F.expr("TIMESTAMP_NTZ'2023-01-01 00:00:00' + make_dt_interval(28 * (day(ts) - 1), hour(ts), minute(ts), 0)"))
    picked = sampling.monthly_samples(m, 40, fx.BLOCK)
    return picked.select(WS, "sender", "message_id", tx.snippet(F.col("text"), 280).alias("text"))


def voice_candidates(spark, folder):
    """Candidates from the five-sender chats and from the two-sender dialogues."""
    chats = cx.timeline(usable(spark, folder), fx.BLOCK).select(WS, "pos", "sender", "text")
    return voice.voice_candidates(
        chats.unionByName(line(spark, folder).select(WS, "pos", "sender", "text")), fx.BLOCK
    )


def _candidates(spark, folder):
    body = F.array_join(F.transform("exchange", lambda m: F.concat(m["sender"], F.lit(":"), m["text"])), "|")
    return voice_candidates(spark, folder).select(WS, "sender", "pos", body.alias("exchange"), "topic", "score")


def _scores(spark, folder):
    """Whole dialogues scored as one exchange per participant."""
    m = fx.messages_conv(spark, folder)
    # A dialogue is cut where a window of four messages ends, so an exchange stays bounded.
    rows = m.withColumn("part", cx.block_of("seq", 4)).groupBy(WS, "part").agg(
        F.array_sort(F.collect_list(F.struct("seq", "sender", "text"))).alias("exchange")
    )
    people = F.explode(F.array_distinct(F.transform("exchange", lambda x: x["sender"])))
    return rows.withColumn("sender", people).select(
        WS, "part", "sender", voice.exchange_score(F.col("exchange"), F.col("sender")).alias("score")
    )


def _samples(spark, folder):
    pool = voice.materialise(voice_candidates(spark, folder))
    rows = voice.labelled_samples(voice.voice_samples(pool))
    body = F.array_join(F.transform("exchange", lambda m: F.concat(m["sender"], F.lit(":"), m["text"])), "|")
    return rows.select(
        WS, "sender", F.col("sample_no").cast("bigint").alias("sample_no"), "score", "context", body.alias("exchange")
    )


C = f"with {fx.SQL_MESSAGES_CONV}, line as (select *, row_number() over (partition by workspace_id order by ts, seq) - 1 as pos, count(*) over (partition by workspace_id) as n from messages_conv where not is_system and not " + fx.noise_sql("text") + ")"
RAW = C + rf""", raw as (select workspace_id as request_id, workspace_id, message_id,
 length(text) / (length(text) + 200.0) as score, sender as speaker, ts, left(text, 500) as snippet from messages_conv
 where is_system or (sender = 'user' and regexp_matches({fx.strip_sql('text')}, '[.,]\s')))"""


def hits_sql(k: int) -> str:
    return RAW + f""", hits as (select * from (select *, row_number() over (partition by request_id order by score desc, message_id) as rank from raw) z where rank <= {k}),
 win as (select h.request_id, h.score, l.pos, greatest(0, l.pos - 3) as s, least(l.n, l.pos + 5) as e from hits h join line l on l.workspace_id = h.workspace_id and l.message_id = h.message_id),
 folded as (select request_id, s, e, max(score) as score from win group by 1, 2, 3)"""


def merge_sql(source: str) -> str:
    return f"""reach as (select *, max(e) over (partition by request_id order by s, e rows between unbounded preceding and 1 preceding) as prev from {source}),
 opened as (select *, sum(case when prev is null or s > prev + 2 then 1 else 0 end) over (partition by request_id order by s, e rows unbounded preceding) - 1 as range_no from reach),
 ranges as (select request_id, cast(range_no as bigint) as range_no, min(s) as s, max(e) as e, max(score) as score from opened group by 1, 2)"""


EV = f"with {fx.SQL_USABLE}, pp as (select *, row_number() over (partition by workspace_id, sender order by ts, seq) - 1 as pos, count(*) over (partition by workspace_id, sender) as n from usable)"


def even_sql(i: str, n: str, k: str) -> str:
    step = f"greatest(({n} - 1) // greatest({k} - 1, 1), 1)"
    return f"""(case when {k} <= 0 then false when {n} <= {k} then true when {k} = 1 then {i} = {n} // 2
 else ({i} % {step} = 0 or {i} = {n} - 1) and {i} // {step} + (case when {i} % {step} = 0 then 0 else 1 end) < {k} end)"""


def ack_sql(b: str) -> str:
    return f"(length({b}) <= 4 or (length({b}) <= 8 and not contains(substr({b}, 5), ' ')))"


def words_sql(b: str) -> str:
    return rf"len(regexp_extract_all({b}, '\S+'))"


def _topic_case(col: str) -> str:
    counts = ", ".join(
        "(" + " + ".join(f"cast(contains({col}, '{w}') as int)" for w in words) + ")" for words in tx.TOPICS.values()
    )
    names = "[" + ", ".join(f"'{t}'" for t in tx.TOPICS) + "]"
    return f"case when list_max([{counts}]) = 0 then 'general' else {names}[list_position([{counts}], list_max([{counts}]))] end"


VOICE = C + f""", {fx.SQL_USABLE}, both_lines as (select workspace_id, pos, sender, text from line union all
 select workspace_id, row_number() over (partition by workspace_id order by ts, seq) - 1, sender, text from usable),
 ln as (select *, {fx.strip_sql('text')} as b, {fx.noise_sql('text')} as noise from both_lines),
 w as (select a.workspace_id, a.sender as person, a.pos as anchor, m.pos, m.sender, m.b,
   row_number() over (partition by a.workspace_id, a.pos order by m.pos) as i
  from ln a join ln m on m.workspace_id = a.workspace_id and m.pos >= greatest(a.pos - 1, 0) and m.pos < greatest(a.pos - 1, 0) + 10 and not m.noise
  where not a.noise),
 first2 as (select workspace_id, anchor, sender, min(i) as i from w group by 1, 2, 3),
 nth as (select *, row_number() over (partition by workspace_id, anchor order by i) as k from first2),
 third as (select workspace_id, anchor, min(case when k = 3 then i end) as stop from nth group by 1, 2),
 win as (select w.* from w join third t using (workspace_id, anchor) where (t.stop is null or w.i < t.stop) and w.i <= 4),
 ex as (select workspace_id, person as sender, anchor as pos, string_agg(concat(sender, ':', b), '|' order by i) as exchange,
   lower(string_agg(lower(b), ' ' order by i)) as all_text,
   count(*) filter (sender = person) as own, count(*) as m, min({words_sql('b')}) as least_words,
   bool_or(sender = person and length(b) > 10 and not {ack_sql('b')}) as says,
   count(*) filter (sender = person and length(b) > 15) as long_own, bool_or(sender = person and not {ack_sql('b')}) as content
  from win group by 1, 2, 3)"""

ENTRIES = {
    "hit_positions": (
        _positions,
        RAW + " select r.workspace_id, r.message_id, coalesce(l.pos, -1) as pos from raw r left join line l on l.workspace_id = r.workspace_id and l.message_id = r.message_id",
    ),
    "hit_windows": (
        _windows,
        RAW
        + ' select r.workspace_id, r.message_id, greatest(0, l.pos - 3) as start, least(l.n, l.pos + 5) as "end" from raw r join line l on l.workspace_id = r.workspace_id and l.message_id = r.message_id',
    ),
    "merge_intervals": (
        _merged,
        f"""with {fx.SQL_USABLE}, line as (select *, row_number() over (partition by workspace_id order by ts, seq) - 1 as pos, count(*) over (partition by workspace_id) as n from usable),
 win as (select workspace_id as request_id, greatest(0, pos - 3) as s, least(n, pos + 5) as e, length(text) / 100.0 as score from line where contains(text, '@Purchase')), {merge_sql('win')}
 select request_id, range_no, s as start, e as "end", round(cast(score as double), 6) as score from ranges""",
    ),
    "context_blocks": (
        _blocks,
        hits_sql(CHAT_HITS)
        + f""", {merge_sql('folded')}, blk as (select r.request_id, r.range_no, r.s, r.score, bool_or(lower(l.sender) = 'assistant' or contains(lower(l.text), 'assistant')) as about,
   {fx.strip_sql("string_agg(concat(l.sender, ': ', l.text), chr(10) order by l.pos)")} as text
  from ranges r join line l on l.workspace_id = r.request_id and l.pos >= r.s and l.pos < r.e group by 1, 2, 3, 4),
 miss as (select h.request_id, concat(speaker, ' (', strftime(ts, '%Y-%m-%d %H:%M'), '): ', snippet) as text, max(score) as score, min(h.message_id) as mid
  from hits h where not exists (select 1 from line l where l.workspace_id = h.workspace_id and l.message_id = h.message_id) group by 1, 2),
 allb as (select request_id, 0 as kind, cast(s as double) as place, '' as tie, text from blk where text <> '' and (score >= 0.6 or about)
  union all select request_id, 1, -score, cast(mid as varchar), text from miss where score >= 0.6 or contains(lower(text), 'assistant')),
 num as (select *, row_number() over (partition by request_id order by kind, place, tie) as block_no from allb)
 select request_id, block_no, text from num where block_no <= 5""",
    ),
    "context_blocks_qa": (
        _blocks_qa,
        hits_sql(QA_HITS)
        + f""", {merge_sql('folded')}, first5 as (select *, row_number() over (partition by request_id order by s) as block_no from ranges)
 select f.request_id, f.block_no, l.pos, l.sender as speaker, strftime(l.ts, '%Y-%m-%d %H:%M') as ts, l.text,
  exists (select 1 from win w where w.request_id = f.request_id and w.pos = l.pos) as is_hit
 from first5 f join line l on l.workspace_id = f.request_id and l.pos >= f.s and l.pos < f.e where f.block_no <= 5 and not {fx.noise_sql('l.text')}""",
    ),
    "rendered_blocks": (
        lambda s, d: cx.render_blocks(_blocks_qa(s, d)),
        hits_sql(QA_HITS)
        + f""", {merge_sql('folded')}, first5 as (select *, row_number() over (partition by request_id order by s) as block_no from ranges),
 r as (select f.request_id, f.block_no, l.pos, l.sender as speaker, strftime(l.ts, '%Y-%m-%d %H:%M') as ts, l.text,
  exists (select 1 from win w where w.request_id = f.request_id and w.pos = l.pos) as is_hit
 from first5 f join line l on l.workspace_id = f.request_id and l.pos >= f.s and l.pos < f.e where f.block_no <= 5 and not {fx.noise_sql('l.text')})
 select request_id, block_no, string_agg(concat(case when is_hit then '>>> ' else '    ' end, speaker, ' (', ts, '): ', text), chr(10) order by pos) as text from r group by 1, 2""",
    ),
    "row_windows": (
        lambda s, d: cx.row_windows(line(s, d), block=fx.BLOCK),
        C
        + """ select workspace_id, pos, min(pos) over w as first_pos, max(pos) over w as last_pos, cast(sum(length(text)) over w as bigint) as chars from line
 window w as (partition by workspace_id order by pos rows between 3 preceding and 4 following)""",
    ),
    "paired_exchanges": (
        lambda s, d: cx.paired_exchanges(line(s, d), 8, fx.BLOCK).select(WS, "message_id", "exchange"),
        C
        + f""", ln as (select *, {fx.noise_sql('text')} as noise from line),
 prev as (select a.workspace_id, a.pos, max(p.pos) as ppos from ln a join ln p on p.workspace_id = a.workspace_id and p.pos < a.pos and p.pos >= a.pos - 8
   and p.sender <> a.sender and not p.noise group by 1, 2)
 select a.workspace_id, a.message_id, concat(case when p.pos is not null then concat('[', p.sender, ']: ', p.text, chr(10)) else '' end, '[', a.sender, ']: ', a.text) as exchange
 from ln a left join prev v on v.workspace_id = a.workspace_id and v.pos = a.pos left join ln p on p.workspace_id = v.workspace_id and p.pos = v.ppos where not a.noise""",
    ),
    "conversation_snippets": (
        _snippets,
        C
        + f""", c as (select a.workspace_id, a.sender, a.pos, string_agg(concat(m.sender, ': ', m.text), chr(10) order by m.pos) as snippet from line a join line m
  on m.workspace_id = a.workspace_id and m.pos between a.pos - 6 and a.pos where a.pos >= 1 and {fx.strip_sql('a.text')} <> '' group by 1, 2, 3),
 d as (select workspace_id, sender, snippet, min(pos) as first_pos from c group by 1, 2, 3),
 r as (select *, row_number() over (partition by workspace_id, sender order by first_pos) - 1 as i, count(*) over (partition by workspace_id, sender) as n from d)
 select workspace_id, sender, first_pos, snippet from r where {even_sql('i', 'n', '2')}""",
    ),
    "history_tail": (
        _tail,
        C + " select workspace_id, seq, back from (select *, row_number() over (partition by workspace_id order by seq desc) as back from messages_conv) x where back <= 4",
    ),
    "history_budget": (
        _budget,
        C
        + """, t as (select *, row_number() over (partition by workspace_id order by seq desc) as back from messages_conv),
 s as (select *, sum(length(text)) over (partition by workspace_id) as chars from t where back <= 6) select workspace_id, seq from s where chars <= 1500 or back <= 3""",
    ),
    "flatten_dialogue": (
        lambda s, d: cx.flatten_dialogue(fx.messages_conv(s, d)).select(WS, "dialogue"),
        C + " select workspace_id, string_agg(concat(case when sender = 'user' then 'User' else sender end, ': ', text), chr(10) order by seq) as dialogue from messages_conv group by 1",
    ),
    "summary_split": (
        _split,
        C + " select workspace_id, seq, case when n > 5 and pos < n - 2 then 'summarise' else 'verbatim' end as use from line",
    ),
    "spread_evenly": (
        lambda s, d: sampling.spread_evenly(positioned(s, d), 12).select(WS, "sender", "message_id"),
        EV + f" select workspace_id, sender, message_id from pp where {even_sql('pos', 'n', '12')}",
    ),
    "recency_sample": (
        lambda s, d: sampling.recency_sample(positioned(s, d), 60).select(WS, "sender", "message_id"),
        EV
        + f""", q as (select *, greatest(1, n * 2 // 3) as split from pp), r as (select *, least(36, n - split) as nr, least(60 - least(36, n - split), split) as no from q)
 select workspace_id, sender, message_id from r where n <= 60 or case when pos < split then {even_sql('pos', 'split', 'no')} else {even_sql('(pos - split)', '(n - split)', 'nr')} end""",
    ),
    "monthly_samples": (
        _monthly,
        f"with {fx.SQL_USABLE}, "
        + f"""u as (select workspace_id, seq, sender, message_id, text, timestamp '2023-01-01' + to_days(cast(28 * (day(ts) - 1) as int)) + to_hours(cast(hour(ts) as int)) + to_minutes(cast(minute(ts) as int)) as ts from usable),
 m as (select *, row_number() over (partition by workspace_id, sender, date_trunc('month', ts) order by ts desc, seq) as rn from u),
 mm as (select *, row_number() over (partition by workspace_id, sender order by ts desc) as back from m where rn = 1),
 picked as (select * from mm where back <= 40), cnt as (select workspace_id, sender, count(*) as taken from picked group by 1, 2),
 others as (select u.*, row_number() over (partition by u.workspace_id, u.sender order by u.ts, u.seq) - 1 as pos, count(*) over (partition by u.workspace_id, u.sender) as n
  from u where message_id not in (select message_id from picked)),
 extra as (select o.* from others o join cnt using (workspace_id, sender) where {even_sql('pos', 'n', '(40 - taken)')})
 select workspace_id, sender, message_id, left(text, 280) as text from picked union all select workspace_id, sender, message_id, left(text, 280) from extra""",
    ),
    "voice_candidates": (
        _candidates,
        VOICE
        + f""" select workspace_id, sender, pos, exchange, {_topic_case('all_text')} as topic,
 cast((case when own >= 2 then 2 else 0 end) + long_own + 1 + (case when content then 2 else 0 end) as bigint) as score
 from ex where own > 0 and own < m and least_words > 1 and says""",
    ),
    "exchange_score": (
        _scores,
        C
        + f""", p as (select *, seq // 4 as part, {fx.strip_sql('text')} as b from messages_conv),
 who as (select distinct workspace_id, part, sender from p)
 select w.workspace_id, w.part, w.sender, cast((case when count(*) filter (p.sender = w.sender) >= 2 then 2 else 0 end)
  + count(*) filter (p.sender = w.sender and length(b) > 15) + (case when bool_or(p.sender <> w.sender) then 1 else 0 end)
  + (case when bool_or(p.sender = w.sender and not {ack_sql('b')}) then 2 else 0 end) as bigint) as score
 from who w join p on p.workspace_id = w.workspace_id and p.part = w.part group by 1, 2, 3""",
    ),
    "voice_samples": (
        _samples,
        VOICE.replace("with ", "with recursive ", 1)
        + f""", lists as (select workspace_id, person as sender, anchor as pos, list_sort(list_distinct(list(b))) as texts from win group by 1, 2, 3),
 cand as (select ex.workspace_id, ex.sender, ex.pos, exchange, texts, {_topic_case('all_text')} as topic,
   cast((case when own >= 2 then 2 else 0 end) + long_own + 1 + (case when content then 2 else 0 end) as bigint) as score
  from ex join lists l on l.workspace_id = ex.workspace_id and l.sender = ex.sender and l.pos = ex.pos where own > 0 and own < m and least_words > 1 and says),
 tops as (select *, row_number() over (partition by workspace_id, sender, topic order by score desc, pos) as r,
   min(pos) over (partition by workspace_id, sender, topic) as first_pos from cand),
 both_phases as (select workspace_id, sender, exchange, texts, score, 1 as phase, first_pos as place from tops where r = 1
  union all select workspace_id, sender, exchange, texts, score, 2, pos from cand),
 seq as (select *, row_number() over (partition by workspace_id, sender order by phase, score desc, place) as i from both_phases),
 scan as (select distinct workspace_id, sender, cast(0 as bigint) as i, cast([] as varchar[][]) as kept, false as took from cand
  union all select s.workspace_id, s.sender, s.i,
   case when (s.phase = 1 or len(kept) < 5) and len(list_filter(kept, lambda k: len(list_intersect(k, s.texts)) > 0.6 * (len(k) + len(s.texts) - len(list_intersect(k, s.texts))))) = 0
    then list_append(kept, s.texts) else kept end,
   (s.phase = 1 or len(kept) < 5) and len(list_filter(kept, lambda k: len(list_intersect(k, s.texts)) > 0.6 * (len(k) + len(s.texts) - len(list_intersect(k, s.texts))))) = 0
  from scan join seq s on s.workspace_id = scan.workspace_id and s.sender = scan.sender and s.i = scan.i + 1 where s.phase = 1 or len(kept) < 5)
 select s.workspace_id, s.sender, cast(len(kept) - 1 as bigint) as sample_no, case when phase = 1 then score else 0 end as score,
  concat(trim(split_part(s.sender, ',', 1)), ' speaking') as context, exchange
 from scan join seq s on s.workspace_id = scan.workspace_id and s.sender = scan.sender and s.i = scan.i where took and len(kept) <= 8""",
    ),
}
