"""Text metric, label, routing and model-output queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkweave.catalog import fixtures as fx
from talkweave.catalog.analytics import events, usable
from talkweave.functions import model_output as mo
from talkweave.functions import scores as sc
from talkweave.functions import text as tx
from talkweave.operators import routing, style
from talkweave.operators.search import each_term, unit_vector

WORD = r"[\p{L}\p{N}_]+"
TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"


def wc(expr: str) -> str:
    return rf"len(regexp_extract_all({expr}, '\S+'))"


LEX = "[" + ", ".join(f"'{w}'" for w in tx.CODEMIX_WORDS) + "]"
EMOJI_SQL = r"len(regexp_extract_all(text, '[\x{1F300}-\x{1FAFF}]')) / cast(greatest(length(text), 1) as double)"
MIX_SQL = (
    r"least(1.0, (len(regexp_extract_all(text, '[\x{0900}-\x{097F}]')) + 3 * len([t for t in "
    + TOK
    + f" if list_contains({LEX}, t)])) / cast(greatest({wc('text')}, 1) as double))"
)
DENSITY = rf"""greatest(-0.04, least(0.06, (case when length({fx.strip_sql('text')}) > 100 then 0.03 else 0 end)
 + (case when length({fx.strip_sql('text')}) > 200 then 0.02 else 0 end)
 + (case when regexp_matches(text, '\p{{Nd}}') then 0.02 else 0 end)
 + (case when regexp_matches(text, '(^|\s)\p{{Lu}}\p{{L}}{{2,}}(\s|$)') then 0.02 else 0 end)
 - (case when length({fx.strip_sql('text')}) < 30 then 0.04 else 0 end)
 + (case when length(text) - length(replace(text, chr(10), '')) >= 2 then 0.01 else 0 end)))"""


def delta_sql(ts: str, as_of: str, intent: str) -> str:
    return f"""(case when {intent} = 'current' then case when {ts} >= {as_of} - interval 30 day then 0.10 when {ts} >= {as_of} - interval 90 day then 0.05 else 0 end
 when {intent} = 'historical' then case when {ts} >= {as_of} - interval 30 day then -0.03 when {ts} < {as_of} - interval 180 day then 0.05 else 0 end
 else case when {ts} >= {as_of} - interval 30 day then 0.05 when {ts} >= {as_of} - interval 90 day then 0.02 else 0 end end)"""


def route_sql(col: str) -> str:
    raw = fx.strip_sql(col)
    norm = rf"regexp_replace({fx.strip_sql(f'lower({col})')}, '\s+', ' ', 'g')"
    casual = ", ".join(f"'{w}'" for w in routing.CASUAL)
    mem = f"regexp_matches({norm}, '{routing.memory_pattern()}')"
    words, asks = wc(norm), f"contains({norm}, '?')"
    return f"""case when {raw} = '' or length({norm}) <= 2 or regexp_matches({raw}, '{routing.EMOJI_ONLY}') or {norm} in ({casual}) then 'casual'
 when {asks} and {words} >= 2 then case when {mem} then 'memory' else 'ambiguous' end
 when length({norm}) <= 12 and not {asks} and not {mem} and {words} <= 2 then 'casual'
 when {mem} then 'memory' else 'ambiguous' end"""


def topic_sql() -> str:
    counts = [
        " + ".join(f"cast(contains(lower(text), '{w}') as int)" for w in words) for words in tx.TOPICS.values()
    ]
    names = "[" + ", ".join(f"'{t}'" for t in tx.TOPICS) + "]"
    return f"select doc_id, case when list_max(c) = 0 then 'general' else {names}[list_position(c, list_max(c))] end as topic from (select doc_id, [{', '.join(counts)}] as c from documents) x"


def docs(spark, folder):
    return fx.table(spark, folder, "documents")


def _tokenize(spark, folder):
    t = each_term(docs(spark, folder), tx.tokens(F.col("text")), "doc_id").withColumnRenamed("term", "token")
    return t.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf"))


def _style(spark, folder):
    return style.style_profile(usable(spark, folder)).select(
        "workspace_id", "sender", F.round("avg_message_length", 6).alias("avg_message_length"),
        F.round("emoji_rate", 6).alias("emoji_rate"), F.round("codemix_ratio", 6).alias("codemix_ratio"),
    )


def _style_labels(spark, folder):
    by_message = usable(spark, folder).select(
        "message_id",
        tx.emoji_rate(F.col("text")).alias("emoji_rate"),
        tx.codemix_ratio(F.col("text")).alias("codemix_ratio"),
    )
    return style.style_labels(by_message).select("message_id", "emoji_label", "codemix_label")


def _recency(spark, folder):
    m = usable(spark, folder)
    intent = F.when(F.col("sender") == "view", "current").when(F.col("sender") == "click", "historical").otherwise("neutral")
    as_of = F.when(F.col("workspace_id") < "w5", F.lit("2024-02-10")).otherwise(F.lit("2024-07-10")).cast("timestamp_ntz")
    score = F.length("text") / 20.0
    return m.select(
        "message_id", F.round(sc.adjusted(F.least(F.lit(1.0), score), sc.recency_delta(F.col("ts"), as_of, intent)), 6).alias("score")
    )


def _durations(spark, folder):
    e = events(spark, folder).filter("gap_seconds >= 0")
    return e.select(
        "workspace_id", "turn_no", sc.duration_label(F.col("gap_seconds")).alias("gap_label"),
        sc.hour_label(F.hour("first_ts")).alias("hour_label"),
    )


def _normalized(spark, folder):
    e = fx.table(spark, folder, "embeddings")
    return e.select("vec_id", F.posexplode(unit_vector(F.col("embedding"))).alias("i", "x")).select(
        "vec_id", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x")
    )


def _jaccard(spark, folder):
    """Overlap of the two sides of a dialogue, of their texts and of the words in them."""
    m = fx.messages_conv(spark, folder)
    words = each_term(m, tx.tokens(F.col("text")), "workspace_id", "sender")

    def overlap(rows, element, *names):
        met = style.set_overlap(rows, "workspace_id", "sender", "user", "assistant", element)
        shared, every, jaccard = names
        return met.select("workspace_id", F.col("shared").alias(shared), F.col("all_elements").alias(every), F.round("jaccard", 6).alias(jaccard))

    by_text = overlap(m, "text", "shared", "all_elements", "jaccard")
    by_word = overlap(words, "term", "shared_words", "all_words", "word_jaccard")
    # A dialogue without words has two empty sets of them.
    return by_text.join(by_word, "workspace_id", "left").fillna({"shared_words": 0, "all_words": 0, "word_jaccard": 1.0})


def _solo(spark, folder):
    rows = docs(spark, folder).select("source", "doc_id", "text")
    return style.solo_examples(rows, ["source"], "doc_id").select(
        "source", "doc_id", F.col("rank").cast("bigint").alias("rank"), F.length("text").cast("bigint").alias("chars")
    )


# Score texts as a model might write them, one per event.
_RAW_SCORES = """
select event_id, case
  when value < 5 then cast(value as string)
  when value < 10 then concat('" ', cast(value as string), '%"')
  when value < 15 then concat('[0.', cast(event_id as string), ', 1]')
  when value < 20 then concat('{"score": "0.', cast(event_id as string), '"}')
  when value < 25 then concat('{"relevance": [', cast(value as string), ']}')
  when value < 30 then 'true'
  when value < 32 then 'null'
  when value < 40 then '{"other": 1}'
  when value < 50 then concat('"', event_type, '"')
  when value < 60 then concat('{"value": {"score": 0.', cast(event_id as string), '}}')
  else concat('{"score": ', cast(value as string), ', "value"') end as raw
from {events}
"""

_RERANK = """
select event_id, case
  when value < 40 then concat('Here you go:\\n```json\\n[{"id": 1, "score": 0.', cast(event_id as string),
     '}, {"id": "2", "score": "', cast(value as string), '%"}, {"id": 9, "score": 1}, {"id": 3, "score": [0.5]}, {"score": 1}]\\n```')
  when value < 70 then concat('[{"id": 1, "score": 0.3}, {"id": 4, "score": {"relevance": ', cast(value as string), '}}, {"id": 1, "score": 0.4}]')
  when value < 80 then '[{"id": 1, "score": '
  else event_type end as raw
from {events}
"""

_OBJECTS = """
select event_id, case when value < 10 then concat('```json\\n', props, '\\n```')
  when value < 30 then props when value < 40 then concat('  ', props, ' ')
  when value < 60 then concat('note: ', props) else event_type end as raw
from {events}
"""

_CLASSIFIED = """
select event_id, concat(' Tell me about ', event_type, ' ') as message, case
  when value < 10 then concat('{"needs_history": true, "needs_rewrite": true, "query_intent": " Current ", "search_queries": ["', event_type, ' plan", "  ", "k ', cast(event_id as string), '"]}')
  when value < 20 then concat('```json\\n{"needs_history": true, "query_intent": "someday", "search_query": "', event_type, '"}\\n```')
  when value < 30 then '{"needs_history": false, "needs_rewrite": true, "search_queries": ["x"]}'
  when value < 40 then 'sure! {"needs_history": 1, "needs_rewrite": 0, "query_intent": "historical", "search_queries": []} done'
  when value < 50 then '{"needs_history": true'
  when value < 60 then '{"needs_history": "", "search_query": "x"}'
  else event_type end as raw
from {events}
"""


def _sql(spark, folder, text):
    # Braces of the JSON in the text are doubled; only the table is a placeholder.
    escaped = text.replace("{", "{{").replace("}", "}}").replace("{{events}}", "{events}")
    return spark.sql(escaped, events=fx.table(spark, folder, "events"))


def _duck(text: str) -> str:
    return text.replace("{events}", "events").replace("\\n", "' || chr(10) || '")


def _coerce(spark, folder):
    raw = _sql(spark, folder, _RAW_SCORES)
    return raw.select("event_id", F.round(mo.coerce_score(F.try_parse_json("raw")), 6).alias("score"))


def _rerank(spark, folder):
    raw = _sql(spark, folder, _RERANK).withColumn("chunk_count", F.lit(5))
    return mo.parse_rerank(raw, "event_id").withColumn("score", F.round("score", 6))


def _objects(spark, folder):
    v = mo.fenced_json(F.col("raw"))
    return _sql(spark, folder, _OBJECTS).select(
        "event_id", v.isNotNull().alias("parsed"), F.coalesce(F.try_variant_get(v, "$.k", "bigint"), F.lit(-1)).alias("k")
    )


def _classified(spark, folder):
    c = _sql(spark, folder, _CLASSIFIED).select("event_id", mo.parse_classification(F.col("raw"), F.col("message")).alias("c"))
    return c.select("event_id", "c.needs_history", "c.needs_rewrite", "c.query_intent", F.array_join("c.queries", "|").alias("queries"))


def _query_list(spark, folder):
    # A third of the texts is one line, the rest several; blank lines stand for an empty answer.
    b = fx.table(spark, folder, "conversations")
    raw = F.when(F.col("role") == "system", F.lit(" \n ")).otherwise(F.col("text"))
    return b.select("conv_id", "turn", F.array_join(mo.query_list(raw, F.col("role")), "|").alias("queries"))


def _terms(spark, folder):
    b = fx.table(spark, folder, "benchmark")
    terms = mo.query_terms(F.split("text", "\n"))
    return b.select("item_id", F.array_join(terms, " ").alias("terms"), F.size(terms).cast("bigint").alias("term_count"))


def _interleave(spark, folder):
    b = fx.table(spark, folder, "benchmark")
    merged = mo.interleave(F.split("text", r"\. "), F.split("text", "\n"), F.col("text"))
    return b.select("item_id", F.array_join(merged, "|").alias("queries"), F.size(merged).cast("bigint").alias("n"))


def _bursts(spark, folder):
    c = fx.table(spark, folder, "conversations")
    parts = tx.split_bursts(F.replace(F.replace(F.col("text"), F.lit(". "), F.lit("||")), F.lit("\n"), F.lit("\n\n")))
    return c.select("conv_id", "turn", F.posexplode(parts).alias("part", "body")).select(
        "conv_id", "turn", F.col("part").cast("bigint").alias("part"), "body"
    )


def _routes(spark, folder):
    a = usable(spark, folder).select("message_id", "text")
    b = fx.messages_conv(spark, folder).select(F.col("message_id").cast("string").alias("message_id"), "text")
    return a.unionByName(b).select("message_id", routing.route(F.col("text")).alias("route"))


def _validation(spark, folder):
    m = usable(spark, folder)
    return m.filter(routing.needs_validation(F.col("text"))).select("message_id")


U = f"with {fx.SQL_USABLE} "
J = f"with raw as ({_duck(_RAW_SCORES)}), "

ENTRIES = {
    "tokenize": (_tokenize, f"select doc_id, token, count(*) as tf from (select doc_id, unnest({TOK}) as token from documents) x group by 1, 2"),
    "emoji_rate": (
        lambda s, d: usable(s, d).select("message_id", F.round(tx.emoji_rate(F.col("text")), 6).alias("emoji_rate")),
        U + f"select message_id, round({EMOJI_SQL}, 6) as emoji_rate from usable",
    ),
    "codemix_ratio": (
        lambda s, d: usable(s, d).select("message_id", F.round(tx.codemix_ratio(F.col("text")), 6).alias("codemix_ratio")),
        U + f"select message_id, round({MIX_SQL}, 6) as codemix_ratio from usable",
    ),
    "style_profile": (
        _style,
        U + f"select workspace_id, sender, round(avg(length(text)), 6) as avg_message_length, round(avg({EMOJI_SQL}), 6) as emoji_rate, round(avg({MIX_SQL}), 6) as codemix_ratio from usable group by 1, 2",
    ),
    "style_labels": (
        _style_labels,
        U
        + f"""select message_id, case when e < 0.02 then 'low' when e < 0.08 then 'medium' else 'high' end as emoji_label,
 case when m < 0.05 then 'low' when m < 0.15 then 'medium' else 'high' end as codemix_label
 from (select message_id, {EMOJI_SQL} as e, {MIX_SQL} as m from usable) x""",
    ),
    "chunk_density": (
        lambda s, d: docs(s, d).select("doc_id", F.round(tx.chunk_density(F.col("text")), 6).alias("density")),
        f"select doc_id, round(cast({DENSITY} as double), 6) as density from documents",
    ),
    "density_rescore": (
        lambda s, d: usable(s, d).select(
            "message_id", F.round(sc.adjusted(F.least(F.lit(1.0), F.length("text") / 40.0), tx.chunk_density(F.col("text"))), 6).alias("score")
        ),
        U + f"select message_id, round(cast(least(1.0, greatest(0.0, least(1.0, length(text) / 40.0) + {DENSITY})) as double), 6) as score from usable",
    ),
    "recency_boost": (
        _recency,
        U
        + f"""select message_id, round(cast(least(1.0, greatest(0.0, least(1.0, length(text) / 20.0) + {delta_sql('ts', 'as_of', 'intent')})) as double), 6) as score
 from (select *, case sender when 'view' then 'current' when 'click' then 'historical' else 'neutral' end as intent,
 case when workspace_id < 'w5' then timestamp '2024-02-10' else timestamp '2024-07-10' end as as_of from usable) x""",
    ),
    "duration_labels": (
        _durations,
        f"with {fx.SQL_EVENTS} "
        + """select workspace_id, turn_no, case when g < 60 then concat(g, 's')
 when g < 3600 then concat(g // 60, 'm', case when g % 60 > 0 then concat(' ', g % 60, 's') else '' end)
 else concat(g // 3600, 'h', case when (g % 3600) // 60 > 0 then concat(' ', (g % 3600) // 60, 'm') else '' end) end as gap_label,
 concat(case when h % 12 = 0 then 12 else h % 12 end, case when h < 12 then ' AM' else ' PM' end) as hour_label
 from (select workspace_id, turn_no, gap_seconds as g, hour(first_ts) as h from turn_events where gap_seconds >= 0) x""",
    ),
    "token_estimate": (
        lambda s, d: docs(s, d).select("doc_id", tx.token_estimate(F.col("text")).alias("tokens")),
        "select doc_id, cast(greatest(1, length(text) // 4) as bigint) as tokens from documents",
    ),
    "snippets": (
        lambda s, d: docs(s, d).select("doc_id", *[F.sha2(tx.snippet(F.col("text"), n), 256).alias(f"s{n}") for n in (500, 300, 280, 80)]),
        "select doc_id, sha256(left(text, 500)) as s500, sha256(left(text, 300)) as s300, sha256(left(text, 280)) as s280, sha256(left(text, 80)) as s80 from documents",
    ),
    "normalize_vectors": (
        _normalized,
        """select vec_id, cast(i - 1 as bigint) as i, round(cast(embedding[i] as double) / n, 6) as x from (select vec_id, embedding,
 sqrt(list_sum([cast(v as double) * cast(v as double) for v in embedding])) as n from embeddings) e, unnest(range(1, len(embedding) + 1)) as u(i)""",
    ),
    "pure_ack": (
        lambda s, d: fx.lines(s, d).select("doc_id", "line_no", tx.is_pure_ack(F.col("line")).alias("is_ack")),
        f"with {fx.SQL_LINES} select doc_id, line_no, length(b) <= 4 or (length(b) <= 8 and not contains(substr(b, 5), ' ')) as is_ack from (select doc_id, line_no, {fx.strip_sql('line')} as b from lines) x",
    ),
    "topic_bucket": (lambda s, d: docs(s, d).select("doc_id", tx.topic_bucket(F.col("text")).alias("topic")), topic_sql()),
    "exchange_jaccard": (
        _jaccard,
        f"""with {fx.SQL_MESSAGES_CONV}, s as (select workspace_id, text, max(case when sender = 'user' then 1 else 0 end) as a, max(case when sender = 'assistant' then 1 else 0 end) as b
  from messages_conv where sender in ('user', 'assistant') group by 1, 2),
 w as (select workspace_id, sender, unnest({TOK}) as token from messages_conv where sender in ('user', 'assistant')),
 sw as (select workspace_id, token, max(case when sender = 'user' then 1 else 0 end) as a, max(case when sender = 'assistant' then 1 else 0 end) as b from w group by 1, 2),
 ws as (select workspace_id, cast(sum(a * b) as bigint) as shared_words, count(*) as all_words, round(sum(a * b) / count(*), 6) as word_jaccard from sw group by 1),
 ts as (select p.workspace_id, cast(coalesce(sum(a * b), 0) as bigint) as shared, count(s.workspace_id) as all_elements,
  case when count(s.workspace_id) = 0 then 1 else round(sum(a * b) / count(s.workspace_id), 6) end as jaccard
 from (select distinct workspace_id from messages_conv) p left join s using (workspace_id) group by 1)
 select ts.*, coalesce(shared_words, 0) as shared_words, coalesce(all_words, 0) as all_words, coalesce(word_jaccard, 1) as word_jaccard from ts left join ws using (workspace_id)""",
    ),
    "solo_examples": (
        _solo,
        f"""with t as (select source, {fx.strip_sql('text')} as body, min(doc_id) as doc_id from documents group by 1, 2),
 r as (select *, row_number() over (partition by source order by doc_id) as rank from t where body <> '')
 select source, doc_id, rank, length(body) as chars from r where rank <= 8""",
    ),
    "route_messages": (
        _routes,
        U[:-1]
        + f", {fx.SQL_MESSAGES_CONV} select message_id, {route_sql('text')} as route from (select message_id, text from usable union all select cast(message_id as varchar), text from messages_conv) x",
    ),
    "validation_candidates": (
        _validation,
        U + f"select message_id from usable where length({fx.strip_sql('text')}) >= 20 and {route_sql('text')} <> 'casual'",
    ),
    "coerce_scores": (
        _coerce,
        J
        + """a as (select event_id, case when json_valid(raw) then cast(raw as json) end as j from raw),
 b as (select event_id, case when json_type(j) = 'ARRAY' then j->'$[0]' when json_type(j) = 'OBJECT' then coalesce(j->'$.score', j->'$.relevance', j->'$.value') else j end as j from a),
 c as (select event_id, case when json_type(j) = 'ARRAY' then j->'$[0]' when json_type(j) = 'OBJECT' then coalesce(j->'$.score', j->'$.relevance', j->'$.value') else j end as j from b),
 d as (select event_id, json_type(j) as t, j->>'$' as s from c),
 e as (select event_id, t, try_cast(trim(rtrim(trim(s), '%')) as double) as x from d)
 select event_id, round(case when x is null then null when t in ('UBIGINT', 'BIGINT', 'DOUBLE') then least(1.0, greatest(0.0, x))
   when t = 'VARCHAR' then least(1.0, greatest(0.0, case when x > 1 and x <= 100 then x / 100 else x end)) end, 6) as score from e""",
    ),
    "parse_rerank": (
        _rerank,
        f"with raw as ({_duck(_RERANK)}), "
        + r"""a as (select event_id, regexp_extract(raw, '(?s)\[.*\]') as t from raw),
 l as (select event_id, from_json(cast(t as json), '["json"]') as js from a where json_valid(t) and t <> ''),
 b as (select event_id, i as place, js[i] as j from l, unnest(range(1, len(js) + 1)) as u(i)),
 c as (select event_id, try_cast(j->>'$.id' as bigint) as ordinal, j->'$.score' as s, place from b where json_type(j) = 'OBJECT'),
 d as (select event_id, ordinal, place, case when json_type(s) = 'ARRAY' then s->'$[0]' when json_type(s) = 'OBJECT' then s->'$.relevance' else s end as s from c),
 e as (select event_id, ordinal, place, json_type(s) as t, try_cast(rtrim(s->>'$', '%') as double) as x from d),
 f as (select event_id, ordinal, place, case when x is not null then least(1.0, greatest(0.0, case when t = 'VARCHAR' and x > 1 and x <= 100 then x / 100 else x end)) end as score from e)
 select event_id, ordinal, round(arg_max(score, place), 6) as score from f where score is not null and ordinal between 1 and 5 group by 1, 2""",
    ),
    "parse_llm_json": (
        _objects,
        f"with raw as ({_duck(_OBJECTS)}), "
        + r"""a as (select event_id, trim(regexp_replace(regexp_replace(trim(raw), '^```(json)?\n?', ''), '\n?```$', '')) as t from raw)
 select event_id, json_valid(t) as parsed, coalesce(try_cast(case when json_valid(t) then json_extract_string(t, '$.k') end as bigint), -1) as k from a""",
    ),
    "parse_classification": (
        _classified,
        f"with raw as ({_duck(_CLASSIFIED)}), "
        + r"""a as (select event_id, message, regexp_extract(raw, '(?s)\{.*\}') as t from raw),
 b as (select event_id, message, case when t <> '' and json_valid(t) then cast(t as json) end as j from a),
 c as (select *, coalesce((j->>'$.needs_history') in ('true', '1'), false) as nh,
  [trim(q) for q in from_json(coalesce((j->'$.search_queries'), '[]'), '["varchar"]') if trim(q) <> ''] as listed from b),
 d as (select *, case when len(listed) > 0 then listed when (j->'$.search_queries') is null and coalesce(trim(j->>'$.search_query'), '') <> '' then [trim(j->>'$.search_query')] else [lower(trim(message))] end as qs from c)
 select event_id, nh as needs_history, nh and coalesce((j->>'$.needs_rewrite') in ('true', '1'), false) as needs_rewrite,
  case when nh and lower(trim(j->>'$.query_intent')) in ('current', 'historical', 'neutral') then lower(trim(j->>'$.query_intent')) else 'neutral' end as query_intent,
  case when nh then array_to_string(qs, '|') else '' end as queries from d""",
    ),
    "parse_query_list": (
        _query_list,
        f"""with a as (select conv_id, turn, role, case when role = 'system' then concat(' ', chr(10), ' ') else text end as t from conversations),
 b as (select conv_id, turn, role, [q for q in [{fx.strip_sql('x')} for x in string_split(t, chr(10))] if q <> ''] as q from a)
 select conv_id, turn, case when len(q) = 0 then role else array_to_string(q[1:3], '|') end as queries from b""",
    ),
    "query_terms_union": (
        _terms,
        r"""with t as (select item_id, i, regexp_extract_all(text, '\S+')[i] as term from benchmark, unnest(range(1, len(regexp_extract_all(text, '\S+')) + 1)) as u(i)),
 f as (select item_id, term, min(i) as i from t group by 1, 2)
 select item_id, string_agg(term, ' ' order by i) as terms, count(*) as term_count from f group by 1""",
    ),
    "interleave_queries": (
        _interleave,
        r"""with l as (select item_id, text, string_split(text, '. ') as a, string_split(text, chr(10)) as b from benchmark),
 x as (select item_id, i * 2 as place, a[i] as q from l, unnest(range(1, len(a) + 1)) as u(i) union all
       select item_id, i * 2 + 1, b[i] from l, unnest(range(1, len(b) + 1)) as u(i) union all select item_id, 1000000, text from l),
 f as (select item_id, q, min(place) as place from x where q <> '' group by 1, 2),
 r as (select *, row_number() over (partition by item_id order by place) as rn from f)
 select item_id, string_agg(q, '|' order by place) as queries, count(*) as n from r where rn <= 8 group by 1""",
    ),
    "burst_split": (
        _bursts,
        rf"""with a as (select conv_id, turn, [p for p in string_split(replace(replace(text, '. ', '||'), chr(10), chr(10) || chr(10)), '||') if {fx.strip_sql('p')} <> ''] as ps from conversations)
 select conv_id, turn, cast(i - 1 as bigint) as part, {fx.strip_sql(r"regexp_replace(ps[i], '\n{2,}', ' ', 'g')")} as body from a, unnest(range(1, len(ps) + 1)) as u(i)""",
    ),
}
