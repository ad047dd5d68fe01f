"""Search, fusion and verdict queries.

Requests come from ``benchmark`` joined with ``embeddings`` on their ids: a text and a
vector per phrasing, one request per vector label.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from talkweave.catalog import fixtures as fx
from talkweave.catalog.text import DENSITY, TOK, delta_sql
from talkweave.functions import scores as sc
from talkweave.operators import cells, embed, fusion, search
from talkweave.operators.index import Index, counted_postings, write_index
from talkweave.session import materialise

AS_OF = "2024-02-10"


def all_corpus(spark, folder):
    return fx.corpus(spark, folder).withColumn("workspace_id", F.lit("all"))


def vectors(spark, folder):
    e = fx.table(spark, folder, "embeddings")
    return e.select(
        F.lit("all").alias("workspace_id"),
        F.col("vec_id").alias("message_id"),
        F.col("label").cast("bigint").alias("person_id"),
        F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, cast(vec_id as int), 0, 0)").alias("ts"),
        "embedding",
    )


def requests(spark, folder):
    b, e = fx.table(spark, folder, "benchmark"), fx.table(spark, folder, "embeddings")
    label = F.col("label").cast("bigint")
    # Half of the requests ask about the person whose vectors they resemble, half about another.
    person = F.when(label < 5, label).otherwise(9 - label)
    return b.join(e, b.item_id == e.vec_id).select(
        label.alias("request_id"),
        F.col("item_id").alias("query_id"),
        F.lit("all").alias("workspace_id"),
        person.alias("person_id"),
        F.concat(F.lit("src"), person.cast("string")).alias("speaker"),
        F.when(label < 3, "current").when(label < 6, "historical").otherwise("neutral").alias("intent"),
        "text",
        "embedding",
    )


def rounded(df, *columns):
    return df.select(*columns, F.round("score", 6).alias("score"))


def _bm25_index(spark, folder):
    posted = counted_postings(search.tokenised(fx.corpus(spark, folder)))
    # Statistics join one row per term and range; single postings come last and are not shuffled.
    each = posted.select("workspace_id", "term", "df", "idf", F.inline(F.arrays_zip("ids", "tfs", "dls")))
    return each.select(
        "workspace_id", "term", F.col("ids").alias("message_id"), F.col("tfs").cast("bigint").alias("tf"), F.col("dls").cast("bigint").alias("dl"), "df", F.round("idf", 6).alias("idf")
    )


def indexed(spark, corpus):
    """The index of a corpus, written once for this query."""
    path = fx.stored(spark, "bm25")
    write_index(corpus, path)
    return Index(spark, path)


def bm25_queries(spark, folder):
    b = fx.table(spark, folder, "benchmark")
    langs = F.explode(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]))
    q = b.select(langs.alias("workspace_id"), "item_id", "text").withColumn(
        "query_id", F.concat_ws(":", F.col("item_id").cast("string"), "workspace_id")
    )
    return q


def ranked_hits(found):
    return rounded(found, "query_id", "message_id", F.col("rank").cast("bigint").alias("rank"))


def _bm25(spark, folder):
    return ranked_hits(search.bm25_topk(fx.corpus(spark, folder), bm25_queries(spark, folder), 20))


def _stored_bm25(spark, folder):
    return ranked_hits(indexed(spark, fx.corpus(spark, folder)).search(bm25_queries(spark, folder), 20))


def _stored_hybrid(spark, folder):
    found = indexed(spark, all_corpus(spark, folder)).search(requests(spark, folder), 20)
    return ranked_hits(fusion.hybrid_merge(semantic(spark, folder), found))


def semantic(spark, folder, k=20):
    return search.cosine_topk(vectors(spark, folder), requests(spark, folder), k)


def _cosine(spark, folder):
    return rounded(semantic(spark, folder, 8), "query_id", "message_id", F.col("rank").cast("bigint").alias("rank"))


def _filtered(spark, folder):
    v = vectors(spark, folder).filter(
        (F.col("ts") >= F.lit("2024-01-03").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))
    )
    found = search.cosine_topk(v, requests(spark, folder), 8, ["workspace_id", "person_id"])
    return rounded(found, "query_id", "message_id")


def _gate(spark, folder):
    found = semantic(spark, folder, 20)
    return rounded(found.filter(sc.passes_gate(F.col("score"), 0.35)), "query_id", "message_id")


def keyword(spark, folder, k=20):
    return search.bm25_topk(all_corpus(spark, folder), requests(spark, folder), k)


def _hybrid(spark, folder):
    merged = fusion.hybrid_merge(semantic(spark, folder), keyword(spark, folder))
    return rounded(merged, "query_id", "message_id", F.col("rank").cast("bigint").alias("rank"))


def candidates(spark, folder, keyword_search=None):
    """Boosted candidates of every request, from the vectors and the union of its terms."""
    search_ = keyword_search or (lambda asked, k: search.bm25_topk(all_corpus(spark, folder), asked, k))
    q = requests(spark, folder)
    joined = q.groupBy("request_id", "workspace_id").agg(
        F.array_join(F.sort_array(F.collect_list("text")), " ").alias("text")
    )
    kw = search_(joined.withColumnRenamed("request_id", "query_id"), 20)
    kw = kw.withColumnRenamed("query_id", "request_id")
    sem = semantic(spark, folder).join(q.select("request_id", "query_id"), "query_id")
    return fusion.multi_query_boost(sem, kw, q)


def judged(spark, folder, c):
    """Scores a judge gave, read from the labels; unlabelled messages have none."""
    l = fx.table(spark, folder, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    given = F.when((F.col("q") == 1) & (F.col("t") == 0), 0.8).when(F.col("q") == 1, 0.5).otherwise(0.1)
    return c.join(l, c.message_id == l.doc_id).select("request_id", "ordinal", given.alias("score"))


def reranked(spark, folder):
    c = fusion.ranked(candidates(spark, folder))
    return fusion.apply_rerank(c, judged(spark, folder, c))


def graded(spark, folder):
    return fusion.passing(reranked(spark, folder), requests(spark, folder))


def _rerank_apply(spark, folder):
    c = fusion.ranked(candidates(spark, folder))
    top = fusion.apply_rerank(c, judged(spark, folder, c))
    return rounded(top, "request_id", "message_id", F.col("rank").cast("bigint").alias("rank"))


# Messages without a judgement keep their keyword score, and this grade is on that scale.
KEYWORD_GRADE = 120.0


def _verdict(spark, folder):
    """Verdicts by the grade of judged scores, and by one that unjudged keyword hits can miss."""
    top, asked = materialise(reranked(spark, folder)), requests(spark, folder)
    near = F.coalesce(F.array_join(F.transform("near_misses", lambda x: x.cast("string")), ","), F.lit(""))
    v = fusion.verdicts(fusion.passing(top, asked)).select("request_id", "passing", "status", near.alias("near_misses"))
    by_keyword = fusion.verdicts(fusion.passing(top, asked, multi=KEYWORD_GRADE)).select(
        "request_id", F.col("passing").alias("keyword_passing"), F.col("status").alias("keyword_status"), near.alias("keyword_near_misses")
    )
    return v.join(by_keyword, "request_id")


def _citations(spark, folder):
    g = graded(spark, folder)
    cited = fusion.citations(g, fusion.verdicts(g))
    return cited.select("request_id", F.inline("citations")).select(
        "request_id", F.col("rank").cast("bigint").alias("rank"), "message_id", F.round("score", 6).alias("score")
    )


def _prompts(spark, folder):
    c = fusion.ranked(candidates(spark, folder))
    rows = c.join(all_corpus(spark, folder).select("message_id", "speaker", "ts", "text"), "message_id")
    return fusion.numbered_snippets(rows)


def _weak(spark, folder):
    q = requests(spark, folder)
    own = search.cosine_topk(vectors(spark, folder), q, 8, ["workspace_id", "person_id"])
    return fusion.weak_pass(own, q)


def _legs(spark, folder):
    return fusion.retrieval_legs(all_corpus(spark, folder), vectors(spark, folder), requests(spark, folder))


def _widened(spark, folder):
    merged = fusion.merge_legs(_legs(spark, folder))
    return rounded(merged, "request_id", "message_id", "seen")


def _dual_gate(spark, folder):
    q = requests(spark, folder)
    sem = semantic(spark, folder).join(q.select("request_id", "query_id"), "query_id")
    seen = sem.groupBy("request_id", "message_id").agg(F.count(F.lit(1)).alias("seen"), F.max("score").alias("score"))
    counts = q.groupBy("request_id").agg(F.count(F.lit(1)).alias("query_count"))
    rows = seen.join(counts, "request_id").withColumn("gate", sc.dual_gate(F.col("query_count"), F.col("seen")))
    return rows.filter(sc.passes_gate(F.col("score"), F.col("gate"))).select(
        "request_id", "message_id", "seen", F.round("gate", 6).alias("gate")
    )


def _fast(spark, folder):
    found = fusion.fast_retrieve(
        all_corpus(spark, folder), vectors(spark, folder), requests(spark, folder), F.lit(AS_OF).cast("timestamp_ntz")
    )
    return rounded(found, "request_id", "message_id", "speaker", "seen")


def _stored_boost(spark, folder):
    found = candidates(spark, folder, indexed(spark, all_corpus(spark, folder)).search)
    return rounded(found, "request_id", "message_id", "found_by")


def _stored_fast(spark, folder):
    corpus = all_corpus(spark, folder)
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    found = fusion.fast_retrieve(corpus, vectors(spark, folder), requests(spark, folder), as_of, keyword_search=indexed(spark, corpus).search)
    return rounded(found, "request_id", "message_id", "speaker", "seen")


def _ann(spark, folder):
    found = search.ann_topk(vectors(spark, folder), requests(spark, folder), 8, dims=64)
    return rounded(found, "query_id", "message_id", F.col("rank").cast("bigint").alias("rank"))


def _stored_ann(spark, folder):
    """Cells around the mean of each label; the six nearest to a request are opened and scored exactly."""
    v = vectors(spark, folder).select("workspace_id", "message_id", "person_id", "embedding")
    at = v.select("person_id", F.posexplode(search.unit_vector(F.col("embedding"))).alias("i", "x"))
    means = at.groupBy("person_id", "i").agg(F.avg("x").alias("x")).groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c"))
    book = cells.Codebook(np.array([r["c"] for r in means.orderBy("person_id").select(F.col("c.x").alias("c")).collect()]))
    path = fx.stored(spark, "cells")
    cells.write_cells(v, book, path)
    return ranked_hits(cells.cell_topk(spark.read.parquet(path), requests(spark, folder), book, 8, probes=6))


def _hash_embed(spark, folder):
    e = embed.hash_embed(fx.corpus(spark, folder).select("message_id", "text"))
    return e.select("message_id", F.posexplode("embedding").alias("i", "x")).filter("x <> 0").select(
        "message_id", F.col("i").cast("bigint").alias("i"), F.round(F.col("x").cast("double"), 6).alias("x")
    )


REQ = """req as (select cast(e.label as bigint) as request_id, b.item_id as query_id, cast(case when e.label < 5 then e.label else 9 - e.label end as bigint) as person_id,
 concat('src', case when e.label < 5 then e.label else 9 - e.label end) as speaker, case when e.label < 3 then 'current' when e.label < 6 then 'historical' else 'neutral' end as intent,
 b.text, e.embedding from benchmark b join embeddings e on e.vec_id = b.item_id)"""

COS = "round(list_cosine_similarity([cast(x as double) for x in q.embedding], [cast(x as double) for x in v.embedding]), 9)"
SIM = REQ + f""", vec as (select vec_id as message_id, cast(label as bigint) as person_id, embedding, timestamp '2024-01-01' + to_hours(cast(vec_id as int)) as ts from embeddings),
 sim as (select q.request_id, q.query_id, q.person_id as asked, v.person_id, v.message_id, v.ts, {COS} as score from req q, vec v)"""


def topk(name: str, source: str, part: str, k: int, where: str = "true") -> str:
    return f"""{name} as (select * from (select *, row_number() over (partition by {part} order by score desc, message_id) as rank
 from {source} where {where}) z where rank <= {k})"""


def bm25_sql(queries: str, doc_ws: str, name: str) -> str:
    """CTEs scoring ``queries(query_id, ws, text)`` over the documents as ``{name}``."""
    return f"""{name}_d as (select doc_id, {doc_ws} as ws, {TOK} as toks from documents),
 {name}_st as (select ws, count(*) as n, avg(len(toks)) as avgdl from {name}_d group by 1),
 {name}_tf as (select doc_id, ws, term, count(*) as tf, any_value(dl) as dl from (select doc_id, ws, len(toks) as dl, unnest(toks) as term from {name}_d) x group by 1, 2, 3),
 {name}_df as (select ws, term, count(*) as df from {name}_tf group by 1, 2),
 {name}_qt as (select distinct query_id, ws, unnest({TOK}) as term from {queries}),
 {name} as (select q.query_id, t.doc_id as message_id, round(sum(ln((s.n - f.df + 0.5) / (f.df + 0.5) + 1.0) * t.tf * 2.5 / (t.tf + 1.5 * (0.25 + 0.75 * t.dl / s.avgdl))), 9) as score
  from {name}_qt q join {name}_tf t on t.ws = q.ws and t.term = q.term join {name}_df f on f.ws = t.ws and f.term = t.term join {name}_st s on s.ws = t.ws
  group by 1, 2)"""


KW_ALL = bm25_sql("(select query_id, 'all' as ws, text from req) rq", "'all'", "kw")
KW_REQ = bm25_sql("(select request_id as query_id, 'all' as ws, string_agg(text, ' ') as text from req group by 1) rq", "'all'", "kr")

CAND = f"""with {SIM}, {topk('sem', 'sim', 'query_id', 20)}, {KW_REQ}, {topk('krt', 'kr', 'query_id', 20)},
 rows_ as (select request_id, query_id, message_id, score from sem union all
  select r.request_id, r.query_id, k.message_id, k.score from krt k join req r on r.request_id = k.query_id),
 perq as (select request_id, query_id, message_id, max(score) as score from rows_ group by 1, 2, 3),
 {topk('perq40', 'perq', 'request_id, query_id', 40)},
 cand as (select request_id, message_id, count(*) as found_by, max(score) * (1 + (count(*) - 1) * 0.15) as score from perq40 group by 1, 2),
 ordc as (select *, row_number() over (partition by request_id order by score desc, message_id) as ordinal from cand)"""

GRADED = CAND + """, lab as (select doc_id, max(quality) as q, max(toxic) as t from labels group by 1),
 rr as (select o.request_id, o.message_id, o.ordinal, coalesce(case when l.q = 1 and l.t = 0 then 0.8 when l.q = 1 then 0.5 when l.doc_id is not null then 0.1 end, o.score) as score
  from ordc o left join lab l on l.doc_id = o.message_id),
 top8 as (select * from (select *, row_number() over (partition by request_id order by score desc, ordinal) as rank from rr) z where rank <= 8),
 nq as (select request_id, count(*) as n from req group by 1),
 graded as (select t.*, t.score >= case when n > 1 then 0.45 else 0.6 end as passes from top8 t join nq using (request_id)),
 verdict as (select request_id, count(*) filter (passes) as passing, case when count(*) filter (passes) >= 2 then 'answered' else 'not_found' end as status,
  string_agg(case when rank <= 3 then cast(message_id as varchar) end, ',' order by rank) as near from graded group by 1)"""

OWN = f"{topk('own', 'sim', 'query_id', 8, 'asked = person_id')}"
WEAK = """perq as (select r.request_id, r.query_id, max(o.score) as best, count(o.score) filter (o.score >= 0.25) as strong from req r left join own o using (query_id) group by 1, 2),
 weak as (select request_id, bool_or(best is null or best < 0.32 or strong < 2) as is_weak from perq group by 1)"""
LOWER_KW = bm25_sql("(select query_id, 'all' as ws, lower(text) as text from req) rq", "'all'", "kw")
LEGS = f"""with {SIM}, {OWN}, {WEAK}, {LOWER_KW}, {topk('kwt', 'kw', 'query_id', 8)},
 kwd as (select r.request_id, r.speaker, k.message_id, k.score, d.source from kwt k join req r using (query_id) join documents d on d.doc_id = k.message_id),
 {topk('grp', 'sim', 'query_id', 8)},
 legs as (select request_id, message_id, score from own union all select request_id, message_id, score from kwd where source = speaker
  union all select g.request_id, g.message_id, g.score from grp g join weak w on w.request_id = g.request_id and w.is_weak
  union all select k.request_id, k.message_id, k.score from kwd k join weak w on w.request_id = k.request_id and w.is_weak),
 merged as (select request_id, message_id, max(score) as score, count(*) as seen from legs group by 1, 2),
 {topk('m8', 'merged', 'request_id', 8)}"""

R6 = "round(score, 6) as score"

ENTRIES = {
    "bm25_index": (
        _bm25_index,
        f"""with d as (select doc_id, lang, {TOK} as toks from documents), st as (select lang, count(*) as n from d group by 1),
 tf as (select lang, doc_id, term, count(*) as tf, any_value(dl) as dl from (select lang, doc_id, len(toks) as dl, unnest(toks) as term from d) x group by 1, 2, 3)
 select tf.lang as workspace_id, tf.term, tf.doc_id as message_id, tf.tf, tf.dl, f.df, round(ln((st.n - f.df + 0.5) / (f.df + 0.5) + 1.0), 6) as idf
 from tf join (select lang, term, count(*) as df from tf group by 1, 2) f on f.lang = tf.lang and f.term = tf.term join st on st.lang = tf.lang""",
    ),
    "bm25_topk": (
        _bm25,
        f"""with bq as (select concat(item_id, ':', l) as query_id, l as ws, text from benchmark, unnest(['en', 'fr', 'de', 'es']) as u(l)),
 {bm25_sql('bq', 'lang', 'kw')}, {topk('best', 'kw', 'query_id', 20)} select query_id, message_id, rank, {R6} from best""",
    ),
    "cosine_topk": (_cosine, f"with {SIM}, {topk('best', 'sim', 'query_id', 8)} select query_id, message_id, rank, {R6} from best"),
    "filtered_search": (
        _filtered,
        f"""with {SIM}, {topk('best', 'sim', 'query_id', 8, "asked = person_id and ts >= timestamp '2024-01-03' and ts < timestamp '2024-01-15'")}
 select query_id, message_id, {R6} from best""",
    ),
    "score_gate": (_gate, f"with {SIM}, {topk('best', 'sim', 'query_id', 20)} select query_id, message_id, {R6} from best where score >= 0.35"),
    "hybrid_merge": (
        _hybrid,
        f"""with {SIM}, {topk('sem', 'sim', 'query_id', 20)}, {KW_ALL}, {topk('kwt', 'kw', 'query_id', 20)},
 u as (select query_id, message_id, max(score) as score from (select query_id, message_id, score from sem union all select query_id, message_id, score from kwt) x group by 1, 2),
 {topk('best', 'u', 'query_id', 40)} select query_id, message_id, rank, {R6} from best""",
    ),
    "multi_query_boost": (
        lambda s, d: rounded(candidates(s, d), "request_id", "message_id", "found_by"),
        CAND + f" select request_id, message_id, found_by, {R6} from cand",
    ),
    "rerank_apply": (_rerank_apply, GRADED + f" select request_id, message_id, rank, {R6} from top8"),
    "qa_verdict": (
        _verdict,
        GRADED
        + f""", by_keyword as (select request_id, count(*) filter (score >= case when n > 1 then {KEYWORD_GRADE} else 0.6 end) as keyword_passing from top8 join nq using (request_id) group by 1)
 select request_id, passing, status, case when status = 'not_found' then near else '' end as near_misses, keyword_passing,
  case when keyword_passing >= 2 then 'answered' else 'not_found' end as keyword_status, case when keyword_passing >= 2 then '' else near end as keyword_near_misses
 from verdict join by_keyword using (request_id)""",
    ),
    "citations": (
        _citations,
        GRADED + f" select g.request_id, rank, message_id, {R6} from graded g join verdict v on v.request_id = g.request_id and v.status = 'answered' where passes",
    ),
    "rerank_prompts": (
        _prompts,
        CAND
        + """ select o.request_id, count(*) as lines, string_agg(concat('[', o.ordinal, '] (', d.source, ', ', strftime(timestamp '2024-01-01' + to_hours(cast(doc_id as int)), '%Y-%m-%d %H:%M'), '): ', left(d.text, 300)), chr(10) order by o.ordinal) as body
 from ordc o join documents d on d.doc_id = o.message_id group by 1""",
    ),
    "weak_pass": (_weak, f"with {SIM}, {OWN}, {WEAK} select request_id, is_weak from weak"),
    "person_then_group": (_widened, LEGS + f" select request_id, message_id, seen, {R6} from m8"),
    "dual_gate": (
        _dual_gate,
        f"""with {SIM}, {topk('sem', 'sim', 'query_id', 20)}, s as (select request_id, message_id, count(*) as seen, max(score) as score from sem group by 1, 2),
 n as (select request_id, count(*) as n from req group by 1), g as (select s.*, case when n <= 1 then 0.35 when seen >= 2 then 0.143 else 0.22 end as gate from s join n using (request_id))
 select request_id, message_id, seen, cast(gate as double) as gate from g where score >= gate""",
    ),
    "fast_retrieve": (
        _fast,
        LEGS
        + f""", det as (select m.request_id, m.message_id, m.seen, m.score, d.source as speaker, left(d.text, 500) as text, timestamp '2024-01-01' + to_hours(cast(d.doc_id as int)) as ts,
  r.intent, r.n from m8 m join documents d on d.doc_id = m.message_id join (select request_id, min(intent) as intent, count(*) as n from req group by 1) r on r.request_id = m.request_id),
 rec as (select *, least(1.0, greatest(0.0, score + {delta_sql('ts', "timestamp '" + AS_OF + "'", 'intent')})) as s1, {delta_sql('ts', "timestamp '" + AS_OF + "'", 'intent')} as dr from det),
 den as (select *, case when dr = 0 then score else s1 end as s2, {DENSITY} as dd from rec),
 fin as (select *, case when dd = 0 then s2 else least(1.0, greatest(0.0, s2 + dd)) end as s3 from den)
 select request_id, message_id, speaker, seen, round(cast(s3 as double), 6) as score from fin
 where s3 >= case when n <= 1 then 0.35 when seen >= 2 then 0.143 else 0.22 end""",
    ),
    "ann_topk": (_ann, None),
    "hash_embed": (_hash_embed, None),
}

# The same results from a written index.
ENTRIES |= {
    "stored_bm25_topk": (_stored_bm25, ENTRIES["bm25_topk"][1]),
    "stored_hybrid_merge": (_stored_hybrid, ENTRIES["hybrid_merge"][1]),
    "stored_multi_query_boost": (_stored_boost, ENTRIES["multi_query_boost"][1]),
    "stored_fast_retrieve": (_stored_fast, ENTRIES["fast_retrieve"][1]),
}

ENTRIES["stored_ann_topk"] = (
    _stored_ann,
    f"""with {SIM},
 unit as (select vec_id, label, [cast(x as double) / sqrt(list_sum([cast(y as double) * cast(y as double) for y in embedding])) for x in embedding] as u from embeddings),
 spread as (select label, unnest(range(1, len(u) + 1)) as i, unnest(u) as x from unit),
 means as (select label, list(x order by i) as c from (select label, i, avg(x) as x from spread group by 1, 2) m group by 1),
 near as (select vec_id, label, row_number() over (partition by vec_id order by round(list_dot_product(u, c), 9) desc, label) as place
  from (select unit.vec_id, unit.u, means.label, means.c from unit, means) z),
 opened as (select s.* from sim s join near own on own.vec_id = s.message_id and own.place = 1 join near q on q.vec_id = s.query_id and q.label = own.label and q.place <= 6),
 {topk('best', 'opened', 'query_id', 8)} select query_id, message_id, rank, {R6} from best""",
)
