"""One query per operator over its whole table, beside the SQL that states its result where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.llm import contamination, copies, divergence, html, jaccard, lines, mixture, phrases, quotes, repetition, secrets, tokens, toxicity
from talkweave.llm.rows import text_batches


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return text_batches(spark.read.parquet(f"{folder}/{name}.parquet"))


def _hex(text):
    return F.sha2(F.encode(text, "UTF-8"), 256)


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found, parts = lines.drop_shared_lines(docs)
    return found.select(
        "doc_id", parts["n_lines"].alias("n_lines"), parts["n_dropped"].alias("n_dropped"), _hex(parts["text"]).alias("kept_sha256")
    )


def op2_repetition(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", repetition.repetition(F.col("text")).alias("s"))
    return docs.select(
        "doc_id", *[F.col(f"s.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        repetition.base_failed("s").alias("base_failed"), repetition.kept("s").alias("kept"),
    )


def op3_mixture(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixture.mix(docs).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", F.col("taken").cast("bigint").alias("taken")
    )


def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, folder, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] <= len(secrets.BASE))
    return found.select(
        F.col("id").alias("doc_id"), *map(count, secrets.BASE), _hex(secrets.written(base)).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"),
    )


def op5_quotes(spark: SparkSession, folder: str) -> DataFrame:
    return quotes.link_quotes(_table(spark, folder, "conversations"))


def op6_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return jaccard.near_copies(docs, percent=90, width=3).select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id")
    )


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "labels").select("doc_id", "toxic")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return toxicity.toxicity(docs, labels, held_out).withColumnRenamed("id", "doc_id")


def op8_tokens(spark: SparkSession, folder: str) -> DataFrame:
    from public_tokenizers import path

    text = F.coalesce(F.col("text"), F.lit(""))
    docs = _table(spark, folder, "documents")
    counted = docs.select(
        "doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), tokens.token_count(spark, F.col("text"), path("byte_bpe_50k.json")).alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op9_contamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = _table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "benchmark").select("item_id", "text")
    found = contamination.contamination(docs, items)
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        _hex(F.array_join("items", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_html(spark: SparkSession, folder: str) -> DataFrame:
    pages = html.main_text(_table(spark, folder, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(_table(spark, folder, "documents").select("text", "lang"))


def op12_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, folder, "documents").select("text", "lang", "source"))


def op13_copies(spark: SparkSession, folder: str) -> DataFrame:
    found = copies.exact_copies(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    return found.drop("carried").withColumnRenamed("id", "doc_id")


_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_STRIP = r"regexp_replace({}, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"

SQL_LINES = f"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
l as (select r, i, parts[i] as line, {_ASCII_LOWER.format(_STRIP.format("parts[i]"))} as key
      from d, unnest(range(1, len(parts) + 1)) as u(i)),
shared as (select key from l where key <> '' group by key having count(distinct r) >= 10),
k as (select r, string_agg(line, chr(10) order by i) as kept, count(*) as n from l
      where key not in (select key from shared) group by r)
select doc_id, cast(len(parts) as bigint) as n_lines, cast(len(parts) - coalesce(n, 0) as bigint) as n_dropped,
       sha256(coalesce(kept, '')) as kept_sha256
from d left join k using (r)"""

SQL_REPETITION = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select r, n, i, hash(list_slice(w, i, i + n - 1)) as h, len(w) as size
      from d, (values (8), (16), (201)) as s(n), unnest(range(1, len(w) - n + 2)) as u(i)),
again as (select r, n, h from g group by all having count(*) > 1),
reach as (select distinct r, n, i + k as at from g join again using (r, n, h), unnest(range(0, case when n = 201 then 1 else n end)) as v(k)),
c as (select r, count(*) filter (n = 8) as repeated, count(*) filter (n = 16) as covered, count(*) filter (n = 201) as longer
      from reach group by r),
lines as (select r, count(*) - count(distinct line) as dup
          from (select r, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
s as (select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum([length(x) for x in w]), 0) as bigint) as word_chars,
             cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
             cast(coalesce(dup, 0) as bigint) as n_dup_lines, cast(coalesce(repeated, 0) as bigint) as n_repeat_words,
             coalesce(covered, 0) as covered, coalesce(longer, 0) as longer
      from d left join c using (r) left join lines using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
       not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and 100 * covered <= 20 * n_words and longer = 0 as kept
from s"""


def _sql_spans(kind: str, pattern: str, test: str, group: int = 1) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  select r, {kind} as kind, b, b + length(m) as e from (
    select r, whole[i] as m, part[i] as g,
           cast(coalesce(list_sum([length(x) for x in gaps[1:i]]), 0) + coalesce(list_sum([length(x) for x in whole[1:i - 1]]), 0) as bigint) as b
    from (select r, regexp_extract_all(text, '{quoted}', 0) as whole, regexp_extract_all(text, '{quoted}', {group}) as part,
                 regexp_split_to_array(text, '{quoted}') as gaps from d where regexp_matches(text, '{quoted}')) t,
         unnest(range(1, len(whole) + 1)) as u(i)) where {test}"""


_P = secrets.PATTERNS
_ID = "regexp_matches(m, '^[A-Z0-9]{16,32}$') and regexp_matches(m, '[A-Z]') and regexp_matches(m, '[0-9]')"
_KEY = "length(m) >= 24 and regexp_matches(m, '[A-Z]') and regexp_matches(m, '[0-9]') and regexp_matches(m, '[a-z]')"
SQL_SECRETS = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
found as ({" union all ".join((
    _sql_spans("'assign'", _P["assign"], "length(g) >= 12", 2), _sql_spans("'access'", _P["access"], "length(m) >= 18"),
    _sql_spans("'hex'", _P["hex"], "true"), _sql_spans(f"case when {_ID} then 'id' else 'key' end", _P["token"], f"({_ID}) or ({_KEY})"),
    _sql_spans("'endpoint'", _P["endpoint"], "true"),
))}),
ranked as (select *, list_position(['assign', 'access', 'hex', 'id', 'key', 'endpoint'], kind) as k, kind in ('assign', 'hex', 'key') as secret from found),
apart as (select * from ranked a where k <= 3 or not exists (select 1 from ranked b where b.r = a.r and b.k <= 3 and b.b <= a.b and a.e <= b.e)),
told as (select * from apart a where k <= 3 or exists
           (select 1 from apart b where b.r = a.r and b.secret <> a.secret and abs(a.b - b.b) <= {secrets.REACH} and (b.b >= a.e or b.e <= a.b))),
per as (select r, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
               string_agg(kind || ':' || b || ':' || e, ',' order by b, k) filter (k <= 3) as base,
               string_agg(kind || ':' || b || ':' || e, ',' order by b, k) as spans from told group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join per using (r)"""

SQL_JACCARD = rf"""
with recursive d as (select doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, case when len(w) < 3 then w else list_slice(w, i, i + 2) end as g
      from d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as u(i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by 1),
links as (select a.doc_id as a, b.doc_id as b from s a join s b on a.g = b.g and a.doc_id <> b.doc_id
          join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id group by a.doc_id, b.doc_id, x.n, y.n
          having 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach as (select doc_id as a, doc_id as b from d union select r.a, l.b from reach r join links l on l.a = r.b)
select d.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(reach.b) as component_id
from d join reach on reach.a = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id"""

_WORDS9 = r"regexp_extract_all(" + _ASCII_LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL_CONTAMINATION = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS9} as w from documents),
b as (select item_id, {_WORDS9} as w from benchmark),
windows as (select distinct item_id, list_slice(w, i, i + 9) as g from b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as u(i) where len(w) > 0),
sizes as (select distinct len(g) as n from windows),
seen as (select r, i, n, list_slice(w, i, i + n - 1) as g from d, sizes, unnest(range(1, len(w) - n + 2)) as u(i)),
hits as (select r, item_id, i, n from seen join windows using (g)),
words as (select r, count(distinct i + k) as n_hit from hits, unnest(range(0, n)) as v(k) group by r),
items as (select r, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids
          from hits group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (r) left join items using (r)"""

SQL_PHRASES = rf"""
with d as (select coalesce(lang, 'und') as lang, {_ASCII_LOWER.format("coalesce(text, '')")} as text from documents),
p as (select row_number() over () as r, lang, regexp_extract_all(piece, '[^\x20\x09]+') as w
      from (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from d)),
g as (select lang, list_slice(w, i, i + k - 1) as g, count(*) as f
      from p, (values (1), (2), (3), (4), (5)) as s(k), unnest(range(1, len(w) - k + 2)) as u(i) group by all),
n as (select lang, cast(sum(f) as hugeint) as n from g where len(g) = 1 group by lang),
c as (select lang, g, f as a from g where len(g) > 1 and f >= 100),
gone as (select distinct x.lang, list_slice(x.g, i, i + k - 1) as g, x.a
         from c x, (values (2), (3), (4)) as s(k), unnest(range(1, len(x.g) - k + 2)) as u(i) where k < len(x.g)),
kept as (select c.* from c where not exists (select 1 from gone where gone.lang = c.lang and gone.g = c.g and 100 * gone.a >= 100 * c.a)),
cuts as (select kept.lang, kept.g, a, x.f as l, y.f as r, n, k, (1000::hugeint * a * n) // (x.f::hugeint * y.f) as score
         from kept join n using (lang), unnest(range(1, len(kept.g))) as u(k)
              join g x on x.lang = kept.lang and x.g = list_slice(kept.g, 1, k)
              join g y on y.lang = kept.lang and y.g = list_slice(kept.g, k + 1, len(kept.g))),
best as (select *, row_number() over (partition by lang, g order by score, k) as b from cuts),
ranked as (select lang, array_to_string(g, ' ') as phrase, a, l, r, n, score from best where b = 1),
last as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from ranked)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from last where rank <= 2000"""

SQL_DIVERGENCE = rf"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
t as (select r, lang, source, unnest(w) as term from d),
kept as (select lang, term, count(*) as n from t group by lang, term having count(distinct r) >= 30),
sizes as (select lang, count(*) as v, sum(n) as total from kept group by lang),
groups as (select distinct lang, source from d),
held as (select lang, source, term, count(*) as n from t join kept using (lang, term) group by all),
sums as (select lang, source, sum(n) as n from held group by all),
whole as (select g.lang, g.source, coalesce(s.n, 0)::hugeint + 5 * coalesce(z.v, 0) as base, coalesce(z.v, 0) as v
          from groups g left join sums s using (lang, source) left join sizes z using (lang)),
cells as (select w.lang, w.source, k.term, coalesce(h.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(h.n, 0) + 5)) // w.base as p,
                 1 + (1000000000::hugeint * (k.n + 5)) // (z.total + 5 * z.v)::hugeint as q
          from whole w join kept k using (lang) join sizes z using (lang) left join held h on h.lang = w.lang and h.source = w.source and h.term = k.term),
pairs as (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value
          from cells x join cells y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all),
found as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
          from groups a join groups b on a.lang = b.lang and a.source <> b.source
               left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
          union all select lang, source, 'term', term, p - q from cells where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from found)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= 50"""

SQL_COPIES = r"""
with d as (select doc_id, length(coalesce(text, '')) as size, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
           from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size,
       row_number() over w = 1 as kept, text_sha256
from d window w as (partition by text_sha256 order by size desc, doc_id)"""

ENTRIES = {
    "op1_line_dedup": (op1_line_dedup, SQL_LINES),
    "op2_repetition": (op2_repetition, SQL_REPETITION),
    "op3_mixture": (op3_mixture, None),
    "op4_secrets": (op4_secrets, SQL_SECRETS),
    "op5_quotes": (op5_quotes, None),
    "op6_jaccard": (op6_jaccard, SQL_JACCARD),
    "op7_toxicity": (op7_toxicity, None),
    "op8_tokens": (op8_tokens, None),
    "op9_contamination": (op9_contamination, SQL_CONTAMINATION),
    "op10_html": (op10_html, None),
    "op11_phrases": (op11_phrases, SQL_PHRASES),
    "op12_divergence": (op12_divergence, SQL_DIVERGENCE),
    "op13_copies": (op13_copies, SQL_COPIES),
}
