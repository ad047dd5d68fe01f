"""Reading what a model wrote: fenced JSON, score arrays, classifications, query lists.

Model output is untrusted text, so every parse is a ``try_`` parse and every miss has a
default.  JSON is read as VARIANT, which keeps fields whose type changes from row to row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.functions.scores import clamp01
from talkweave.functions.text import bind, strip, word_count


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _field(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _unwrap(v: Column) -> Column:
    """First element of a list, or the score-like field of an object."""
    inner = F.coalesce(_field(v, "$.score"), _field(v, "$.relevance"), _field(v, "$.value"))
    return (
        F.when(F.startswith(_kind(v), F.lit("ARRAY")), _field(v, "$[0]"))
        .when(F.startswith(_kind(v), F.lit("OBJECT")), inner)
        .otherwise(v)
    )


def _number(v: Column) -> Column:
    kind = _kind(v)
    is_number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL"))
    as_text = F.regexp_replace(strip(_field(v, "$", "string")), "%+$", "")
    from_text = as_text.try_cast("double")
    percent = F.when((from_text > 1.0) & (from_text <= 100.0), from_text / 100.0).otherwise(from_text)
    return F.when(is_number, clamp01(_field(v, "$", "double"))).when(kind == "STRING", clamp01(percent))


def coerce_score(v: Column) -> Column:
    """Score in [0, 1] from a number, ``"85%"``, a list or an object, nested to any depth.

    A value is no deeper than it has brackets, so it is unwrapped once for each.
    """
    brackets = bind(F.coalesce(F.to_json(v), F.lit("")), lambda s: F.length(s) - F.length(F.translate(s, "[{", "")))
    return F.aggregate(F.sequence(F.lit(0), brackets), v, lambda inner, _: _unwrap(inner), _number)


def outer_array(text: Column) -> Column:
    """Text from the first ``[`` to the last ``]``, inside the fence when there is one."""
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(\[.*?\])\s*```", 1)
    return F.regexp_extract(F.when(fenced != "", fenced).otherwise(text), r"(?s)\[.*\]", 0)


def outer_object(text: Column) -> Column:
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.regexp_extract(F.when(fenced != "", fenced).otherwise(text), r"(?s)\{.*\}", 0)


def parse_rerank(responses: DataFrame, key: str, raw: str = "raw", count: str = "chunk_count") -> DataFrame:
    """``key, ordinal, score`` of every usable item; the last score of an ordinal counts."""
    parsed = responses.withColumn("_v", F.try_parse_json(outer_array(F.col(raw))))
    items = parsed.select(
        key, count, F.posexplode(F.try_variant_get("_v", "$", "array<variant>")).alias("_at", "_item")
    ).filter(F.startswith(_kind(F.col("_item")), F.lit("OBJECT")))
    ident = _field(F.col("_item"), "$.id")
    ordinal = F.when(_kind(ident) == "STRING", strip(_field(ident, "$", "string")).try_cast("bigint")).otherwise(
        F.floor(_field(ident, "$", "double")).cast("bigint")
    )
    return (
        items.withColumn("ordinal", ordinal)
        .withColumn("score", coerce_score(_field(F.col("_item"), "$.score")))
        .filter(F.col("score").isNotNull() & F.col("ordinal").between(1, F.col(count)))
        .groupBy(key, "ordinal")
        .agg(F.max_by("score", "_at").alias("score"))
    )


def fenced_json(text: Column) -> Column:
    """VARIANT of a JSON text with or without a code fence; null when it does not parse."""
    body = strip(text)
    bare = F.regexp_replace(F.regexp_replace(body, "^```(?:json)?\n?", ""), "\n?```$", "")
    return F.try_parse_json(strip(F.when(F.startswith(body, F.lit("```")), bare).otherwise(body)))


def truthy(v: Column) -> Column:
    kind = _kind(v)
    return F.coalesce(
        F.when(kind == "BOOLEAN", _field(v, "$", "boolean"))
        .when(kind == "STRING", _field(v, "$", "string") != "")
        .when(kind.isin("BIGINT", "DOUBLE") | F.startswith(kind, F.lit("DECIMAL")), _field(v, "$", "double") != 0)
        .otherwise(~F.to_json(v).isin("[]", "{}", "null")),
        F.lit(False),
    )


INTENTS = ("current", "historical", "neutral")


def parse_classification(text: Column, message: Column) -> Column:
    """Struct of ``needs_history, needs_rewrite, query_intent, queries`` with safe defaults."""

    def read(v: Column) -> Column:
        needs = truthy(_field(v, "$.needs_history"))
        intent = F.lower(strip(_field(v, "$.query_intent", "string")))
        raw = _field(v, "$.search_queries")
        listed = F.filter(
            F.transform(_field(raw, "$", "array<string>"), lambda q: strip(q)), lambda q: q != ""
        )
        legacy = strip(F.coalesce(_field(v, "$.search_query", "string"), F.lit("")))
        legacy_list = F.when(legacy == "", F.array().cast("array<string>")).otherwise(F.array(legacy))
        found = F.when(F.startswith(_kind(raw), F.lit("ARRAY")), listed).otherwise(legacy_list)
        queries = F.when(F.size(found) == 0, F.array(F.lower(strip(message)))).otherwise(found)
        none = F.array().cast("array<string>")
        return F.struct(
            F.coalesce(needs, F.lit(False)).alias("needs_history"),
            F.coalesce(needs & truthy(_field(v, "$.needs_rewrite")), F.lit(False)).alias("needs_rewrite"),
            F.when(needs & intent.isin(*INTENTS), intent).otherwise("neutral").alias("query_intent"),
            F.when(F.coalesce(needs, F.lit(False)), queries).otherwise(none).alias("queries"),
        )

    return bind(F.try_parse_json(outer_object(text)), read)


def query_list(text: Column, fallback: Column, limit: int = 3) -> Column:
    """Non-blank lines, at most ``limit`` queries, or the question itself."""
    found = F.filter(F.transform(F.split(text, "\n"), strip), lambda q: q != "")
    return F.when(F.size(found) == 0, F.array(fallback)).otherwise(F.slice(found, 1, limit))


def query_terms(queries: Column) -> Column:
    """All distinct white-space terms of several queries in order of first use."""
    split = F.flatten(F.transform(queries, lambda q: F.split(strip(q), r"\s+")))
    return F.filter(F.array_distinct(split), lambda t: t != "")


def interleave(rewrites: Column, existing: Column, original: Column, limit: int = 8) -> Column:
    """Alternate two query lists, drop repeats and blanks, end with the original."""
    zipped = F.zip_with(rewrites, existing, lambda a, b: F.array(a, b))
    merged = F.array_distinct(F.filter(F.flatten(zipped), lambda q: q.isNotNull() & (q != "")))
    anchored = F.when(
        (original != "") & ~F.array_contains(merged, original), F.array_append(merged, original)
    ).otherwise(merged)
    return F.slice(anchored, 1, limit)


def sane_rewrites(message: Column, recent: Column, rewrites: Column, short_words: int = 3) -> Column:
    """Rewrites of a short message that share no word with the last turns are dropped."""
    words = F.filter(
        F.split(F.lower(recent), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 2
    )
    everything = F.lower(F.array_join(rewrites, " "))
    related = F.exists(words, lambda w: F.contains(everything, w))
    unrelated = (word_count(message) <= short_words) & (F.size(words) > 0) & ~related
    return F.when(F.coalesce(unrelated, F.lit(False)), F.array().cast("array<string>")).otherwise(rewrites)


def context_query(message: Column, recent: Column, words: int = 4, chars: int = 200) -> Column:
    """Message of at most ``words`` words followed by the last turns, else null."""
    combined = F.left(strip(F.concat_ws(" ", message, recent)), F.lit(chars))
    extend = (word_count(message) <= words) & recent.isNotNull() & (combined != message)
    return F.when(extend, combined)


