"""Merging hit lists, adjusting scores, gating and verdicts.

Hit lists are small: at most ``k`` rows per query and leg.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkweave.functions.scores import adjusted, dual_gate, passes_gate, recency_delta
from talkweave.functions.text import chunk_density, snippet, strip
from talkweave.operators.search import bm25_topk, cosine_topk
from talkweave.plans.ordered import top_rows


def best_first(part: str) -> list[Column]:
    return [F.col("score").desc(), F.col("message_id")]


def merge_hits(legs: list[DataFrame], limit: int, part: str = "query_id") -> DataFrame:
    """Union of legs, best score per message, best ``limit`` messages per request."""
    rows = reduce(DataFrame.unionByName, [leg.select(part, "message_id", "score") for leg in legs])
    best = rows.groupBy(part, "message_id").agg(F.max("score").alias("score"))
    return top_rows(best, [part], best_first(part), limit)


def hybrid_merge(semantic: DataFrame, keyword: DataFrame, limit: int = 40) -> DataFrame:
    """Semantic and keyword hits by the larger raw score."""
    return merge_hits([semantic, keyword], limit)


def multi_query_boost(semantic: DataFrame, keyword: DataFrame, queries: DataFrame, limit: int = 40) -> DataFrame:
    """Candidates of a request asked in several phrasings.

    Keyword hits join every phrasing; a message found by ``n`` phrasings gains 15 % of its
    best score for each one after the first.
    """
    phrasing = queries.select("request_id", "query_id")
    spread = keyword.select("request_id", "message_id", "score").join(phrasing, "request_id")
    rows = semantic.select("request_id", "query_id", "message_id", "score").unionByName(
        spread.select("request_id", "query_id", "message_id", "score")
    )
    per_query = rows.groupBy("request_id", "query_id", "message_id").agg(F.max("score").alias("score"))
    per_query = top_rows(per_query, ["request_id", "query_id"], best_first("query_id"), limit)
    return (
        per_query.groupBy("request_id", "message_id")
        .agg(F.count(F.lit(1)).alias("found_by"), F.max("score").alias("best"))
        .withColumn("score", F.col("best") * (1 + (F.col("found_by") - 1) * 0.15))
        .drop("best")
    )


def ranked(hits: DataFrame, part: str = "request_id", k: int | None = None, rank: str = "ordinal") -> DataFrame:
    """Ordinals from 1 by score; ``k`` keeps the first ones."""
    number = F.row_number().over(Window.partitionBy(part).orderBy(*best_first(part)))
    out = hits.withColumn(rank, number.cast("bigint"))
    return out.filter(F.col(rank) <= k) if k else out


def weak_pass(
    person_hits: DataFrame, queries: DataFrame, weak: float = 0.32, strong: float = 0.25, min_strong: int = 2
) -> DataFrame:
    """Per request, whether any query found too little in the person's own messages."""
    per_query = person_hits.groupBy("query_id").agg(
        F.max("score").alias("best"), F.count_if(F.col("score") >= strong).alias("strong_hits")
    )
    judged = queries.select("request_id", "query_id").join(per_query, "query_id", "left")
    is_weak = (
        F.col("best").isNull() | (F.col("best") < weak) | (F.coalesce("strong_hits", F.lit(0)) < min_strong)
    )
    return judged.groupBy("request_id").agg(F.bool_or(is_weak).alias("is_weak"))


def phrasings(queries: DataFrame) -> DataFrame:
    """Queries without outer white space; blank ones ask nothing and do not count."""
    return queries.withColumn("text", strip(F.col("text"))).filter("text <> ''")


def retrieval_legs(
    corpus: DataFrame,
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 8,
    keyword_search: Callable[[DataFrame, int], DataFrame] | None = None,
) -> DataFrame:
    """All hits of person-first retrieval: ``request_id, query_id, leg, message_id, score``.

    The person legs come first; requests with a weak query also get the group legs of all
    their queries.  One keyword search serves both scopes: the person leg keeps the hits
    spoken by the person.  ``keyword_search`` takes queries and ``k``, as the search of a
    stored index does; without it the texts of ``corpus`` are searched.
    """
    search = keyword_search or (lambda asked_, k_: bm25_topk(corpus, asked_, k_))
    queries = phrasings(queries)
    asked = queries.select("request_id", "query_id", "workspace_id", "speaker")
    keyword = (
        search(queries.select("query_id", "workspace_id", F.lower("text").alias("text")), k)
        .drop("rank")
        .join(asked, "query_id")
        .join(corpus.select("workspace_id", "message_id", F.col("speaker").alias("_said_by")), ["workspace_id", "message_id"])
    )
    own = cosine_topk(vectors, queries, k, ["workspace_id", "person_id"]).drop("rank").join(asked, "query_id")
    weak = weak_pass(own, queries).filter("is_weak").select("request_id")
    wide_queries = queries.join(weak, "request_id", "left_semi")
    group = cosine_topk(vectors, wide_queries, k, ["workspace_id"]).drop("rank").join(asked, "query_id")

    def leg(df: DataFrame, name: str) -> DataFrame:
        return df.select("request_id", "query_id", F.lit(name).alias("leg"), "message_id", "score")

    return (
        leg(own, "person_semantic")
        .unionByName(leg(keyword.filter("_said_by = speaker"), "person_keyword"))
        .unionByName(leg(group, "group_semantic"))
        .unionByName(leg(keyword.join(weak, "request_id", "left_semi"), "group_keyword"))
    )


def merge_legs(legs: DataFrame, k: int = 8) -> DataFrame:
    """Best ``k`` messages per request with ``seen``, the number of legs that found each."""
    merged = legs.groupBy("request_id", "message_id").agg(
        F.max("score").alias("score"), F.count(F.lit(1)).alias("seen")
    )
    return top_rows(merged, ["request_id"], best_first("request_id"), k)


def fast_retrieve(
    corpus: DataFrame,
    vectors: DataFrame,
    queries: DataFrame,
    as_of: Column,
    k: int = 8,
    keyword_search: Callable[[DataFrame, int], DataFrame] | None = None,
) -> DataFrame:
    """Person-first retrieval with widening, recency and density adjustment and the gate.

    ``queries``: ``request_id, query_id, workspace_id, person_id, speaker, intent, text,
    embedding``; one row per phrasing, blank ones left out.  A request lies in one workspace.
    """
    hits = merge_legs(retrieval_legs(corpus, vectors, queries, k, keyword_search), k).drop("rank")
    per_request = phrasings(queries).groupBy("request_id").agg(
        F.count(F.lit(1)).alias("query_count"), F.min("intent").alias("intent"), F.min("workspace_id").alias("workspace_id")
    )
    detail = corpus.select("workspace_id", "message_id", "speaker", "ts", snippet(F.col("text")).alias("snippet"))
    rows = hits.join(per_request, "request_id").join(detail, ["workspace_id", "message_id"]).drop("workspace_id")
    recency = recency_delta(F.col("ts"), as_of, F.col("intent"))
    rows = rows.withColumn("score", adjusted(F.col("score"), recency))
    rows = rows.withColumn("score", adjusted(F.col("score"), chunk_density(F.col("snippet"))))
    gate = dual_gate(F.col("query_count"), F.col("seen"))
    return rows.filter(passes_gate(F.col("score"), gate))


def apply_rerank(candidates: DataFrame, scores: DataFrame, k: int = 8) -> DataFrame:
    """Model scores by ordinal over the retrieval scores, best ``k`` per request."""
    given = scores.select("request_id", "ordinal", F.col("score").alias("_given"))
    rows = candidates.join(given, ["request_id", "ordinal"], "left").withColumn(
        "score", F.coalesce("_given", "score")
    )
    order = [F.col("score").desc(), F.col("ordinal")]
    return top_rows(rows.drop("_given"), ["request_id"], order, k)


def passing(reranked: DataFrame, queries: DataFrame, single: float = 0.6, multi: float = 0.45) -> DataFrame:
    """Reranked rows with ``passes``: score reaches the grade for one or several phrasings."""
    counts = queries.groupBy("request_id").agg(F.count(F.lit(1)).alias("query_count"))
    grade = F.when(F.col("query_count") > 1, multi).otherwise(single)
    return reranked.join(counts, "request_id").withColumn("passes", F.col("score") >= grade)


def verdicts(graded: DataFrame, minimum: int = 2) -> DataFrame:
    """Per request: answered or not_found, passing count and the three best as near misses."""
    near = F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "message_id"))))
    return (
        graded.groupBy("request_id")
        .agg(F.count_if("passes").alias("passing"), near.alias("_near"))
        .withColumn("status", F.when(F.col("passing") >= minimum, "answered").otherwise("not_found"))
        .withColumn(
            "near_misses",
            F.when(F.col("status") == "not_found", F.transform("_near", lambda x: x["message_id"])),
        )
        .drop("_near")
    )


def citations(graded: DataFrame, verdict: DataFrame) -> DataFrame:
    """Passing rows of answered requests as one array per request, best first."""
    answered = graded.join(verdict.filter("status = 'answered'"), "request_id", "left_semi")
    cited = answered.filter("passes").groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "message_id", "score"))).alias("citations")
    )
    return cited


def numbered_snippets(candidates: DataFrame, chars: int = 300) -> DataFrame:
    """``[i] (speaker, time): text`` lines of each request in one prompt body."""
    line = F.concat(
        F.lit("["), F.col("ordinal").cast("string"), F.lit("] ("), "speaker", F.lit(", "),
        F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("): "), snippet(F.col("text"), chars),
    )
    return (
        candidates.withColumn("line", line)
        .groupBy("request_id")
        .agg(
            F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY ordinal)").alias("body"),
            F.count(F.lit(1)).alias("lines"),
        )
    )
