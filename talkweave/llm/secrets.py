"""Secrets in texts: plain patterns, and weak parts that are reported only beside their complement.

Base kinds (``assign``, ``access``, ``hex``) are always reported.  Weak kinds are ``id`` (a token of 16 to 32 capitals
and digits with both), ``key`` (a token of 24 or more characters with capitals, small letters and digits that is no
``id``) and ``endpoint`` (an http address).  An identifier (``access``, ``id``), a secret (``assign``, ``hex``, ``key``)
and an endpoint are the parts of a credential.  A weak part is reported if a complementary part starts in its scope, at
most ``REACH`` code points away: an identifier or endpoint needs a secret, a secret an identifier or endpoint.  The scopes
are joined as intervals: parts meet by buckets of ``REACH`` code points, then by distance, in a semi join.  Parts that
overlap do not vouch for each other, and what lies inside a base span is no weak part of its own.

Positions come from the pieces between matches, so all of it is SQL functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.functions.text import bind
from talkweave.llm.rows import cut, identified

REACH = 200


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(either_case(x) for x in ("password", "passwd", "secret", "token", "api_?key"))
PATTERNS = {
    "assign": rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"(AKIA[A-Z0-9]+)",
    "hex": r"([0-9a-f]{16,})",
    "token": r"([A-Za-z0-9+/=_-]{16,})",
    "endpoint": r"(https?://[A-Za-z0-9./:_-]+)",
}
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
BASE = KINDS[:3]
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "id": "identifier", "key": "secret", "endpoint": "endpoint"}
_SPANS = "array<struct<begin:int,rank:int,end:int,kind:string>>"


# What a text has that holds a match to keep, found in a fraction of the time: an assigned value of twelve characters, a key's
# start, a digit with at least eight more characters of a token on one side, an address's start.
_VALUE = r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}"""
_DIGIT = r"[0-9](?:[A-Za-z0-9+/=_-]{8}|(?<=[A-Za-z0-9+/=_-]{8}[0-9]))"


def _running(numbers: Column, block: int = 64) -> Column:
    """Running sums.  Appending copies a list, so sums run inside blocks and over the sums of blocks."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, n: a + n)

    def from_(first: Column, x: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"] + n).alias("out"))
        return F.aggregate(x, start, step, lambda a: a["out"])

    def blocks(x: Column) -> Column:
        first = F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(block))
        return F.transform(first, lambda i: F.slice(x, i, F.lit(block)))

    return bind(
        bind(numbers, blocks), lambda held: bind(from_(F.lit(0), F.transform(held, total)), lambda ends: F.flatten(F.transform(held, lambda x, i: from_(ends[i] - total(x), x))))
    )


def _matches(text: Column, pattern: str, kind: Callable[[Column], Column], keep: Callable[[Column], Column], may: Column) -> Column:
    """Spans of the leftmost matches for whose text ``keep`` holds; ``kind`` is an expression of that text.

    ``may`` holds for every text with such a match and is cheap.  Only where it does the pattern is matched, once, and only
    where a match is kept the places are found: a match's start is the length of all pieces and matches before it.
    """
    rank = lambda k: F.array_position(F.array(*map(F.lit, KINDS)), k).cast("int")

    def placed(whole: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
        steps = F.zip_with(gaps, whole, lambda g, m: F.length(g) + F.length(m))
        ends = F.arrays_zip(whole.alias("all"), _running(steps).alias("end"))
        return F.transform(
            F.filter(ends, lambda x: keep(x["all"])),
            lambda x: F.struct((x["end"] - F.length(x["all"])).alias("begin"), rank(kind(x["all"])).alias("rank"), x["end"].alias("end"), kind(x["all"]).alias("kind")),
        )

    found = F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return bind(found, lambda whole: F.when(F.exists(whole, keep), placed(whole)).otherwise(F.array()).cast(_SPANS))


def _weak_kind(token: Column) -> Column:
    both = token.rlike("[A-Z]") & token.rlike("[0-9]")
    return F.when(token.rlike("^[A-Z0-9]{16,32}$") & both, "id").when((F.length(token) >= 24) & both & token.rlike("[a-z]"), "key").otherwise("")


def candidates(text: Column) -> Column:
    """All spans of base kinds and the weak ones that lie in none of them, unlinked."""
    name = lambda k: lambda m: F.lit(k)
    every = lambda m: F.lit(True)
    value = lambda m: F.regexp_extract(m, PATTERNS["assign"], 2)
    assigns = (text.contains(":") | text.contains("=")) & text.rlike(_VALUE)
    base = F.concat(
        _matches(text, PATTERNS["assign"], name("assign"), lambda m: F.length(value(m)) >= 12, assigns),
        _matches(text, PATTERNS["access"], name("access"), lambda m: F.length(m) >= 18, text.contains("AKIA")),
        _matches(text, PATTERNS["hex"], name("hex"), every, text.rlike(PATTERNS["hex"])),
    )
    weak = F.concat(
        _matches(text, PATTERNS["token"], _weak_kind, lambda m: _weak_kind(m) != "", text.rlike(_DIGIT)),
        _matches(text, PATTERNS["endpoint"], name("endpoint"), every, text.contains("http")),
    )
    inside = lambda s, b: (b["begin"] <= s["begin"]) & (s["end"] <= b["end"])
    return bind(base, lambda held: F.concat(held, F.filter(weak, lambda s: ~F.exists(held, lambda b: inside(s, b)))))


def linked_parts(spans: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak rows of ``id, digest, span`` that have a complementary part in their scope."""
    roles = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    rows = spans.withColumn("role", F.element_at(roles, F.col("span.kind"))).withColumn("bucket", F.floor(F.col("span.begin") / reach))
    weak = rows.where(F.col("span.rank") > len(BASE)).withColumn("secret", F.col("role") == "secret")
    # Each part is in the buckets whose members may be that near; one row per place and side is enough.
    others = rows.select(
        "id", "digest", (F.col("role") == "secret").alias("secret"), F.col("span.begin").alias("begin"), F.col("span.end").alias("end"),
        F.explode(F.sequence(F.col("bucket") - 1, F.col("bucket") + 1)).alias("bucket"),
    ).distinct()
    left, right = weak.alias("l"), others.alias("r")
    on = (
        F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.digest") == F.col("r.digest")) & (F.col("l.bucket") == F.col("r.bucket"))
        & (F.col("l.secret") != F.col("r.secret")) & (F.abs(F.col("l.span.begin") - F.col("r.begin")) <= reach)
        & ((F.col("r.begin") >= F.col("l.span.end")) | (F.col("r.end") <= F.col("l.span.begin")))
    )
    return left.join(right, on, "left_semi").select("id", "digest", "span")


def find_secrets(docs: DataFrame, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, digest, spans`` per row of ``docs``; a span has ``begin, rank, end, kind`` in code points, end exclusive.

    Spans are sorted by start, then kind in the order of ``KINDS``.  Null texts have none.  A weak part lies in one row's
    text with its complement, never in two; repeated rows give equal rows.  No rows give no rows.
    """
    rows = identified(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    # Kept, as three branches read it and each would match all texts again.
    found = cut(rows.select("id", "digest", candidates(F.col("text")).alias("all")))
    weak = linked_parts(found.where(F.size("all") > 1).select("id", "digest", F.explode("all").alias("span")), reach)
    weak = weak.groupBy("id", "digest").agg(F.collect_set("span").alias("weak"))
    base = found.select("id", "digest", F.filter("all", lambda s: s["rank"] <= len(BASE)).alias("base"))
    left, right = base.alias("l"), weak.alias("r")
    on = F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.digest") == F.col("r.digest"))
    spans = F.array_sort(F.concat("base", F.coalesce("weak", F.array().cast(_SPANS))))
    return left.join(right, on, "left").select("l.id", "l.digest", spans.alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")
