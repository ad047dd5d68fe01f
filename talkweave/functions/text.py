"""Text metrics as native Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed from an export, and spaces normalised in it.
INVISIBLE = "\ufeff\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060"
ODD_SPACES = "\u202f\u00a0"
BLANKS = (
    " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
BLANK_CLASS = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Characters that end a line.
LINE_END = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"

# Bodies that carry nothing to read.
NOISE = (
    r"(?i)^(<Media omitted>|\[message deleted\]|This message was deleted\.?"
    r"|message was deleted|(image|video|audio|document|sticker|GIF)\s+omitted)$"
)

# Romanised words that mark a code-mixed message.
CODEMIX_WORDS = (
    "yaar", "bhai", "kya", "hai", "nahi", "haan", "acha", "theek", "kal", "aaj", "kyu", "kaise",
)

# Keywords of each topic; ties go to the topic named first.
TOPICS: Mapping[str, Sequence[str]] = {
    "project_work": (
        "website", "deploy", "code", "github", "server", "hosting",
        "backend", "frontend", "api", "bug", "build", "merge", "push",
        "database", "feature", "pr", "commit",
    ),
    "scheduling": (
        "kal", "timing", "meet", "time", "free", "kab", "schedule",
        "bje", "when", "date", "aaj", "abhi", "baad", "slot",
    ),
    "recruitment": (
        "interview", "candidate", "select", "panel", "hire", "liyo",
        "selected", "reject", "shortlist", "result",
    ),
    "creative_design": (
        "design", "figma", "ui", "ux", "banner", "poster", "logo",
        "creative", "graphic", "artwork",
    ),
    "social_casual": (
        "noice", "lol", "haha", "cool", "nice", "maza", "chill",
        "fun", "yaar", "bhai", "bruh", "bro", "yaar",
    ),
    "emotional_support": (
        "bura", "theek", "health", "rest", "tired", "soja", "sad",
        "sorry", "tension", "stressed", "worried", "pareshaan",
    ),
    "academic": (
        "paper", "exam", "result", "marks", "assignment", "college",
        "class", "lecture", "notes", "subject",
    ),
}

# Keywords that one number marks.
MARK_BITS = 62

WORD = r"[\p{L}\p{N}_]+"
EMOJI = r"[\x{1F300}-\x{1FAFF}]"
DEVANAGARI = r"[\x{0900}-\x{097F}]"
CAPITALISED = r"(^|\s)\p{Lu}\p{L}{2,}(\s|$)"


def strip(text: Column) -> Column:
    """Drop white space of every kind at both ends."""
    return F.trim(text, F.lit(BLANKS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``use``, however often that reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{BLANK_CLASS}]+"))


def has_two_words(text: Column) -> Column:
    """``word_count(text) > 1``, read only up to the second word."""
    return text.rlike(f"[^{BLANK_CLASS}][{BLANK_CLASS}]+[^{BLANK_CLASS}]")


def tokens(text: Column) -> Column:
    """Lower-case word tokens, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def is_noise(text: Column) -> Column:
    body = strip(text)
    return (body == "") | body.rlike(NOISE)


def emoji_rate(text: Column) -> Column:
    """Emojis per character, 0 for an empty text."""
    return F.regexp_count(text, F.lit(EMOJI)) / F.greatest(F.length(text), F.lit(1)).cast("double")


def codemix_ratio(text: Column, lexicon: Sequence[str] = CODEMIX_WORDS) -> Column:
    """Devanagari characters plus three per lexicon word, over words, at most 1."""
    listed = F.array(*[F.lit(w) for w in lexicon])
    hits = F.size(F.filter(tokens(text), lambda t: F.array_contains(listed, t)))
    marks = F.regexp_count(text, F.lit(DEVANAGARI))
    words = F.greatest(word_count(text), F.lit(1)).cast("double")
    return F.when(text == "", 0.0).otherwise(F.least(F.lit(1.0), (marks + hits * 3) / words))


def chunk_density(text: Column) -> Column:
    """Bonus in [-0.04, 0.06] from length, digits, capitalised words and line count."""
    chars = F.length(strip(text))
    lines = F.regexp_count(text, F.lit("\n")) + 1
    bonus = (
        F.when(chars > 100, 0.03).otherwise(0.0)
        + F.when(chars > 200, 0.02).otherwise(0.0)
        + F.when(text.rlike(r"\p{Nd}"), 0.02).otherwise(0.0)
        + F.when(text.rlike(CAPITALISED), 0.02).otherwise(0.0)
        - F.when(chars < 30, 0.04).otherwise(0.0)
        + F.when(lines >= 3, 0.01).otherwise(0.0)
    )
    return F.greatest(F.lit(-0.04), F.least(F.lit(0.06), bonus))


def token_estimate(text: Column) -> Column:
    """About one model token per four characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("bigint")


def is_pure_ack(text: Column) -> Column:
    """At most 4 characters, or at most 8 with no space after the fourth."""
    body = strip(text)
    size = F.length(body)
    return (size <= 4) | ((size <= 8) & ~F.contains(F.substring(body, 5, 4), F.lit(" ")))


def topic_bucket(text: Column, topics: Mapping[str, Sequence[str]] = TOPICS) -> Column:
    """Topic with most keyword hits, the first on a tie, ``general`` without any hit."""
    return F.when(text.isNotNull(), topic_of_marks(F.array(topic_marks(text, topics)), topics))


def topic_marks(text: Column, topics: Mapping[str, Sequence[str]] = TOPICS) -> Column:
    """One bit per listed keyword of a text, in array entries of ``MARK_BITS`` bits.

    Keywords have no white space, so the marks of joined texts are those of the parts together.
    """
    words = [w for listed in topics.values() for w in listed]

    def bit(low: Column, at: int) -> Column:
        return F.when(F.contains(low, F.lit(words[at])), F.lit(1 << at % MARK_BITS).cast("bigint")).otherwise(F.lit(0).cast("bigint"))

    def hits(low: Column) -> Column:
        runs = [range(start, min(start + MARK_BITS, len(words))) for start in range(0, len(words), MARK_BITS)]
        return F.array(*[reduce(Column.bitwiseOR, [bit(low, at) for at in run]) for run in runs])

    return bind(F.lower(text), hits)


def topic_of_marks(marks: Column, topics: Mapping[str, Sequence[str]] = TOPICS) -> Column:
    """Topic of some texts together, from the array of their ``topic_marks``."""
    names = F.array(*[F.lit(t) for t in topics])
    spans, start = [], 0
    for listed in topics.values():
        spans.append(range(start, start + len(listed)))
        start += len(listed)

    def counts(both: Column) -> Column:
        def count(span: range) -> Column:
            held: dict[int, int] = {}
            for at in span:
                held[at // MARK_BITS] = held.get(at // MARK_BITS, 0) | 1 << at % MARK_BITS
            return sum((F.bit_count(F.get(both, F.lit(i)).bitwiseAND(F.lit(m).cast("bigint"))) for i, m in held.items()), F.lit(0))

        return F.array(*[count(span) for span in spans])

    def best(counts: Column) -> Column:
        most = F.array_max(counts)
        return F.when(most == 0, F.lit("general")).otherwise(
            F.element_at(names, F.array_position(counts, most).cast("int"))
        )

    def entry(i: int) -> Column:
        return F.aggregate(marks, F.lit(0).cast("bigint"), lambda a, m: a.bitwiseOR(F.get(m, F.lit(i))))

    both = F.array(*[entry(i) for i in range(-(-start // MARK_BITS))])
    return bind(both, lambda b: bind(counts(b), best))


def normalise(text: Column) -> Column:
    """Lower case, outer space dropped, inner space collapsed."""
    return F.regexp_replace(strip(F.lower(text)), f"[{BLANK_CLASS}]+", " ")


def snippet(text: Column, chars: int = 500) -> Column:
    return F.substring(text, 1, chars)


def style_label(value: Column, low: float, high: float) -> Column:
    return F.when(value < low, "low").when(value < high, "medium").otherwise("high")


def emoji_label(rate: Column) -> Column:
    return style_label(rate, 0.02, 0.08)


def codemix_label(ratio: Column) -> Column:
    return style_label(ratio, 0.05, 0.15)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays taken as sets; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union.cast("double"))


def split_bursts(text: Column, separator: str = "||") -> Column:
    """Parts of a multi-message reply: paragraph breaks become spaces, empty parts go."""
    parts = F.split(text, "\\Q" + separator + "\\E")
    kept = F.filter(parts, lambda p: strip(p) != "")
    return F.transform(kept, lambda p: strip(F.regexp_replace(p, "\n{2,}", " ")))
