"""Rule routing of utterances: casual, memory or ambiguous."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkweave.functions.text import normalise, strip

# Utterances that are always casual.
CASUAL = (
    "k", "ok", "okay", "hn", "haan", "ha", "nhi", "nah", "no", "yes", "ya", "yep", "yup",
    "lol", "lmao", "haha", "hehe", "hehee", "hmm", "hm", "nice", "cool", "wow", "thanks",
    "ty", "thx", "sure", "done", "see", "bye", "hi", "hello", "hey", "sup", "good", "great",
    "same", "true", "right", "fine", "isee", "i see", "got it", "achha", "accha", "theek",
    "thik", "sahi", "haye", "arey", "arre", "oye", "uff", "ugh",
)

# Phrases that ask about the past, each bounded by non-word characters.
MEMORY = (
    r"yaad",
    r"remember",
    r"recall",
    r"kab\s+(tha|thi|the|hui|hua|hoga|hogi|plan|fix|decide)",
    r"kya\s+(bola|boli|bolta|bolti|kaha|kahi|likha|likhi)",
    r"woh\s+wala",
    r"us\s+din",
    r"us\s+time",
    r"pehle",
    r"purane?",
    r"last\s+time",
    r"when\s+did",
    r"what\s+did\s+(we|you|i|they)",
    r"kitne\s+din",
    r"kis\s+din",
    r"kons[aei]\s+din",
    r"(remind|bata\s+na|batao\s+na)",
    r"(trip|plan|meeting|event)\s+(kab|when|kya)",
    r"history",
    r"past\s+(message|chat|conversation)",
)

# Fixed value: characters of a reaction without words.
EMOJI_ONLY = (
    r"^[\s\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE00}-\x{FE0F}\x{200D}\x{1F1E0}-\x{1F1FF}!?.,]+$"
)


def memory_pattern(phrases: Sequence[str] = MEMORY) -> str:
    """One regular expression for all phrases."""
    return r"(^|[^\p{L}\p{N}_])(" + "|".join(phrases) + r")([^\p{L}\p{N}_]|$)"


def route(message: Column, casual: Sequence[str] = CASUAL, memory: Sequence[str] = MEMORY) -> Column:
    """``casual``, ``memory`` or ``ambiguous``."""
    raw = strip(message)
    norm = normalise(message)
    words = F.regexp_count(norm, F.lit(r"\S+"))
    asks = F.contains(norm, F.lit("?"))
    remembers = norm.rlike(memory_pattern(memory))
    return (
        F.when(raw == "", "casual")
        .when(F.length(norm) <= 2, "casual")
        .when(raw.rlike(EMOJI_ONLY), "casual")
        .when(norm.isin(*casual), "casual")
        .when(asks & (words >= 2), F.when(remembers, "memory").otherwise("ambiguous"))
        .when((F.length(norm) <= 12) & ~asks & ~remembers & (words <= 2), "casual")
        .when(remembers, "memory")
        .otherwise("ambiguous")
    )


def needs_validation(reply: Column, minimum: int = 20) -> Column:
    """Replies long enough and not casual, so worth a grounding check."""
    return (F.length(strip(reply)) >= minimum) & (route(reply) != "casual")
