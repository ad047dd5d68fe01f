"""From raw export lines to a typed message table.

Everything is a native expression.  The only ordered step (which message does a
continuation line belong to) is a running maximum over blocks of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.functions.text import INVISIBLE, ODD_SPACES, bind, is_noise, rstrip, strip
from talkweave.plans.ordered import block_of, running_before, top_rows
from talkweave.schema import BLOCK_ROWS

# Line markers of the export format.
EDITED = r"(?i)\s*<This message was edited>\s*$"
DELETED_BODY = r"(?i)^This message was deleted\.?$"
DELETED_TAG = "[message deleted]"
TIME = r"(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([APMapm]{2})?"
DATE = r"(\d{1,2})/(\d{1,2})/(\d{2,4})"
ANDROID = "(?s)^" + DATE + r",\s+" + TIME + r"\s+-\s+(.+)$"
IOS = r"(?s)^\[" + DATE + r",\s+" + TIME + r"\]\s+(.+)$"
SEPARATOR = "\x1f"
STARTS_LIKE_HEADER = r"^\[?\d{1,2}/\d{1,2}/\d{2,4},\s+\d{1,2}:\d{2}"


def clean_characters(text: Column) -> Column:
    """Line ends to LF, odd spaces to plain spaces, invisible characters out."""
    text = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.translate(text, ODD_SPACES + INVISIBLE, " " * len(ODD_SPACES))


def clean_line(line: Column) -> Column:
    """Trailing space and edit marker dropped, a deleted body replaced by a tag.

    Few lines hold a marker, so a plain search decides whether a pattern runs at all.
    """

    def without_marker(x: Column) -> Column:
        marked = F.contains(F.lower(x), F.lit("<this message was edited>"))
        return F.when(marked, F.regexp_replace(x, EDITED, "")).otherwise(x)

    def tagged(bare: Column) -> Column:
        last = F.substring_index(bare, ": ", -1)
        head = F.left(bare, F.length(bare) - F.length(last))
        in_header = bare.rlike(STARTS_LIKE_HEADER)
        named = in_header & F.contains(bare, F.lit(": ")) & strip(last).rlike(DELETED_BODY)
        return (
            F.when(~F.contains(F.lower(bare), F.lit("this message was deleted")), bare)
            .when(named, F.concat(head, F.lit(DELETED_TAG)))
            .when(~in_header & strip(bare).rlike(DELETED_BODY), DELETED_TAG)
            .otherwise(bare)
        )

    return bind(bind(rstrip(line), without_marker), tagged)


def clean_text(text: Column) -> Column:
    """A whole export text cleaned; blank lines go once a message has begun."""

    def kept(lines: Column) -> Column:
        first = F.array_position(F.transform(lines, lambda x: x == ""), False)
        return bind(first, lambda at: F.filter(lines, lambda x, i: (x != "") | (at == 0) | (i < at - 1)))

    bare = F.transform(F.split(clean_characters(text), "\n"), rstrip)
    return F.array_join(F.transform(bind(bare, kept), clean_line), "\n")


def clean_lines(lines: DataFrame) -> DataFrame:
    """Cleaned non-blank lines with ``seq`` untouched."""
    return visible_lines(lines).withColumn("line", clean_line(clean_characters(F.col("line"))))


def visible_lines(lines: DataFrame) -> DataFrame:
    """Lines that show something: a test cheap enough to run before cleaning."""
    shown = F.translate("line", ODD_SPACES + INVISIBLE, " " * len(ODD_SPACES))
    return lines.filter(strip(shown) != "")


def detect_format(lines: DataFrame) -> DataFrame:
    """``workspace_id, export_format`` from the first 40 lines; ``android`` when none fits."""
    head = top_rows(visible_lines(lines), ["workspace_id"], [F.col("seq")], 40)
    head = head.withColumn("line", clean_line(clean_characters(F.col("line"))))
    kind = F.when(F.col("line").rlike(IOS), "ios").when(F.col("line").rlike(ANDROID), "android")
    return (
        head.withColumn("kind", kind)
        .groupBy("workspace_id")
        .agg(
            F.coalesce(
                F.min_by("kind", F.when(F.col("kind").isNotNull(), F.col("seq"))), F.lit("android")
            ).alias("export_format")
        )
    )


def parse_timestamp(d1: Column, d2: Column, year: Column, h: Column, m: Column, s: Column, half: Column) -> Column:
    """Header time, day first, month first when that gives no date; null when nothing fits.

    Two-digit years turn at 69, and with seconds they need AM or PM.
    """
    digits = F.length(year)
    y = year.cast("int")
    full_year = F.when(digits == 4, y).when(digits == 2, F.when(y >= 69, y + 1900).otherwise(y + 2000))
    hour = h.cast("int")
    has_half = half != ""
    pm = F.upper(half) == "PM"
    twelve = F.when(
        F.upper(half).isin("AM", "PM") & hour.between(1, 12),
        (hour % 12) + F.when(pm, 12).otherwise(0),
    )
    real_hour = F.when(has_half, twelve).otherwise(hour)
    allowed = has_half | (digits == 4) | (s == "")
    seconds = F.when(s == "", F.lit("0")).otherwise(s).cast("decimal(16,6)")

    def at(day: Column, month: Column) -> Column:
        return F.try_make_timestamp_ntz(
            full_year, month.cast("int"), day.cast("int"), real_hour, m.cast("int"), seconds
        )

    return F.when(allowed, F.coalesce(at(d1, d2), at(d2, d1)))


def parse_lines(raw_lines: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Messages of raw lines, header problems included (their ``ts`` is null).

    ``seq`` is the number of the header line.  A message is one row, however many lines it
    has; ``block`` only bounds the scan for headers.
    """
    marked = clean_lines(raw_lines).join(detect_format(raw_lines), "workspace_id")
    pattern_hit = F.when(F.col("export_format") == "ios", F.col("line").rlike(IOS)).otherwise(
        F.col("line").rlike(ANDROID)
    )
    marked = marked.withColumn("is_header", pattern_hit).withColumn("_blk", block_of("seq", block))
    located = running_before(
        marked,
        ["workspace_id"],
        "_blk",
        [F.col("seq")],
        {"_open": ("max", F.when(F.col("is_header"), F.col("seq")))},
    )
    header = F.when(F.col("is_header"), F.col("seq")).otherwise(F.col("_open"))
    grouped = (
        located.withColumn("header_seq", header)
        .filter(F.col("header_seq").isNotNull())
        .groupBy("workspace_id", "header_seq")
        .agg(
            F.max(F.when(F.col("is_header"), F.col("line"))).alias("raw"),
            F.max("export_format").alias("export_format"),
            F.expr("listagg(CASE WHEN NOT is_header THEN nullif(line, '') END, '\n') WITHIN GROUP (ORDER BY seq)").alias("_more"),
        )
    )

    # One match per message: the groups come back joined and are split again.
    groups = SEPARATOR.join(f"${i}" for i in range(1, 9))
    fields = F.when(F.col("export_format") == "ios", F.regexp_replace("raw", IOS, groups)).otherwise(
        F.regexp_replace("raw", ANDROID, groups)
    )
    grouped = grouped.withColumn("_f", F.split(fields, SEPARATOR, 8))
    grouped = grouped.withColumn("ts", parse_timestamp(*[F.col("_f")[i] for i in range(7)]))
    grouped = grouped.withColumn("_rest", F.col("_f")[7])
    named = F.contains("_rest", F.lit(": "))
    body = F.when(named, F.expr("substring(_rest, instr(_rest, ': ') + 2)")).otherwise(strip(F.col("_rest")))
    first_line = F.when(body != "", body)
    return grouped.select(
        "workspace_id",
        F.col("header_seq").alias("seq"),
        "header_seq",
        "export_format",
        "ts",
        F.when(named, strip(F.substring_index("_rest", ": ", 1))).otherwise(F.lit("System")).alias("sender"),
        F.concat_ws("\n", first_line, F.col("_more")).alias("text"),
        (~named).alias("is_system"),
        "raw",
    )


def with_message_id(messages: DataFrame) -> DataFrame:
    """Id from content and place, so a second parse of the same file gives the same id."""
    return messages.withColumn(
        "message_id",
        F.sha2(
            F.concat_ws("␟", "workspace_id", F.col("seq").cast("string"), F.col("ts").cast("string"), "sender", "text"),
            256,
        ),
    )


def parse_exports(lines: DataFrame, block: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """``(messages, rejects)`` of raw lines; a header whose date fits no format is a reject."""
    parsed = parse_lines(lines, block)
    columns = ("workspace_id", "seq", "message_id", "ts", "sender", "text", "is_system")
    messages = with_message_id(parsed.filter(F.col("ts").isNotNull())).select(*columns)
    rejects = parsed.filter(F.col("ts").isNull()).select("workspace_id", "seq", "raw")
    return messages, rejects


def stitch_lines(lines: DataFrame, part: str, block: int = BLOCK_ROWS) -> DataFrame:
    """Join each line to the last header line before it; lines before the first go.

    ``lines`` has ``part``, ``seq``, ``line`` and a boolean ``is_header``.  A message is one row, however many lines it has;
    ``block`` only bounds the scan for headers.
    """
    located = running_before(
        lines.withColumn("_blk", block_of("seq", block)),
        [part],
        "_blk",
        [F.col("seq")],
        {"_open": ("max", F.when(F.col("is_header"), F.col("seq")))},
    )
    located = located.withColumn(
        "header_seq", F.when(F.col("is_header"), F.col("seq")).otherwise(F.col("_open"))
    ).filter(F.col("header_seq").isNotNull())
    return (
        located.groupBy(part, "header_seq")
        .agg(
            F.count(F.lit(1)).alias("line_count"),
            F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY seq)").alias("text"),
        )
    )


def ingest_gate(messages: DataFrame, minimum: int = 50) -> DataFrame:
    """Usable messages per workspace and whether there are enough to go on."""
    usable = ~F.col("is_system") & ~is_noise(F.col("text"))
    return messages.groupBy("workspace_id").agg(
        F.count_if(usable).alias("usable_count"), (F.count_if(usable) >= minimum).alias("eligible")
    )
