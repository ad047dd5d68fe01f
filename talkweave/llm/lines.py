"""Removal of lines that many documents share, found with two Bloom filters.

A task adds the line keys of its rows to a filter of hashes seen once; a hash that is in it already goes to the
filter of hashes seen twice.  Two tasks merge as ``once = a | b`` and ``twice = ta | tb | (a & b)``: bits that
both have hold every hash that both have, so no repeat is missed.  The merged second filter, of at most
``max_bits`` bits, is sent to all tasks, and only lines that it suspects are shuffled, with their keys.  There
they are counted exactly and the first occurrence of each is chosen.  On data beyond the bound the filter lets
more lines pass to the exact count; the result stays the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkweave.llm.rows import col, cut, identified, unused, with_decisions
from talkweave.llm.words import mix, slices

SPACE = b" \t\n\v\f\r"
SEGMENT = 1 << 16
PROBES = 4
BITS_PER_LINE = 10


def line_keys(text: str | None) -> list[bytes]:
    """The key of every line: stripped of ASCII white space, A-Z in lower case."""
    return [line.strip(SPACE).lower() for line in (text or "").encode().split(b"\n")]


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    probes = np.arange(PROBES, dtype=np.uint64)[:, None]
    return ((mix(hashes)[None] + probes * step[None]) & np.uint64(bits - 1)).astype(np.int64)


def _set(filter_: np.ndarray, hashes: np.ndarray, bits: int) -> None:
    at = _positions(hashes, bits).ravel()
    np.bitwise_or.at(filter_, at >> 3, (1 << (at & 7)).astype(np.uint8))


def _has(filter_: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = _positions(hashes, bits)
    return ((filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def _hash(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _parts(batches):
    """The rows of all batches, about a megabyte of text at a time."""
    for batch in batches:
        for low, high in slices(batch.column("text")):
            yield batch.slice(low, high - low)


def _filters(bits: int):
    """The parts of both filters of a task that have a bit set."""

    def run(batches):
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for part in _parts(batches):
            keys: list[bytes] = []
            for text in part.column("text").to_pylist():
                keys += {k for k in line_keys(text) if k}
            hashes, times = np.unique(_hash(keys), return_counts=True)
            again = hashes[(times > 1) | _has(once, hashes, bits)]
            _set(twice, again, bits)
            _set(once, hashes, bits)
        size = min(SEGMENT, bits // 8)
        for i in range(0, bits // 8, size):
            if once[i : i + size].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i // size], pa.int32()), pa.array([once[i : i + size].tobytes()]), pa.array([twice[i : i + size].tobytes()])],
                    ["segment", "once", "twice"],
                )

    return run


def _merge(batches):
    """One row per segment from rows sorted by segment."""
    at, once, twice = None, None, None
    for batch in batches:
        for segment, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            if segment != at:
                if at is not None and twice.any():
                    yield _merged(at, twice)
                at, once, twice = segment, a.copy(), b.copy()
            else:
                twice |= b | (once & a)
                once |= a
    if at is not None and twice.any():
        yield _merged(at, twice)


def _merged(segment, twice):
    return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([twice.tobytes()])], ["segment", "twice"])


def _suspects(filter_, bits: int):
    def run(batches):
        held = np.frombuffer(filter_.value, np.uint8)
        for batch in _parts(batches):
            source, keys, places = [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                lines: dict[bytes, list[int]] = {}
                for i, key in enumerate(line_keys(text)):
                    if key:
                        lines.setdefault(key, []).append(i)
                known = list(lines)
                for j in np.flatnonzero(_has(held, _hash(known), bits)):
                    source.append(row)
                    keys.append(known[j])
                    places.append(lines[known[j]])
            take = pa.array(source, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), batch.column("digest").take(take), pa.array(keys, pa.binary()).cast(pa.string()), pa.array(places, pa.list_(pa.int32()))],
                ["id", "digest", "key", "places"],
            )

    return run


def twice_seen(rows: DataFrame, max_bits: int) -> tuple[bytes, int]:
    """The filter of line keys that two rows have, at most ``max_bits / 8`` bytes, and its number of bits."""
    lines = rows.select(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("bigint"))).first()[0] or 0
    bits = min(max_bits, max(1 << 16, 1 << int(lines * BITS_PER_LINE).bit_length()))
    parts = rows.select("text").mapInArrow(_filters(bits), "segment int, once binary, twice binary")
    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merge, "segment int, twice binary")
    held = bytearray(bits // 8)
    for segment, twice in merged.collect():  # never more than the filter's own bytes
        held[segment * len(twice) : (segment + 1) * len(twice)] = twice
    return bytes(held), bits


@F.arrow_udf(T.StructType().add("text", T.StringType()).add("n_lines", T.LongType()).add("n_dropped", T.LongType()))
def _without(text: pa.Array, places: pa.Array) -> pa.Array:
    kept, lines, dropped = [], [], []
    for t, p in zip(text.to_pylist(), places.to_pylist(), strict=True):
        all_lines = (t or "").split("\n")
        gone = set(p or ())
        kept.append("\n".join(x for i, x in enumerate(all_lines) if i not in gone))
        lines.append(len(all_lines))
        dropped.append(len(gone))
    return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["text", "n_lines", "n_dropped"])


def drop_shared_lines(
    docs: DataFrame,
    min_docs: int = 10,
    keep: str = "none",
    id_col: str = "doc_id",
    text_col: str = "text",
    max_bits: int = 1 << 28,
) -> tuple[DataFrame, Column]:
    """``docs`` with a struct column ``text, n_lines, n_dropped``, and that column.

    A line goes if its key is not empty and at least ``min_docs`` rows have it; with ``keep="first"`` the
    occurrence in the row of the smallest id (then digest of the text, then line number) stays.  A null or empty
    text is one empty line, and its new text is empty.  A row counts once however often it has a key; repeated
    rows count each, and null ids are rows like others (they come last in the order).  No rows give no rows.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    rows = identified(docs, id_col, text_col)
    held, bits = twice_seen(rows, max_bits)
    kind = dict(rows.dtypes)["id"]
    suspects = rows.mapInArrow(
        _suspects(docs.sparkSession.sparkContext.broadcast(held), bits), f"id {kind}, digest bigint, key string, places array<int>"
    )
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "digest", F.col("places")[0].alias("line")))
    shared = suspects.groupBy("key").agg(F.count("*").alias("docs"), first.alias("first")).where(F.col("docs") >= min_docs)
    # On a table of its own the join can split a line that very many documents have.
    found = suspects.join(cut(shared), "key")
    if keep == "first":
        own = F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.digest") == F.col("digest"))
        found = found.withColumn("places", F.when(own, F.array_remove("places", F.col("first.line"))).otherwise(F.col("places")))
    # Equal rows have equal places for a key, so one of them tells; a group then holds the keys of one text at most.
    once = found.groupBy("id", "digest", "key").agg(F.max("places").alias("places"))
    places = once.groupBy("id", "digest").agg(F.flatten(F.collect_list("places")).alias("places"))
    name = unused(docs, "dropped_places")
    joined = with_decisions(docs, places.withColumnRenamed("places", name), id_col, text_col)
    out = unused(joined, "without_shared")
    return joined.withColumn(out, _without(col(text_col), col(name))).drop(name), F.col(f"`{out}`")
