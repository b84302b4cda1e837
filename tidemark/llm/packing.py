"""Packing documents into sequences by cutting-stock column generation (operator 8)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, small_batches, with_text
from tidemark.llm.tokens import WordEncoder

SIZE, END = 2048, 1
#: Remainders are rounded up to multiples of this for the linear program.
GRAIN = 8
#: Remainders of a length class are ranked in so many parts at least, of so many rows in all at most, so a common length fills many tasks.
PARTS, PART_ROWS = 256, 50_000


def price_pattern(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the multiset of lengths 1..capacity with the greatest value.

    ``values[l - 1]`` is the dual price of length l. Returns the value and counts by length.
    """
    n = len(values)
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        m = min(c, n)
        got = values[:m] + best[c - 1 :: -1][:m]  # length l leaves capacity c - l
        k = int(np.argmax(got))
        best[c], take[c] = (got[k], k + 1) if got[k] > best[c - 1] else (best[c - 1], 0)
    counts, c = np.zeros(n, np.int64), capacity
    while c > 0:
        if take[c]:
            counts[take[c] - 1] += 1
            c -= take[c]
        else:
            c -= 1
    return float(best[capacity]), counts


def solve_cutting_stock(demand: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used, from the linear relaxation of cutting stock.

    Column generation: the master program starts with one pattern a length; the basis prices each
    length, :func:`price_pattern` finds the best new column, and a revised simplex step lets it in,
    until the best pattern is worth less than 1.001 sequences: by Farley's bound the solution is then
    within 0.1 % of the optimum. The basis has one row a demanded length
    (capacity rows at most), so the work doesn't depend on the number of documents.
    """
    lengths = np.flatnonzero(demand) + 1
    if not len(lengths):
        return []
    m, b = len(lengths), demand[lengths - 1].astype(float)
    columns = np.diag((capacity // lengths).astype(float))
    inverse = np.diag(1.0 / (capacity // lengths))
    x = inverse @ b
    for _ in range(rounds):
        duals = inverse.sum(axis=0)  # every pattern costs one sequence
        values = np.zeros(capacity)
        values[lengths - 1] = np.maximum(duals, 0)
        value, counts = price_pattern(values, capacity)
        if value <= 1.001:
            break
        a = counts[lengths - 1].astype(float)
        d = inverse @ a
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        r = int(np.argmin(ratio))
        if not np.isfinite(ratio[r]):
            break
        x = x - ratio[r] * d
        x[r] = ratio[r]
        columns[:, r] = a
        row = inverse[r] / d[r]
        inverse = inverse - np.outer(d, row)
        inverse[r] = row
    out = []
    for k in range(m):
        if x[k] > 1e-9:
            p = np.zeros(capacity, np.int64)
            p[lengths - 1] = np.round(columns[:, k]).astype(np.int64)
            out.append((p, float(x[k])))
    return out


def fullest(left: np.ndarray, capacity: int) -> np.ndarray:
    """The longest demanded length with the subset of the others that fills the room best."""
    first = int(np.flatnonzero(left)[-1]) + 1
    room, reach, trail = capacity - first, 1, []
    mask = (1 << (room + 1)) - 1
    for length in (np.flatnonzero(left[:room]) + 1).tolist()[::-1]:
        for _ in range(min(int(left[length - 1]) - (length == first), room // length)):
            trail.append((length, reach))
            reach |= (reach << length) & mask
    pattern, at = np.zeros(capacity, np.int64), reach.bit_length() - 1
    pattern[first - 1] = 1
    for length, before in reversed(trail):  # a sum that wasn't reached before took this piece
        if not before >> at & 1:
            pattern[length - 1] += 1
            at -= length
    return pattern


def integral_patterns(demand: np.ndarray, capacity: int, waste: float = 0.01) -> list[tuple[np.ndarray, int]]:
    """Whole patterns that use exactly ``demand``.

    The linear program's patterns that waste at most ``waste`` are taken, rounded down; what is
    left, a few per length, goes to :func:`fullest` patterns, each repeated as often as it fits.
    """
    left, out = demand.astype(np.int64).copy(), []
    sizes = np.arange(1, capacity + 1)
    for pattern, x in sorted(solve_cutting_stock(demand, capacity), key=lambda t: -t[1]):
        used = pattern > 0
        n = min(int(np.floor(x + 1e-6)), int((left[used] // pattern[used]).min()))
        if n > 0 and pattern @ sizes >= (1 - waste) * capacity:
            out.append((pattern, n))
            left -= pattern * n
    while left.any():
        pattern = fullest(left, capacity)
        used = pattern > 0
        n = int((left[used] // pattern[used]).min())
        out.append((pattern, n))
        left -= pattern * n
    return out


def cut_pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END) -> DataFrame:
    """doc_id, row_key, start, length, ids_crc32, doc_tokens: full pieces and one remainder a row.

    Long texts are encoded in chunks; a text and its ids (4 bytes each) are in memory whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = WordEncoder(path)
        tail = int(end_id).to_bytes(4, "little")
        for pdf in batches:
            pick, start, length, crc, total = [], [], [], [], []
            for k, ids in enumerate(enc.encode_many(pdf["text"].tolist())):
                ids += tail
                n = len(ids) // 4
                for a in range(0, n, size):
                    part = ids[4 * a : 4 * (a + size)]
                    pick.append(k)
                    start.append(a)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
            out = pdf.iloc[pick]
            yield pd.DataFrame(
                {"doc_id": out["doc_id"].to_numpy(), "row_key": out["row_key"].to_numpy(), "start": start,
                 "length": length, "ids_crc32": crc, "doc_tokens": total}
            )

    src = with_text(docs, F.xxhash64(F.col("doc_id"), F.col("text")).alias("row_key"))
    src = src.withColumn("doc_id", F.col("doc_id").cast("string"))
    got = src.mapInPandas(
        run, "doc_id string, row_key long, start long, length long, ids_crc32 long, doc_tokens long"
    )
    return got.withColumn("doc_id", F.col("doc_id").cast("long"))


def pack(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END, grain: int = GRAIN) -> DataFrame:
    """Packs every document's ids and an end id into sequences of at most ``size``.

    Returns one row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    A null text is empty and packs its end id alone; repeated rows are packed each, ties in a
    length class go by a hash of the row; an empty table gives no rows; other columns, whatever
    their names, play no part. A document is cut into full sequences and one remainder. Full
    sequences need no packing, only a number. Remainder lengths, rounded up to ``grain``, form a
    histogram of size / grain bins, which is all the driver sees: column generation finds patterns
    for it, and each length class hands its documents, by rank, to the patterns' places. The
    pattern table has at most a few places a length, so it may be broadcast. Ranks within a class
    come from a window over (class, part) and the running counts of the parts, which grow in number
    with the rows, so a hot class fills many tasks.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        pieces = materialize(cut_pieces(docs, path, size, end_id), "op8-pieces", waves=16)
    cap = size // grain
    cls = F.ceil(F.col("length") / grain).cast("int")
    full, rest = pieces.where(cls == cap), pieces.where(cls < cap).withColumn("cls", cls)
    parts = max(PARTS, -(-rest.count() // PART_ROWS))
    rest = rest.withColumn("part", F.pmod(F.xxhash64("row_key", "start"), F.lit(parts)).cast("int"))
    counts = rest.groupBy("cls", "part").agg(F.count("*").alias("n"))
    demand = np.zeros(cap, np.int64)
    for r in counts.groupBy("cls").agg(F.sum("n").alias("n")).collect():  # size / grain rows
        demand[r.cls - 1] = r.n
    # A place: pattern instance i (0..n-1) of the pattern holds `per` pieces of the class at `at`.
    places: dict[int, list[tuple]] = {c: [] for c in range(1, cap)}
    first, seen = 0, np.zeros(cap, np.int64)
    for pattern, n in integral_patterns(demand, cap):
        at = 0
        for c in np.flatnonzero(pattern)[::-1].tolist():
            per = int(pattern[c])
            places[c + 1].append((int(seen[c]), int(seen[c]) + per * n, per, first, at))
            seen[c] += per * n
            at += per * (c + 1) * grain
        first += n
    struct = "array<struct<lo: long, hi: long, per: long, seq: long, at: long>>"
    place_rows = spark.createDataFrame(list(places.items()), f"cls int, places {struct}")
    bases = counts.withColumn("base", F.sum("n").over(Window.partitionBy("cls").orderBy("part")) - F.col("n")).drop("n")
    in_part = Window.partitionBy("cls", "part").orderBy("row_key", "start")
    ranked = (
        rest.withColumn("nth", F.row_number().over(in_part) - 1)
        .join(bases.hint("merge"), ["cls", "part"])
        .withColumn("rank", F.col("nth") + F.col("base"))
        .join(F.broadcast(place_rows), "cls")
        .withColumn("p", F.filter("places", lambda p: (p["lo"] <= F.col("rank")) & (F.col("rank") < p["hi"]))[0])
    )
    inside = F.col("rank") - F.col("p.lo")
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    placed = ranked.select(
        *columns, (F.col("p.seq") + F.expr("(rank - p.lo) div p.per")).alias("sequence_id"),
        (F.col("p.at") + (inside % F.col("p.per")) * F.col("cls") * grain).alias("slot"),
    )
    # Close the gaps that rounding up left, so offsets are gapless.
    w = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0))).drop("slot")
    alone = full.select(*columns, (F.monotonically_increasing_id() + first).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(alone)
