"""Prefix polynomial hashes of whole texts (operator 1).

For code points c_0..c_{n-1} and a prime p the prefix array is H[i] = sum_{j<i} c_j * B^j mod p.
The span [a, b) then has the shift-free value (H[b] - H[a]) * B^(-a) mod p, so any two spans
compare in constant time and a longest common extension is a binary search over its length. Two
primes near 2^31 are used side by side (62 bits).

The fingerprint of a text is the hash of the whole text and its length, followed by a sketch of
all windows of ``WINDOW`` code points, whose span values come from the same prefix arrays: each
window falls into one of ``SLOTS`` slots, each slot keeps the least value. The likeness of two
fingerprints is the share of equal slots (equal texts: 1).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, shuffle_width, with_text

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003, 998_244_353)
WINDOW, SLOTS = 16, 64


class PrefixHasher:
    """Prefix arrays of texts; powers of the bases are kept and grow with the longest text."""

    def __init__(self) -> None:
        self.powers = [np.ones(1, np.uint64) for _ in PRIMES]
        self.inverses = [np.ones(1, np.uint64) for _ in PRIMES]

    def grow(self, n: int) -> None:
        while len(self.powers[0]) <= n:
            for k, p in enumerate(PRIMES):
                for table, base in ((self.powers, BASES[k]), (self.inverses, pow(BASES[k], -1, p))):
                    step = np.uint64(pow(base, len(table[k]), p))
                    table[k] = np.concatenate([table[k], table[k] * step % np.uint64(p)])

    def prefixes(self, codes: np.ndarray) -> list[np.ndarray]:
        n = len(codes)
        self.grow(n)
        out = []
        for k, p in enumerate(PRIMES):
            terms = (codes.astype(np.uint64) + np.uint64(1)) * self.powers[k][:n] % np.uint64(p)
            out.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms) % np.uint64(p)]))
        return out

    def spans(self, h: list[np.ndarray], starts: np.ndarray, length: int) -> np.ndarray:
        """Shift-free 62-bit values of the spans [s, s + length), comparable across texts."""
        out = None
        for k, p in enumerate(PRIMES):
            q = np.uint64(p)
            v = (h[k][starts + length] + q - h[k][starts]) % q * self.inverses[k][starts] % q
            out = v if out is None else (out << np.uint64(31)) | v
        return out

    def equal(self, x: list[np.ndarray], a: int, y: list[np.ndarray], b: int, length: int) -> bool:
        return bool(self.spans(x, np.array([a]), length)[0] == self.spans(y, np.array([b]), length)[0])

    def common(self, x: list[np.ndarray], a: int, y: list[np.ndarray], b: int) -> int:
        """Length of the longest common extension to the right of position a of x and b of y."""
        lo, hi = 0, min(len(x[0]) - a, len(y[0]) - b) - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.equal(x, a, y, b, mid) else (lo, mid - 1)
        return lo

    def sketch(self, h: list[np.ndarray]) -> tuple[str, np.ndarray]:
        """The fingerprint and its slots."""
        n = len(h[0]) - 1
        whole = (int(h[0][n]) << 31 | int(h[1][n])) & (2**62 - 1)
        slots = np.full(SLOTS, 255, np.uint64)
        if n:
            w = min(WINDOW, n)
            starts = np.arange(n - w + 1)
            v = self.spans(h, starts, w)
            v ^= v >> np.uint64(33)
            v *= np.uint64(0xFF51AFD7ED558CCD)
            v ^= v >> np.uint64(29)
            slot = (v & np.uint64(SLOTS - 1)).astype(np.int64)
            value = v >> np.uint64(6)
            least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
            np.minimum.at(least, slot, value)
            filled = np.flatnonzero(least != np.iinfo(np.uint64).max)
            # an empty slot takes the next filled one, so short texts compare as well
            source = filled[np.searchsorted(filled, np.arange(SLOTS)) % len(filled)]
            slots = (least[source] >> np.uint64(11)) & np.uint64(255)
        return f"{n:x}-{whole:016x}-{slots.astype(np.uint8).tobytes().hex()}", slots

def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def likeness(a: tuple[str, np.ndarray], b: tuple[str, np.ndarray]) -> float:
    return 1.0 if a[0] == b[0] else float(np.mean(a[1] == b[1]))


def edited(text: str, following: str) -> str:
    """The last floor(n / 4) code points replaced by the first as many (or all) of ``following``."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


COLUMNS = (
    "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, common_prefix long"
)


def _row(hasher: PrefixHasher, doc_id, text: str, nxt: str, own, after) -> tuple:
    """own, after: (prefix arrays, sketch) of the text and of the next document."""
    changed = edited(text, nxt)
    h = hasher.prefixes(code_points(changed))
    e = hasher.sketch(h)
    return (
        doc_id,
        len(text),
        hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
        own[1][0],
        e[0],
        likeness(own[1], e),
        likeness(own[1], after[1]),
        hasher.common(own[0], 0, h, 0),
    )


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose tail comes from the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, common_prefix (longest common extension of text and edited text from 0). Order:
    doc_id ascending, nulls first, equal ids by text hash and text; after the last comes the
    first (a lone document follows itself). Null texts are empty; repeated rows give a row each; an
    empty table gives none; other columns play no part. A text of n code points needs about 100 n
    bytes in its task, whole: two texts and their prefix arrays are held at a time.

    Plan: one range shuffle of (doc_id, text); each sorted partition is one streaming pass. A
    partition's last document needs the first one of the next partition that has rows: only
    these two texts a partition are set aside and joined by partition number.
    """
    spark = docs.sparkSession
    width = shuffle_width(spark)
    sorted_docs = (
        with_text(docs)
        .withColumn("h", F.xxhash64("text"))
        .repartitionByRange(width, "doc_id", "h")
        .sortWithinPartitions("doc_id", "h", "text")
        .select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # a string: pandas would turn a nullable long into a double
    )
    edge = "part int, side string, edge_text string"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        hasher, held = PrefixHasher(), None
        blank = (None, None, None)
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                h = hasher.prefixes(code_points(text))
                own = (h, hasher.sketch(h))
                if held is None:
                    out.append((None,) * 8 + (part, "first", text))
                else:
                    out.append(_row(hasher, held[0], held[1], text, held[2], own) + blank)
                held = (doc_id, text, own)
            yield _frame(out)
        if held is not None:
            yield _frame([(held[0],) + (None,) * 7 + (part, "last", held[1])])

    names = [c.split()[0] for c in f"{COLUMNS}, {edge}".split(", ")]

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        df = pd.DataFrame(rows, columns=names)
        return df.astype({"n_chars": "Int64", "common_prefix": "Int64", "part": "Int32"})

    digest = materialize(sorted_docs.mapInPandas(scan, f"{COLUMNS}, {edge}"), "op1-digest", waves=0)
    first = digest.where("side = 'first'").select(F.col("part").alias("next_part"), F.col("edge_text").alias("next_text"))
    last = digest.where("side = 'last'").select("part", "doc_id", "edge_text")
    # Partition numbers only: one row a partition, the next one that has rows, round to the first.
    parts = digest.where("side = 'first'").select("part").withColumn("one", F.lit(1))
    w = Window.partitionBy("one").orderBy("part")
    follow = parts.select(
        "part", F.coalesce(F.lead("part").over(w), F.first("part").over(w)).alias("next_part")
    )

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = PrefixHasher()
        for pdf in batches:
            out = []
            for doc_id, text, nxt in zip(pdf["doc_id"].tolist(), pdf["edge_text"], pdf["next_text"], strict=True):
                h, g = hasher.prefixes(code_points(text)), hasher.prefixes(code_points(nxt))
                out.append(_row(hasher, doc_id, text, nxt, (h, hasher.sketch(h)), (g, hasher.sketch(g))))
            df = pd.DataFrame(out, columns=names[:8])
            yield df.astype({"n_chars": "Int64", "common_prefix": "Int64"})

    ends = (
        last.join(follow.hint("shuffle_hash"), "part")
        .join(first.hint("shuffle_hash"), "next_part")
        .select("doc_id", "edge_text", "next_text")
        .mapInPandas(close, COLUMNS)
    )
    out = digest.where("side is null").select(*names[:8]).unionByName(ends)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
