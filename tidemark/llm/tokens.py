"""Token counts of whole documents with the public tokenizer libraries (operator 2).

A document of more than ``COUNT_CHUNK`` characters is encoded in overlapping chunks with offsets. A chunk
begins where its predecessor has a token, and the two are spliced at the first place behind the
cut where both have the same token at the same offsets and

* both begin a piece of the pre-tokenizer there: it reads from left to right, so what follows is
  equal; or
* both are inside the same piece, and ``AGREE`` tokens agree: a sequence of byte-pair tokens is
  the encoding of a piece exactly if each two neighbours are the encoding of their own text, so a
  common token joins a left part and a right part of a piece.

Places near a cut don't count (``MARGIN``), so composed characters and special strings stay whole.
If there is no such place, the overlap is doubled; if it reaches the last piece that is known to
begin one, that piece is encoded whole. Every character is encoded about once, text without
spaces included.

Shorter documents need less: if the tokenizer's own definition says that it drops white space,
a text cut at spaces and line feeds encodes to the concatenation of its words. Words recur, so
each task keeps a bounded memo from word to ids; only unseen words reach the library, in batches.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import with_text

#: Words longer than this many characters are not kept in a memo.
MEMO_WORD = 64
#: Entries of a task's memo; it is emptied when full, so memory is bounded.
MEMO_SIZE = 300_000
#: Characters of a chunk of a long document and of its first overlap with the next one, for ids and for counts.
CHUNK, OVERLAP = 65_536, 256
COUNT_CHUNK = 16_384
#: Characters beside a cut whose tokens prove nothing, and tokens that must agree inside a piece.
MARGIN, AGREE = 32, 4
#: Characters of texts that are split into words at a time (one text, if it is longer).
SLICE = 2_000_000


def load(path: str):
    """The tokenizer of a ``.json`` file, without truncation or padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _byte_level() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies (a fixed public rule)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


#: The pieces of a pre-tokenizer that drops white space, and the normalizers that go with it.
SPACELESS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = ("NFC", "Replace", "Lowercase")


def by_words(path: str) -> bool:
    """Whether the tokenizer of a ``.json`` file encodes a text to the concatenation of its words' ids.

    Read from the definition: pieces of :data:`SPACELESS` without the rest, white space to spaces,
    lower case by character, NFC, and byte-pair merges inside a piece.
    """
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    norm, pre = d.get("normalizer") or {}, d.get("pre_tokenizer") or {}
    steps, cuts = norm.get("normalizers", []), pre.get("pretokenizers", [])
    return (
        tuple(x["type"] for x in steps) == NORMAL
        and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
        and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["pattern"] == {"Regex": SPACELESS} and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
        and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
        and d["model"]["type"] == "BPE" and not d["model"].get("dropout") and not d.get("post_processor")
        and not any(set(t["content"]) & set(" \n") for t in d["added_tokens"])
    )


#: Words of these letters are one piece to the tokenizer, and neither NFC nor lower-casing depends
#: on their neighbours; a run of these marks behind them is a piece of its own.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)")


class WordEncoder:
    """Encodes texts word by word; ids are little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, size: int = MEMO_SIZE):
        self.tokenizer, self.size = load(path), size
        self.memo: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {"": b""}
        self.table = _byte_level()
        self.direct = by_words(path)

    def _model(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.table)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(piece)]).tobytes()

    def _plain(self, word: str) -> bytes | None:
        m = PLAIN.fullmatch(word)
        if not m:
            return None
        out = b""
        for piece in (m[1].lower(), m[2]):
            got = self.pieces.get(piece)
            if got is None:
                if len(self.pieces) >= self.size:
                    self.pieces.clear()
                got = self._model(piece)
                if len(piece) <= MEMO_WORD:
                    self.pieces[piece] = got
            out += got
        return out

    def _library(self, words: list[str]) -> dict[str, bytes]:
        got = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return {w: array("I", e.ids).tobytes() for w, e in zip(words, got, strict=True)}

    def encode_many(self, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[bytes]:
        """The ids of each text; those of more than ``chunk`` characters go through :func:`encode_chunked`.

        Words are held for about ``SLICE`` characters at a time, not the whole batch.
        """
        out: list[bytes] = []
        part: list[str] = []
        held = 0
        for t in [*texts, None]:
            if t is None or len(t) > chunk or (part and held + len(t) > SLICE):
                if part:
                    out += self._encode(part)
                part, held = [], 0
            if t is not None and len(t) > chunk:
                out.append(encode_chunked(self.tokenizer, t, chunk, overlap).tobytes())
            elif t is not None:
                part.append(t)
                held += len(t)
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; unseen words go to the library together."""
        if not self.direct:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        split = [t.replace("\n", " ").split(" ") for t in texts]
        unseen = set().union(*split).difference(self.memo)
        if unseen:
            new, rest = {}, []
            for w in unseen:
                got = self._plain(w)
                if got is None:
                    rest.append(w)
                else:
                    new[w] = got
            if rest:
                new |= self._library(rest)
            if len(self.memo) + len(new) > self.size:  # keep what this batch needs, begin anew
                memo = self.memo
                self.memo = {w: memo[w] for w in set().union(*split).difference(unseen)}
            self.memo |= new
        get = self.memo.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        if unseen:
            for w in [w for w in rest if len(w) > MEMO_WORD]:
                del self.memo[w]
            for w in [w for w in unseen if len(w) > MEMO_WORD and w in self.memo]:
                del self.memo[w]
        return out


class Tokens:
    """Tokens of a stretch of a text: ids, offsets in the whole text, and the pieces they lie in."""

    def __init__(self, tokenizer, text: str, start: int, stop: int):
        e = tokenizer.encode(text[start:stop], add_special_tokens=False)
        self.stop, self.ids = stop, array("I", e.ids)
        self.begin = array("q", (a + start for a, _ in e.offsets))
        self.end = array("q", (b + start for _, b in e.offsets))
        self.word = e.word_ids

    def __len__(self) -> int:
        return len(self.ids)

    def at(self, k: int) -> tuple[int, int, int]:
        return self.begin[k], self.end[k], self.ids[k]

    def begins_piece(self, k: int) -> bool:
        return k == 0 or self.word[k - 1] != self.word[k]

    def clean(self, k: int) -> bool:
        """Whether a character begins with token k (bytes of one character can be several tokens)."""
        return k == 0 or self.end[k - 1] <= self.begin[k]

    def piece(self, k: int) -> tuple[int, int]:
        """Offsets of the piece of token k."""
        lo = hi = k
        while lo and self.word[lo - 1] == self.word[k]:
            lo -= 1
        while hi + 1 < len(self) and self.word[hi + 1] == self.word[k]:
            hi += 1
        return self.begin[lo], self.end[hi]


def splice_point(left: Tokens, right: Tokens, start: int) -> tuple[int, int, bool] | None:
    """Token numbers from which ``right`` (of the text from ``start``) continues ``left``, and whether a piece begins there."""
    lo = start + MARGIN if start else 0
    j = bisect_left(right.begin, lo)
    k = bisect_left(left.begin, lo)
    last = left.stop - MARGIN
    same: tuple[int, int] | None = None  # pieces already known to be the same one
    while j < len(right) and k < len(left) and max(left.end[k], right.end[j]) <= last:
        a, b = left.begin[k], right.begin[j]
        if a != b:
            j, k = (j + 1, k) if b < a else (j, k + 1)
            continue
        if left.at(k) == right.at(j) and left.clean(k) and right.clean(j):
            if left.begins_piece(k) and right.begins_piece(j) and k and j:
                return k, j, True
            if j + AGREE <= len(right) and k + AGREE <= len(left) and all(left.at(k + i) == right.at(j + i) for i in range(AGREE)):
                if same != (left.word[k], right.word[j]):
                    (la, lb), (ra, rb) = left.piece(k), right.piece(j)
                    # one run of both: it began before the cut and goes on behind the end of the left chunk, or ends alike
                    same = (left.word[k], right.word[j]) if la <= ra and (lb == rb or lb >= last) else None
                if same:
                    return k, j, False
        j, k = j + 1, k + 1
    return None


def encode_chunked(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> array:
    """Ids of a long text from overlapping chunks, spliced at proven common boundaries."""
    n = len(text)
    done = array("I")
    anchor, kept = 0, 0  # the last place known to begin a piece, and how many ids lie before it
    cur, base = Tokens(tokenizer, text, 0, min(n, chunk)), 0  # tokens of cur from base on are still open
    while cur.stop < n:
        end, width = cur.stop, max(overlap, 4 * MARGIN)
        if base == len(cur) and end - MARGIN > anchor:  # white space alone is open
            anchor, kept = end - MARGIN, len(done)
        while True:
            stop = min(n, end + max(chunk, width))
            k = len(cur) - 1
            while k > base and (cur.begin[k] > end - width or not cur.clean(k) or unicodedata.combining(text[cur.begin[k]])):
                k -= 1
            if k <= base:  # nothing left to widen: the open piece is encoded whole
                done = done[:kept]
                cur, base = Tokens(tokenizer, text, anchor, stop), 0
                break
            start = cur.begin[k]
            nxt = Tokens(tokenizer, text, start, stop)
            if at := splice_point(cur, nxt, start):
                piece = next((i for i in range(at[0], base, -1) if cur.begins_piece(i)), None)
                if piece is not None:  # the open part begins no earlier than here
                    anchor, kept = cur.begin[piece], len(done) + piece - base
                done += cur.ids[base : at[0]]
                cur, base = nxt, at[1]
                break
            width *= 2
    return done + cur.ids[base:]


def count_tokens(
    docs: DataFrame, path: str, limit: int = 2048, chunk: int = COUNT_CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """One row a document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty (0 bytes, 0 tokens); a null doc_id stays null. Repeated rows and
    equal doc_ids give a row each; an empty table gives none; other columns play no part. Documents
    of more than ``chunk`` characters go through :func:`encode_chunked`, in time linear in their
    length. There is no shuffle: every task encodes its own rows, and memory is bounded by a row, a
    batch and the memo. ``path`` must exist on every executor.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = WordEncoder(path)
        for pdf in batches:
            n = [len(b) // 4 for b in enc.encode_many(pdf["text"].tolist(), chunk, overlap)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": pdf["n_bytes"], "n_tokens": n})

    # ids travel as strings: pandas would turn nullable longs into doubles
    src = with_text(docs, F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_bytes"))
    src = src.withColumn("doc_id", F.col("doc_id").cast("string"))
    out = src.mapInPandas(run, "doc_id string, n_bytes long, n_tokens long")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
