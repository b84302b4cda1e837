"""Repair of conversation structure by a grammar-compressed dynamic program (operator 11).

A row is one symbol: the initial of its role and its fault. Re-Pair rules over all sequences of
symbols carry one min-plus matrix each, between the four states of the role grammar ``(s?(ua)+)?``,
with the cheapest edits as a rope; matrices are computed once, bottom-up, and shared by all conversations.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import materialize, shuffle_width

RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States of the role grammar by the last initial: none yet, s, u, a. A conversation may end in the first or last.
NONE, S, U, A = range(4)
FINAL = (NONE, A)
NEXT = {(NONE, "s"): S, (NONE, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
ROLES = {U: "user", A: "assistant"}
#: Kinds of symbols: initials and faults. The symbol of both is a letter.
INITIALS, FAULTS = "sua-", ("", "truncated", "blank", "duplicate")
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
#: Rows of a conversation in one block of its sequence.
BLOCK = 4096
WORD_CHARACTER = r"[^\x20\x09-\x0D]"


def symbol(initial: str, fault: str) -> str:
    return chr(ord("A") + len(FAULTS) * INITIALS.index(initial) + FAULTS.index(fault))


# -- min-plus matrices ---------------------------------------------------------------------------


@dataclass(eq=False)
class Rope:
    """Edits of a rule: those of its two parts, joined when they are asked for."""

    left: Rope | str
    right: Rope | str
    joined: str | None = None

    def __str__(self) -> str:
        if self.joined is None:
            self.joined = str(self.left) + str(self.right)
        return self.joined


#: A matrix: for each pair of states the cost and edits of the cheapest way, ties ASCII-least, if there is any.
Matrix = dict[tuple[int, int], tuple[int, Rope | str]]


@dataclass
class Rule:
    """What a symbol says about the rows it stands for."""

    ways: Matrix
    size: int
    first: str
    last: str
    faults: Counter = field(default_factory=Counter)
    illegal: int = 0


def _least(a, b):
    if b is None or a[0] != b[0]:
        return a if b is None or a[0] < b[0] else b
    return a if str(a[1]) < str(b[1]) else b


def _inserts() -> Matrix:
    """The fewest insertions between states: the role to insert follows from the state."""
    out: Matrix = {(i, i): (0, "") for i in range(4)}
    for i in range(4):
        at, n = i, 0
        while n < 2:
            at, n = (A if at == U else U), n + 1
            if (i, at) not in out:
                out[i, at] = (INSERT * n, "I" * n)
    return out


def base_rule(initial: str, fault: str) -> Rule:
    """One row: insertions before it, then Keep, Rerole or Delete. Blank and repeated rows are deleted."""
    row: Matrix = {}
    for i in range(4):
        row[i, i] = (DELETE, "D")
        if fault in ("", "truncated"):
            extra = TRUNCATED if fault else 0
            for c in "ua":
                if (i, c) in NEXT:
                    row[i, NEXT[i, c]] = (RELABEL + extra, "R")
            if (i, initial) in NEXT:
                row[i, NEXT[i, initial]] = (extra, "K")
    return Rule(product(_inserts(), row), 1, initial, initial, Counter({fault: 1}) if fault else Counter())


def product(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product. Edits of one start and the same rows never begin one another, so comparing
    whole ropes is right however they are split."""
    out: Matrix = {}
    for (i, k), (c, x) in a.items():
        for (k2, j), (d, y) in b.items():
            if k2 == k:
                out[i, j] = _least((c + d, Rope(x, y)), out.get((i, j)))
    return out


def joined(a: Rule, b: Rule) -> Rule:
    bad = a.illegal + b.illegal + ((a.last, b.first) not in LEGAL)
    return Rule(product(a.ways, b.ways), a.size + b.size, a.first, b.last, a.faults + b.faults, bad)


def rule_table(pairs: list[tuple[str, str]]) -> dict[str, Rule]:
    """The rules of all symbols, bottom-up: ``pairs`` has (two symbols, new symbol) in order of their making."""
    rules = {symbol(i, f): base_rule(i, f) for i in INITIALS for f in FAULTS}
    for two, new in pairs:
        rules[new] = joined(rules[two[0]], rules[two[1]])
    for r in rules.values():
        r.ways = {k: (c, str(x)) for k, (c, x) in r.ways.items()}
    return rules


def repair(blocks: list[str], rules: dict[str, Rule]) -> dict:
    """The cheapest repair of a conversation whose (compressed) sequence is given in blocks.

    A state's edits so far are ordered by rank: those of different states never begin one another, so
    their order decides all ties later on. After a block, only the edits inside it are kept, by state.
    """
    best = {NONE: (0, 0)}  # state: cost, rank
    history, faults, illegal, last = [], Counter(), 0, None
    for block in blocks:
        trail = {i: (i, None) for i in best}  # state: state at the block's start, edits as (before, edits)
        for s in block:
            rule = rules[s]
            faults.update(rule.faults)
            illegal += rule.illegal + (last is not None and (last, rule.first) not in LEGAL)
            last = rule.last
            found: dict[int, tuple] = {}
            for (i, j), (c, x) in rule.ways.items():
                if i in best:
                    cost, rank = best[i]
                    way = (cost + c, rank, x, i)
                    if j not in found or way < found[j]:
                        found[j] = way
            order = sorted(found, key=lambda j: found[j][1:3])
            best, trail = (
                {j: (found[j][0], n) for n, j in enumerate(order)},
                {j: (trail[found[j][3]][0], (trail[found[j][3]][1], found[j][2])) for j in order},
            )
        flat = {}
        for j, (start, edits) in trail.items():
            parts = []
            while edits:
                edits, x = edits
                parts.append(x)
            flat[j] = (start, "".join(reversed(parts)))
        history.append(flat)
    ends = []
    for (i, j), (c, x) in _inserts().items():
        if i in best and j in FINAL:
            ends.append((best[i][0] + c, best[i][1], x, i))
    cost, _, tail, state = min(ends)
    out = [tail]
    for flat in reversed(history):
        state, edits = flat[state]
        out.append(edits)
    return {"cost": cost, "audit": "".join(reversed(out)), "illegal": illegal} | {f: faults[f] for f in FAULTS[1:]}


# -- rows and sequences --------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32 of ``conv_id:turn`` (nulls: one space) modulo 20.

    0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 has the row twice, 4 makes it a user's.
    """
    def text_of(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def _plain(rows: DataFrame) -> DataFrame:
    """The four columns, without nulls in role and text, and the hash by which texts of a turn and role are ordered."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text")).withColumn(
        "digest", F.unhex(F.sha2("text", 256))
    )


ORDER = ("conv_id", "turn", "role", "digest")


def turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, n (equal rows), initial, fault of the first of them, again (fault of the others).

    A row is a duplicate if its conversation has role and text in an earlier turn, or earlier in
    the same turn. Equal rows are counted before the shuffle, and first turns by a minimum, so
    neither a copied row nor a text that fills a conversation gathers anywhere.
    """
    stripped = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    fault = F.when(stripped == "", "blank").when(~F.right(stripped, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    first = F.substring("role", 1, 1)
    initial = F.when(first.isin("s", "u", "a"), first).otherwise("-")
    slim = _plain(rows).select(*ORDER, initial.alias("initial"), fault.alias("fault")).groupBy(*ORDER, "initial", "fault").agg(F.count("*").alias("n"))
    earliest = slim.where("fault <> 'blank'").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("t"))
    e = earliest.select(*[F.col(c).alias(f"e_{c}") for c in ("conv_id", "role", "digest")], F.col("t.turn").alias("e_turn")).hint("merge")
    met = slim.join(e, [F.col(c).eqNullSafe(F.col(f"e_{c}")) for c in ORDER], "left")
    again = F.when(F.col("fault") == "blank", "blank").otherwise("duplicate")
    is_first = F.col("e_digest").isNotNull() | (F.col("fault") == "blank")
    return met.select(*ORDER, "n", "initial", F.when(is_first, F.col("fault")).otherwise("duplicate").alias("fault"), again.alias("again"))


def sequences(rows: DataFrame) -> DataFrame:
    """conv_id, part, block, symbols, n_turns, first_turn, last_turn: blocks of a conversation's rows in order.

    Rows are dealt by ranges of (conv_id, turn, ...), so a conversation of any length spreads over tasks,
    which read them sorted, as a stream.
    """
    spark = rows.sparkSession
    t = materialize(turns(rows), "op11-turns", waves=16)
    schema = StructType([t.schema["conv_id"]]).simpleString()[len("struct<"):-1]
    dealt = t.repartitionByRange(max(shuffle_width(spark), spark.sparkContext.defaultParallelism), *ORDER).sortWithinPartitions(*ORDER).withColumn("part", F.spark_partition_id())
    letters = {(i, f): symbol(i, f) for i in INITIALS for f in FAULTS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        ready: list[tuple] = []
        conv, part, block, symbols, n, first, last, size = None, None, 0, [], 0, None, None, 0

        def flush():
            nonlocal symbols, n, first, last, size
            if size:
                ready.append((conv, part, block, "".join(symbols), n, first, last))
            symbols, n, first, last, size = [], 0, None, None, 0

        def batch():
            out = pa.RecordBatch.from_arrays(
                [pa.array(x, y) for x, y in zip(zip(*ready, strict=True), (kind, pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                ["conv_id", "part", "block", "symbols", "n_turns", "first_turn", "last_turn"],
            )
            ready.clear()
            return out

        for b in batches:
            kind = b.column("conv_id").type
            for c, turn, copies, initial, fault, again, p in zip(*(b.column(x).to_pylist() for x in ("conv_id", "turn", "n", "initial", "fault", "again", "part")), strict=True):
                if part is None or c != conv:
                    flush()
                    conv, part, block = c, p, 0
                todo, now = copies, letters[initial, fault]
                while todo:
                    if size >= BLOCK:
                        flush()
                        block += 1
                        if len(ready) >= 256:
                            yield batch()
                    if turn is not None and turn != last:
                        n, first, last = n + 1, turn if first is None else first, turn
                    take = 1 if todo == copies else min(todo, BLOCK - size)
                    symbols.append(now * take)
                    size, todo, now = size + take, todo - take, letters[initial, again]
            if ready:
                yield batch()
        flush()
        if ready:
            yield batch()

    return dealt.mapInArrow(run, f"{schema}, part int, block long, symbols string, n_turns long, first_turn long, last_turn long")


def compress(text: str, pairs: list[tuple[str, str]]) -> str:
    for two, new in pairs:
        text = text.replace(two, new)
    return text


def learn_pairs(blocks: DataFrame, rounds: int = 8, longest: int = 512) -> list[tuple[str, str]]:
    """Re-Pair over all blocks: each round replaces the most frequent pairs that share no symbol by new ones.

    The pairs are counted by a job over the distinct blocks; the driver sees the 64 most frequent. Rules stand for ``longest``
    rows at most, which bounds their ropes. Rules only shorten the work: any choice of them gives the same repairs.
    """
    distinct = materialize(blocks.groupBy("symbols").agg(F.count("*").alias("n")), "op11-blocks")
    pairs: list[tuple[str, str]] = []
    sizes = {symbol(i, f): 1 for i in INITIALS for f in FAULTS}
    for _ in range(rounds):
        known = list(pairs)

        def count(batches: Iterator[pd.DataFrame], known=known) -> Iterator[pd.DataFrame]:
            total: Counter = Counter()
            for b in batches:
                for text, n in zip(b["symbols"], b["n"], strict=True):
                    text, before = compress(text, known), None
                    for two in map("".join, pairwise(text)):
                        before = None if two == before and two[0] == two[1] else two  # of three equal symbols, one pair
                        if before:
                            total[two] += int(n)
            yield pd.DataFrame({"two": list(total), "n": list(total.values())}).astype({"two": "object", "n": "int64"})

        top = distinct.mapInPandas(count, "two string, n long").groupBy("two").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "two").limit(64).collect()
        used: set[str] = set()
        for r in top:
            if r.n > 1 and not used & set(r.two) and sizes[r.two[0]] + sizes[r.two[1]] <= longest:
                new = chr(0x100 + len(pairs))
                pairs.append((r.two, new))
                sizes[new] = sizes[r.two[0]] + sizes[r.two[1]]
                used |= set(r.two)
        if not used:
            break
    return pairs


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def repairs(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: one row a conversation.

    ``conversations`` may name more conversations, without rows. A conversation's compressed
    sequence, with its blocks, is shorter than the audit it gets, and meets in one row like it.
    """
    blocks = materialize(sequences(rows), "op11-sequences", waves=16)
    pairs = learn_pairs(blocks)
    item = F.struct("part", "block", "symbols", "n_turns", "first_turn", "last_turn")
    own = blocks.select("conv_id", item.alias("b"))
    if conversations is not None:
        own = own.unionByName(conversations.select("conv_id").distinct().withColumn("b", F.lit(None).cast(own.schema["b"].dataType)))
    grouped = own.groupBy("conv_id").agg(F.array_sort(F.collect_list("b")).alias("blocks"))
    key = StructType([grouped.schema["conv_id"]]).simpleString()[len("struct<"):-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, memo = rule_table(pairs), {}
        for batch in batches:
            out = []
            for found in batch.column("blocks").to_pylist():
                texts = [b["symbols"] for b in found]
                short = texts[0] if len(texts) == 1 and len(texts[0]) <= 64 else None
                r = memo.get(short) if short else None
                if r is None:
                    r = repair([compress(x, pairs) for x in texts], rules)
                    if short and len(memo) < 100_000:
                        memo[short] = r
                dated = [b for b in found if b["n_turns"]]
                n = sum(b["n_turns"] for b in dated) - sum(x["last_turn"] == y["first_turn"] for x, y in pairwise(dated))
                gaps = dated[-1]["last_turn"] - dated[0]["first_turn"] + 1 - n if dated else 0
                out.append((gaps, r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"]))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64()] * 6 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))],
                ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"],
            )

    return grouped.mapInArrow(run, f"{key}, {REPORT}")


class Editor:
    """Applies a conversation's edits to its rows, which come in order, one at a time."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, NONE

    def _write(self, edit: str, role: str, text: str) -> tuple[str, str, str]:
        if edit == "K":
            self.state = NEXT[self.state, role[:1]]
            return edit, role, text
        self.state = A if self.state == U else U
        return edit, ROLES[self.state], text

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._write("I", "", "")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._write(edit, role, text)


def _edited(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of each conversation, in order, after one row with its report; a conversation in one task.

    Only sorting needs that: tasks stream. A digest of a whole conversation can't be cut into parts.
    """
    report = F.struct(*[c for c in found.columns if c != "conv_id"]).alias("report")
    heads = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("string").alias("text"), report)
    body = _plain(rows).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text", F.lit(None).cast(heads.schema["report"].dataType).alias("report"))
    return heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest").select("conv_id", "kind", "role", "text", "report")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, report, None) where a conversation begins, (conv_id, None, (edit, role, text)) for its rows."""
    editor, conv = None, None
    for b in batches:
        for c, kind, role, text, report in zip(*(b.column(x).to_pylist() for x in ("conv_id", "kind", "role", "text", "report")), strict=True):
            if kind == 0:
                if editor:
                    yield from ((conv, None, x) for x in editor.inserted())
                editor, conv = Editor(report["audit"]), c
                yield conv, report, None
            else:
                yield from ((conv, None, x) for x in editor.row(role, text))
    if editor:
        yield from ((conv, None, x) for x in editor.inserted())


def repaired_rows(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """conv_id, position, edit (K, R or I), role, text: the rows of every repaired conversation."""
    found = materialize(repairs(rows, conversations), "op11-repairs", waves=16)
    stream = _edited(rows, found)
    key, kind = StructType([found.schema["conv_id"]]).simpleString()[len("struct<"):-1], found.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        names, kinds, out, n = ["conv_id", "position", "edit", "role", "text"], [to_arrow_type(kind), pa.int64(), pa.string(), pa.string(), pa.string()], [], 0
        for conv, report, row in _stream(batches):
            n = 0 if report else n + 1
            if row:
                out.append((conv, n, *row))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return stream.mapInArrow(run, f"{key}, position long, edit string, role string, text string")


def repair_report(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row a conversation: faults, cost and edits of its cheapest repair, and the digest of what it gives.

    ``rows`` has conv_id, turn, role, text; ``conversations`` may name conversations without any row: zeros,
    empty audit, digest of the empty string. Rows go by turn (nulls first), then role, then a hash of the text.
    A row's first fault counts: blank, duplicate (role and text seen earlier), truncated (doesn't end
    in ``.!?``). The repaired roles' initials form ``(s?(ua)+)?``; edits: Keep 0, Rerole to user or assistant 3,
    Delete 4 (always, of blank and repeated rows), Insert 3; a truncated row that stays adds 3. Of the
    cheapest edits, those with the ASCII-least initials.

    A null conv_id is a conversation of its own; a null role or text counts as one space; any other
    initial than s, u, a must be edited; an empty table gives no rows; other columns aren't read.
    """
    found = materialize(repairs(rows, conversations), "op11-repairs", waves=16)
    stream = _edited(rows, found)
    key, kind = StructType([found.schema["conv_id"]]).simpleString()[len("struct<"):-1], found.schema["conv_id"].dataType
    names = [c for c in found.columns if c != "conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds, out, hashed, current = [to_arrow_type(kind), *[pa.int64()] * 6, pa.string(), pa.string()], [], None, None

        def close():
            if current is not None:
                out.append((*current, (hashed or hashlib.sha256()).hexdigest()))

        def batch():
            done = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", *names, "repaired_sha256"])
            out.clear()
            return done

        for conv, report, row in _stream(batches):
            if report:
                close()
                if len(out) >= 1000:
                    yield batch()
                current, hashed = (conv, *(report[c] for c in names)), None
            else:
                line = f"{row[1]}:{row[2]}".encode("utf-8", "surrogatepass")
                if hashed is None:
                    hashed = hashlib.sha256(line)
                else:
                    hashed.update(b"\n")
                    hashed.update(line)
        close()
        if out:
            yield batch()

    return stream.mapInArrow(run, f"{key}, {REPORT}, repaired_sha256 string")


#: The rows of ``repair_report`` over damaged conversations, in DuckDB SQL: the same program row by row.
SQL = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT))),
      lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)), lambda v, j: xor(v >> 1, (v & 1) * 3988292384))) AS h
  FROM (SELECT *, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations)),
d AS (SELECT *, xor(h, 4294967295) % 20 AS kind FROM c),
e AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE kind <> 0),
f AS (SELECT *, row_number() OVER w AS pos, left(role, 1) AS i, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut,
    lag(left(role, 1)) OVER w AS before
  FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))),
g AS (SELECT *, CASE WHEN blank THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN cut THEN 'truncated' ELSE '' END AS fault FROM f),
ins AS (SELECT * FROM (VALUES (0,0,0,''),(1,1,0,''),(2,2,0,''),(3,3,0,''),(0,2,3,'I'),(1,2,3,'I'),(2,3,3,'I'),(3,2,3,'I'),(0,3,6,'II'),(1,3,6,'II')) t(a, b, cost, edits)),
mv AS (SELECT * FROM (VALUES (0,'s',1),(0,'u',2),(1,'u',2),(2,'a',3),(3,'u',2)) t(a, i, b)),
ed AS (
  SELECT i.a, m.i AS i, m.b, i.cost, i.edits || 'K' AS edits, i.edits AS ins, 'K' AS edit FROM ins i JOIN mv m ON m.a = i.b
  UNION ALL SELECT i.a, NULL, m.b, i.cost + 3, i.edits || 'R', i.edits, 'R' FROM ins i JOIN mv m ON m.a = i.b WHERE m.i <> 's'
  UNION ALL SELECT i.a, NULL, i.b, i.cost + 4, i.edits || 'D', i.edits, 'D' FROM ins i),
added AS (SELECT a, edits, CASE WHEN edits = '' THEN '' WHEN edits = 'I' THEN CASE WHEN a = 2 THEN 'assistant:' ELSE 'user:' END || chr(10)
    ELSE 'user:' || chr(10) || 'assistant:' || chr(10) END AS t FROM ins),
dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS txt FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, pos, state, cost, audit, txt FROM (
    SELECT p.conv_id, g.pos, ed.b AS state, p.cost + ed.cost + CASE WHEN ed.edit <> 'D' AND g.fault = 'truncated' THEN 3 ELSE 0 END AS cost, p.audit || ed.edits AS audit,
      p.txt || added.t || CASE ed.edit WHEN 'D' THEN '' WHEN 'K' THEN g.role || ':' || g.text || chr(10)
        ELSE CASE ed.b WHEN 3 THEN 'assistant' ELSE 'user' END || ':' || g.text || chr(10) END AS txt
    FROM dp p JOIN g ON g.conv_id IS NOT DISTINCT FROM p.conv_id AND g.pos = p.pos + 1
      JOIN ed ON ed.a = p.state AND (ed.i IS NULL OR ed.i = g.i) AND (ed.edit = 'D' OR g.fault IN ('', 'truncated'))
      JOIN added ON added.a = p.state AND added.edits = ed.ins)
  QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
ends AS (SELECT dp.conv_id, dp.cost + ins.cost AS cost, dp.audit || ins.edits AS audit, dp.txt || added.t AS txt
  FROM dp LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id JOIN ins ON ins.a = dp.state JOIN added ON added.a = ins.a AND added.edits = ins.edits
  WHERE dp.pos = coalesce(n.n, 0) AND ins.b IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY dp.conv_id ORDER BY dp.cost + ins.cost, dp.audit || ins.edits) = 1)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, cost, audit, sha256(CASE WHEN txt = '' THEN '' ELSE left(txt, length(txt) - 1) END) AS repaired_sha256
FROM ends e LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM e.conv_id
"""
