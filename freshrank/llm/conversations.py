"""Conversation repair: turns aligned to the lengths of an alternating grammar (Wagner-Fischer, Ukkonen's bands)."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

#: What edits cost; a kept or re-roled row without its end adds CUT.
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
#: Rows that are aligned at once.
SEGMENT = 64
ROLES = {"u": b"user", "a": b"assistant"}
#: What may come after nothing, a system row, a user's and an assistant's; "s" comes first or not at all and is never made up.
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
_SPACE = " \t\n\x0b\x0c\r"
_INFINITE = 1 << 60
OUT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text, ...) -> (conv_id, turn, role, text, times): each row after its damage, and how often it stands there.

    crc32 of `conv_id:turn` modulo 20 says what happens: 0 drops the row (times 0), 1 empties its text, 2 takes its marks .!? away, 3 repeats it, 4 makes
    its role user. Nulls are one space, but conv_id and turn stay null.
    """
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(name.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), kind.alias("kind")).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("times"))


@dataclass
class Row:
    """initial: of its role; gone: it must be deleted; cut: it lacks its end."""

    initial: str
    gone: bool
    cut: bool
    role: bytes = b""
    text: bytes = b""


class Alignment:
    """The cheapest edits of rows[i:] into the last k symbols of a string that alternates u and a and ends with `last`, for all i and k.

    One matrix serves all lengths, as each target is the end of all longer ones. Ukkonen's bands: with so many rows and symbols left, their
    difference alone costs insertions or deletions; cells that cost more than the incumbent by that are left out.
    """

    def __init__(self, rows: list[Row], last: str, incumbent: int):
        self.rows, self.last, n = rows, last, len(rows)
        self.low = [max(0, n - i - incumbent // DELETE) for i in range(n + 1)]
        high = [n - i + incumbent // INSERT for i in range(n + 1)]
        self.cells: list[list[int]] = [[] for _ in range(n + 1)]
        self.cells[n] = [INSERT * k for k in range(self.low[n], high[n] + 1)]
        for i in range(n - 1, -1, -1):
            row, below, at, cells = rows[i], self.cells[i + 1], self.low[i + 1], []
            stay = _INFINITE if row.gone else CUT * row.cut
            before = _INFINITE
            for k in range(self.low[i], high[i] + 1):
                best = before + INSERT
                if 0 <= k - at < len(below):
                    best = min(best, below[k - at] + DELETE)
                if k and 0 <= k - 1 - at < len(below):
                    best = min(best, below[k - 1 - at] + stay + (0 if row.initial == self.symbol(k) else REROLE))
                cells.append(before := best)
            self.cells[i] = cells

    def symbol(self, k: int) -> str:
        return self.last if k % 2 else NEXT[self.last]

    def cost(self, i: int, k: int) -> int:
        at = k - self.low[i]
        return self.cells[i][at] if 0 <= at < len(self.cells[i]) else _INFINITE

    def audit(self, i: int, k: int) -> str:
        """The ASCII-least of the cheapest edits' initials, by going on with the least letter that stays cheapest."""
        out, n = [], len(self.rows)
        while i < n or k:
            left = self.cost(i, k)
            if i < n and self.cost(i + 1, k) + DELETE == left:
                out.append("D")
                i += 1
            elif k and self.cost(i, k - 1) + INSERT == left:
                out.append("I")
                k -= 1
            else:
                out.append("K" if self.rows[i].initial == self.symbol(k) else "R")
                i, k = i + 1, k - 1
        return "".join(out)


def _incumbent(rows: list[Row], symbol: str, last: str) -> int:
    """What it costs to keep or re-role every row that may stay, and to insert what then lacks."""
    cost, before = 0, NEXT[symbol]
    for row in rows:
        if row.gone:
            cost += DELETE
        else:
            cost += CUT * row.cut + (0 if row.initial == symbol else REROLE)
            before, symbol = symbol, NEXT[symbol]
    if all(row.gone for row in rows):
        return cost + INSERT * (1 if symbol == last else 2)
    return cost + INSERT * (before != last)


def aligned(rows: list[Row], begin: str, end: str) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits of rows that lead from the symbol `begin` to the symbol `end` ("" before the first), the ASCII-least of
    them; None if there are none. Every feasible length of the target is tried; those of least cost are traced back and their audits compared."""
    n, found = len(rows), []
    kept = [i for i, row in enumerate(rows) if begin == "" and row.initial == "s" and not row.gone]  # rows that may open as the system's
    if begin == end:
        found.append((DELETE * n, "D" * n))
    if end == "s":
        found += [(DELETE * (n - 1) + CUT * rows[i].cut, "D" * i + "K" + "D" * (n - 1 - i)) for i in kept]
    if end in ("u", "a"):
        first = NEXT[begin]
        incumbent = min([_incumbent(rows, first, end), *(c for c, _ in found)])
        table = Alignment(rows, end, incumbent)
        odd = first == end
        starts = [(0, 0, "")] + [(i + 1, DELETE * i + CUT * rows[i].cut, "D" * i + "K") for i in kept]
        options = [(spent + table.cost(i, k), i, k, head) for i, spent, head in starts
                   for k in range(1 if odd else 2, n + incumbent // INSERT + 1, 2)]
        least = min([c for c, *_ in options] + [c for c, _ in found])
        found += [(c, head + table.audit(i, k)) for c, i, k, head in options if c == least]
    return min(found, default=None)


def repaired(rows: list[Row], audit: str, begin: str, written: bool = False):
    """The repaired rows as bytes, each but the first of all after a newline."""
    at = iter(rows)
    for letter in audit:
        row = None if letter == "I" else next(at)
        if letter == "D":
            continue
        if letter == "K":
            symbol, line = row.initial, row.role + b":" + row.text
        else:
            symbol = NEXT[begin]
            line = ROLES[symbol] + b":" + (row.text if row else b"")
        yield (b"\n" if written else b"") + line
        begin, written = symbol, True


@dataclass
class Conversation:
    """What is known of a conversation's rows so far; `ends` has, for each symbol it may have come to, the cost, the audit and the digest of the repaired rows."""

    conv_id: int | None
    low: int | None = None
    high: int | None = None
    turns: int = 0
    faults: dict = field(default_factory=lambda: dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0))
    before: str | None = None
    rows: list = field(default_factory=list)
    ends: dict = field(default_factory=lambda: {"": (0, "", hashlib.sha256())})

    def add(self, turn: int | None, role: bytes, text: bytes, times: int, again: bool) -> None:
        """A row, which stands there `times` times; again: an earlier row has its role and text."""
        if turn is not None:
            if self.high != turn:  # they come in order
                self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        plain = text.decode(errors="replace").rstrip(_SPACE)
        initial = role.decode(errors="replace")[:1]
        fault = "blank" if not plain else "duplicate" if again else "truncated" if plain[-1] not in ".!?" else None
        self.faults["illegal"] += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        if fault:
            self.faults[fault] += 1
        self.rows.append(Row(initial, fault in ("blank", "duplicate"), fault == "truncated", role, text))
        if len(self.rows) == SEGMENT:
            self.advance()
        if more := times - 1:
            self.faults["illegal"] += more * (initial + initial not in ("su", "ua", "au"))
            self.faults["duplicate" if plain else "blank"] += more
            if more < SEGMENT:
                for _ in range(more):
                    self.rows.append(Row(initial, True, False))
                    if len(self.rows) == SEGMENT:
                        self.advance()
            else:
                self.advance()
                self.ends = {s: (cost + DELETE * more, audit + "D" * more, sha) for s, (cost, audit, sha) in self.ends.items()}

    def advance(self, ends: tuple = ("", "s", "u", "a")) -> None:
        """Aligns the rows at hand from each symbol to each, and goes on from the cheapest."""
        now = {}
        for end in ends:
            ways = []
            for begin, (cost, audit, _) in self.ends.items():
                if way := aligned(self.rows, begin, end):
                    ways.append((cost + way[0], audit + way[1], begin, way[1]))
            if ways:
                cost, audit, begin, own = min(ways)
                sha = self.ends[begin][2].copy()
                for line in repaired(self.rows, own, begin, begin != ""):
                    sha.update(line)
                now[end] = cost, audit, sha
        self.ends, self.rows = now, []

    def result(self) -> tuple:
        self.advance(("", "a"))
        cost, audit, sha = min(self.ends.values(), key=lambda x: x[:2])
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, *self.faults.values(), cost, audit, sha.hexdigest()


def repair(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text, times), in no order -> one row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn (nulls first), then role and text; times: how often a row stands there, 0 for a row that only names its conversation. Repaired
    roles read (s?(ua)+)?. Null conv_id is a conversation; so is one whose rows are all gone (zeros, no audit). Roles of other initials are
    re-roled or deleted. Empty tables give no rows; other columns are left out.

    Equal rows of a task become one before any shuffle, and rows that repeat an earlier one are found by a join with first turns, which Spark
    can split; so neither copies nor a frequent text gather. What remains is inherently serial: a conversation's audit and digest are one value over its rows in
    order. These stream through the task of their conversation, SEGMENT rows at a time, and all that is held besides is the audit. The rows of
    a segment are aligned from each symbol before it to each after; of equal cost the ASCII-least audit of a whole begins with the least ones of its parts.
    """
    keys = ["conv_id", "turn", "role", "text"]
    rows = conversations.groupBy(*keys).agg(F.sum("times").alias("times")).withColumn("digest", F.sha2("text", 256))
    order = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    first = rows.where("times > 0").groupBy("conv_id", "role", "digest").agg(F.min(order).alias("first"))
    r, f = rows.alias("r"), first.alias("f")
    same = F.col("r.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("r.role") == F.col("f.role")) & (F.col("r.digest") == F.col("f.digest"))
    again = F.coalesce(~F.col("r.turn").eqNullSafe(F.col("f.first.turn")) & F.col("f.first").isNotNull(), F.lit(False))
    marked = r.join(f, same, "left").select("r.conv_id", "r.turn", "r.role", "r.text", "r.times", again.alias("again"))
    placed = marked.repartition("conv_id").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in keys])
    kinds = (pa.int64(),) * 7 + (pa.string(),) * 2
    names = [x.split()[0] for x in OUT.split(", ")]

    def run(batches):
        now = None
        for batch in batches:
            done = []
            columns = [batch.column("conv_id").to_pylist(), batch.column("turn").to_pylist(), texts(batch.column("role")), texts(batch.column("text")),
                       batch.column("times").to_pylist(), batch.column("again").to_pylist()]
            for conv_id, turn, role, text, times, again_ in zip(*columns, strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.result())
                    now = Conversation(conv_id)
                if times:
                    now.add(turn, role, text, times, again_)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(now.result(), kinds, strict=True)], names=names)

    return placed.mapInArrow(run, OUT)


def _walk() -> str:
    """SQL: one step of a walk over what may have come last (nothing, a system row, a user's, an assistant's), each with its least (cost, audit)."""
    edit = lambda state, cost, letter: f"{{'c': e.{state}.c + {cost}, 's': e.{state}.s || {letter}}}"
    role = lambda state, symbol: edit(state, f"CASE WHEN x.gone THEN {10**9} WHEN x.initial = '{symbol}' THEN x.w ELSE {REROLE} + x.w END", f"CASE WHEN x.initial = '{symbol}' THEN 'K' ELSE 'R' END")
    keep = edit("n", f"CASE WHEN x.gone OR x.initial <> 's' THEN {10**9} ELSE x.w END", "'K'")
    gone = lambda state: edit(state, DELETE, "'D'")
    made = lambda state, n: edit(state, INSERT * n, f"'{'I' * n}'")
    least = lambda *ways: f"list_min([{', '.join(ways)}])"
    insert = f"{{'n': e.n, 's': e.s, 'u': {least('e.u', made('n', 1), made('s', 1), made('a', 1))}, 'a': {least('e.a', made('u', 1), made('n', 2), made('s', 2))}}}"
    take = f"{{'n': {gone('n')}, 's': {least(gone('s'), keep)}, 'u': {least(gone('u'), *(role(b, 'u') for b in 'nsa'))}, 'a': {least(gone('a'), role('u', 'a'))}}}"
    return f"CASE WHEN x.initial IS NULL THEN {insert} ELSE {take} END"


#: The same by a walk over an automaton in place of an alignment.
SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
k AS (SELECT name, xor(list_reduce(list_transform(range(8 * length(name)), lambda b: (ascii(name[(b // 8 + 1)::INT])::BIGINT >> (b % 8)) & 1),
  lambda acc, bit: xor(acc >> 1, 3988292384 * (xor(acc, bit) & 1)), 4294967295::BIGINT), 4294967295) % 20 AS kind FROM (SELECT DISTINCT name FROM c)),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE kind WHEN 0 THEN []::INT[] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM c JOIN k USING (name)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
f AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
       WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
       WHEN right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM o),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before IS NOT NULL AND (before || initial) NOT IN ('su', 'ua', 'au')) AS illegal,
  list({{'initial': initial, 'gone': coalesce(fault IN ('blank', 'duplicate'), false), 'w': CASE WHEN fault = 'truncated' THEN {CUT} ELSE 0 END}} ORDER BY i) AS rows
  FROM f GROUP BY conv_id),
w AS (SELECT * EXCLUDE rows, list_reduce(flatten(list_transform(rows, lambda r: [r, {{'initial': NULL::VARCHAR, 'gone': false, 'w': 0}}])),
  lambda e, x: {_walk()},
  {{'n': {{'c': 0::BIGINT, 's': ''}}, 's': {{'c': {10**9}::BIGINT, 's': ''}}, 'u': {{'c': 2::BIGINT, 's': 'I'}}, 'a': {{'c': 4::BIGINT, 's': 'II'}}}}) AS ends FROM g),
b AS (SELECT *, list_min([ends.n, ends.a]) AS best FROM w),
l AS (SELECT conv_id, unnest(range(1, length(best.s) + 1)) AS p, best.s AS audit FROM b),
m AS (SELECT conv_id, p, audit[p::INT] AS letter, count(*) FILTER (audit[p::INT] <> 'I') OVER w AS i, count(*) FILTER (audit[p::INT] <> 'D') OVER w AS nth
  FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
t AS (SELECT m.*, f.role, f.text, f.initial, max(CASE WHEN letter = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY m.conv_id) AS led
  FROM m LEFT JOIN f ON m.conv_id IS NOT DISTINCT FROM f.conv_id AND m.i = f.i),
r AS (SELECT conv_id, sha256(string_agg(CASE letter WHEN 'K' THEN role ELSE CASE WHEN (nth - led) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' ||
  CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS hash FROM t WHERE letter <> 'D' GROUP BY conv_id)
SELECT n.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.s, '') AS audit, coalesce(hash, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) n LEFT JOIN b ON n.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN r ON n.conv_id IS NOT DISTINCT FROM r.conv_id
"""
