"""Cheapest repair of conversation structure by a generalised LR parser with edits.

Roles must follow a small grammar. Its LR(0) automaton is built from the rules; the parser keeps all stacks that are alive
at once, as a graph in which stacks share what lies below their tops. Each row may be kept, given another role or deleted,
and a turn may be inserted; equal stacks are merged by the least (cost, edits). Two lists of edits of equal cost over the
same rows are never one the start of the other, so the least one stays the least whatever follows.

The rows of a conversation stream through one task in order. Edits that all live stacks agree on are given out at once, so
that a task holds only the rows still open, however long the conversation is.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from os.path import commonprefix
from pyspark.sql import DataFrame, Window, functions as F

from silovalue.llm import common

# Conversation: an optional system turn, then one or more exchanges of user and assistant; or nothing.
GRAMMAR = (("S", ""), ("S", "OP"), ("O", ""), ("O", "s"), ("P", "PE"), ("P", "E"), ("E", "ua"))
GOAL, TERMINALS = "S", "sua"
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
# From any stack a whole exchange can be completed by two insertions, and a system turn deleted: dearer stacks can't win.
HOPELESS = 2 * INSERT + DELETE
OPEN_ROWS = 64
SPACE = " \t\n\v\f\r"
LEGAL = {"su", "ua", "au"}

Stack = tuple  # (state, stack below or None)


class Parser:
    """LR(0) automaton of a grammar, and the stacks that each stack can become by a terminal."""

    def __init__(self, grammar: tuple[tuple[str, str], ...], goal: str):
        self.rules = (("", goal), *grammar)
        self.heads = {head for head, _ in self.rules}
        self.goal = goal
        self.items: list[frozenset[tuple[int, int]]] = [self._closed({(0, 0)})]
        self.goto: dict[tuple[int, str], int] = {}
        for state, items in enumerate(self.items):  # grows while it is read
            for symbol in sorted({self.rules[r][1][d] for r, d in items if d < len(self.rules[r][1])}):
                after = self._closed({(r, d + 1) for r, d in items if self.rules[r][1][d : d + 1] == symbol})
                if after not in self.items:
                    self.items.append(after)
                self.goto[state, symbol] = self.items.index(after)
        self.known: dict[tuple[Stack, str], tuple[Stack, ...]] = {}
        self.start = self._reduced({(0, None)})

    def _closed(self, items: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        todo = list(items)
        while todo:
            rule, dot = todo.pop()
            wanted = self.rules[rule][1][dot : dot + 1]
            new = {(r, 0) for r, (head, _) in enumerate(self.rules) if wanted and head == wanted} - items
            items |= new
            todo += new
        return frozenset(items)

    def _reduce(self, stacks: set[Stack], at_end: bool) -> set[Stack]:
        todo, out = list(stacks), set(stacks)
        while todo:
            stack = todo.pop()
            for rule, dot in self.items[stack[0]]:
                head, body = self.rules[rule]
                if dot < len(body) or not rule or (head == self.goal and not at_end):
                    continue
                below = stack
                for _ in body:
                    below = below[1]
                new = (self.goto[below[0], head], below)
                if new not in out:
                    out.add(new)
                    todo.append(new)
        return out

    def _reduced(self, stacks: set[Stack]) -> tuple[Stack, ...]:
        """After all reductions, the stacks that a terminal can still extend."""
        return tuple(sorted((s for s in self._reduce(stacks, False) if any((s[0], t) in self.goto for t in TERMINALS)), key=repr))

    def shift(self, stack: Stack, terminal: str) -> tuple[Stack, ...]:
        key = stack, terminal
        if key not in self.known:
            to = self.goto.get((stack[0], terminal)) if terminal in TERMINALS and terminal else None
            self.known[key] = () if to is None else self._reduced({(to, stack)})
        return self.known[key]

    def accepts(self, stack: Stack) -> bool:
        return any((0, 1) in self.items[s[0]] for s in self._reduce({stack}, True))


PARSER = Parser(GRAMMAR, GOAL)


class Repair:
    """The cheapest edits of one conversation. ``row`` and ``end`` give what is certain: (edit, role, text) in order."""

    def __init__(self):
        self.tops: dict[Stack, tuple[int, str]] = {stack: (0, "") for stack in PARSER.start}
        self.open: deque[tuple[str, str]] = deque()
        self.before = ""  # the initial of the last turn given out
        self.cost = 0

    def _insert(self) -> None:
        todo = list(self.tops)
        while todo:
            stack = todo.pop()
            cost, edits = self.tops[stack]
            for terminal in ROLES:
                for to in PARSER.shift(stack, terminal):
                    value = (cost + INSERT, edits + "I")
                    if to not in self.tops or value < self.tops[to]:
                        self.tops[to] = value
                        todo.append(to)

    def row(self, role: str, text: str, unwanted: bool, truncated: bool) -> Iterator[tuple[str, str, str]]:
        self._insert()
        after: dict[Stack, tuple[int, str]] = {}
        stay = TRUNCATED if truncated else 0
        for stack, (cost, edits) in self.tops.items():
            options = [(stack, (cost + DELETE, edits + "D"))]
            if not unwanted:
                options += [(to, (cost + stay, edits + "K")) for to in PARSER.shift(stack, role[:1])]
                options += [(to, (cost + stay + REROLE, edits + "R")) for t in ROLES for to in PARSER.shift(stack, t)]
            for to, value in options:
                if to not in after or value < after[to]:
                    after[to] = value
        least = min(after.values())[0]
        self.tops = {stack: value for stack, value in after.items() if value[0] <= least + HOPELESS}
        self.open.append((role, text))
        if len(self.open) >= OPEN_ROWS and len(self.open) % OPEN_ROWS == 0:
            yield from self._settle()

    def _settle(self) -> Iterator[tuple[str, str, str]]:
        agreed = commonprefix([edits for _, edits in self.tops.values()])
        self.tops = {stack: (cost, edits[len(agreed) :]) for stack, (cost, edits) in self.tops.items()}
        yield from self._replay(agreed)

    def _replay(self, edits: str) -> Iterator[tuple[str, str, str]]:
        for edit in edits:
            role, text = ("", "") if edit == "I" else self.open.popleft()
            if edit in "RI":
                role = ROLES["a" if self.before == "u" else "u"]
            if edit != "D":
                self.before = role[:1]
            yield edit, role, text

    def end(self) -> Iterator[tuple[str, str, str]]:
        self._insert()
        self.cost, edits = min(value for stack, value in self.tops.items() if PARSER.accepts(stack))
        yield from self._replay(edits)


class Conversation:
    """Counts, faults and repair of one conversation, fed with its rows in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.repair = conv_id, Repair()
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.first = self.turn = None
        self.turns = 0
        self.role: str | None = None

    def feed(self, turn: int | None, role: str, text: str, seen: bool) -> Iterator[tuple[str, str, str]]:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.turn
            self.turn = turn
        if self.role is not None and self.role[:1] + role[:1] not in LEGAL:
            self.counts["illegal"] += 1
        self.role = role
        words = text.rstrip(SPACE)
        fault = "blank" if not words else "duplicate" if seen else "truncated" if words[-1] not in ".!?" else None
        if fault:
            self.counts[fault] += 1
        yield from self.repair.row(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def gaps(self) -> int:
        return 0 if self.first is None else self.turn - self.first + 1 - self.turns


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present): the rows damaged by a checksum of their key; dropped ones stay, not present.

    Null roles and texts are one space, and so is a null in the key; null ids and turns themselves stay null.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind, text = F.crc32(key) % 20, F.coalesce(F.col("text").cast("string"), blank)
    return conversations.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"),
        F.when(kind == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), blank)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind != 0).alias("present"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows of one conversation together, by turn (nulls first), role and text; ``seen``: role and text came earlier.

    Repeats are found by their own shuffle on conversation, role and text, so that no task remembers a whole conversation.
    """
    rows = rows.select("conv_id", "turn", "role", "text", "present", F.sha2("text", 256).alias("digest"))
    earlier = Window.partitionBy("conv_id", "present", "role", "digest").orderBy("turn")
    rows = rows.withColumn("seen", F.row_number().over(earlier) > 1).drop("digest")
    return rows.repartition(common.width(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text", "seen")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Conversation, Iterator[tuple[str, str, str]], bool]]:
    """Conversation by conversation: what each row settles, then what the end settles (last: True)."""
    now: Conversation | None = None
    for batch in batches:
        for conv_id, turn, role, text, present, seen in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "present", "seen"))):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    yield now, now.repair.end(), True
                now = Conversation(conv_id)
            if present:
                yield now, now.feed(turn, role, text, seen), False
    if now is not None:
        yield now, now.repair.end(), True


def _batched(rows: Iterator[tuple], types: dict[str, pa.DataType], most: int = 4_000, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    held_bytes = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types.values())], list(types))

    for row in rows:
        held.append(row)
        held_bytes += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= most or held_bytes >= size:
            yield batch()
            held, held_bytes = [], 0
    if held:
        yield batch()


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of the repaired conversations in order; edit is K, R or I."""
    types = {"conv_id": pa.int64(), "place": pa.int64(), "edit": pa.string(), "role": pa.string(), "text": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turns() -> Iterator[tuple]:
            place = 0
            for conversation, settled, last in _streamed(batches):
                for edit, role, text in settled:
                    if edit != "D":
                        yield conversation.conv_id, place, edit, role, text
                        place += 1
                if last:
                    place = 0

        yield from _batched(turns(), types)

    return _ordered(rows).mapInArrow(run, "conv_id bigint, place bigint, edit string, role string, text string")


def report(rows: DataFrame) -> DataFrame:
    """One row per conv_id, a null one included: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Expects ``damage``'s columns. Rows of one turn are ordered by role and text; a conversation without present rows has
    zeros, an empty audit and the hash of an empty string. An empty table gives no rows; other columns are not read.
    """
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    types = {"conv_id": pa.int64(), **dict.fromkeys(names, pa.int64()), "audit": pa.string(), "repaired_sha256": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines() -> Iterator[tuple]:
            audit, digest, empty = [], hashlib.sha256(), True
            for conversation, settled, last in _streamed(batches):
                for edit, role, text in settled:
                    audit.append(edit)
                    if edit != "D":
                        digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                        empty = False
                if last:
                    yield conversation.conv_id, conversation.gaps(), *conversation.counts.values(), conversation.repair.cost, "".join(audit), digest.hexdigest()
                    audit, digest, empty = [], hashlib.sha256(), True

        yield from _batched(lines(), types)

    return _ordered(rows).mapInArrow(run, "conv_id bigint, " + ", ".join(f"{n} bigint" for n in names) + ", audit string, repaired_sha256 string")


# The same rows in DuckDB's SQL: the checksum by its table, and the cheapest path through the roles' states, row by row.
REPAIR_SQL = r"""
WITH RECURSIVE crc_bits AS (SELECT n, n AS c, 0 AS k FROM range(256) AS t(n)
  UNION ALL SELECT n, xor(c >> 1, (c & 1) * 3988292384), k + 1 FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY n) AS tab FROM crc_bits WHERE k = 8),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce("text", ' ') AS body,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
summed AS (SELECT conv_id, turn, role, body, xor(list_reduce([4294967295] || list_transform(string_split(k, ''), lambda x: ord(x)::BIGINT),
  lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind FROM keyed, crc_table),
copied AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(body, '[.!?]', '', 'g') ELSE body END AS body,
  unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM summed),
placed AS (SELECT coalesce(conv_id::VARCHAR, 'null') AS g, turn, role, body,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body, copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, body ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
  lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body, copy) AS prior FROM copied),
judged AS (SELECT *, substr(role, 1, 1) AS initial, NOT regexp_matches(body, '[^\x20\x09-\x0D]') AS blank,
  NOT regexp_matches(body, '[.!?][\x20\x09-\x0D]*$') AS cut FROM placed),
turns AS (SELECT *, blank OR seen AS gone, CASE WHEN cut AND NOT blank AND NOT seen THEN 5 ELSE 0 END AS extra FROM judged),
shifts(q, t, r) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
names(t, name) AS (VALUES ('u', 'user'), ('a', 'assistant')),
inserts(q, r, c, e, lines) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']),
  (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 2, 5, 'I', ['user:']), (1, 3, 10, 'II', ['user:', 'assistant:']), (2, 3, 5, 'I', ['assistant:']), (3, 2, 5, 'I', ['user:'])),
paths AS (SELECT g, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM (SELECT DISTINCT g FROM turns)
  UNION ALL SELECT g, i, q, cost, audit, lines FROM (
    SELECT *, row_number() OVER (PARTITION BY g, q ORDER BY cost, audit) AS best FROM (
      SELECT w.g, t.i, CASE edit WHEN 'D' THEN n.r ELSE s.r END AS q, w.cost + n.c + CASE edit WHEN 'D' THEN 2 WHEN 'K' THEN extra ELSE 1 + extra END AS cost,
        w.audit || n.e || edit AS audit,
        w.lines || n.lines || CASE edit WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [t.role || ':' || t.body] ELSE [names.name || ':' || t.body] END AS lines
      FROM paths AS w JOIN inserts AS n ON n.q = w.q JOIN turns AS t ON t.g = w.g AND t.i = w.i + 1, (VALUES ('K'), ('R'), ('D')) AS edits(edit)
      LEFT JOIN shifts AS s ON edit <> 'D' AND s.q = n.r LEFT JOIN names ON names.t = s.t
      WHERE edit = 'D' OR NOT gone AND (edit = 'K' AND s.t = t.initial OR edit = 'R' AND names.name IS NOT NULL)))
    WHERE best = 1),
ends AS (SELECT w.g, w.cost + n.c AS cost, w.audit || n.e AS audit, w.lines || n.lines AS lines
  FROM paths AS w JOIN (SELECT g, max(i) AS n FROM turns GROUP BY g) AS m ON m.g = w.g AND m.n = w.i JOIN inserts AS n ON n.q = w.q AND n.r IN (0, 3)),
cheapest AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY g ORDER BY cost, audit) = 1),
faults AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
  count(*) FILTER (WHERE seen AND NOT blank) AS duplicate, count(*) FILTER (WHERE cut AND NOT blank AND NOT seen) AS truncated,
  count(*) FILTER (WHERE prior IS NOT NULL AND substr(prior, 1, 1) || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY g)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN faults AS f ON f.g = coalesce(conv_id::VARCHAR, 'null')
LEFT JOIN cheapest AS p ON p.g = f.g"""
