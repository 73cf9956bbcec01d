"""Repair of conversations: the cheapest edits that give every one a legal order of roles.

Roles may read ``(s?(ua)+)?`` by their initials: nothing, or pairs of user and assistant after
at most one system turn. A node of the edit lattice is (rows passed, state of that grammar);
its edges are Keep (0), Rerole to user or assistant (2), Delete (3; blank rows and duplicates
must go) and Insert of an empty user or assistant turn (2), and a truncated row that stays adds 1.
The lattice is never built: Dijkstra's search expands nodes as it pops them, by the key (cost,
audit), where the audit spells the edits so far, and stops at the first accepting node behind
the last row. As costs decide before audits, and of two ways to a node with equal costs neither
spells the beginning of the other, the first pop of a node is its best.

Duplicates are found by an aggregation and a join that no hot conversation or text is a key of.
Then a conversation's rows pass through one task in order, WINDOW rows at a time: of a longer
one the search goes from the nodes that one window ends with to those of the next, edits that
all of these share are done, and their rows are let go. What a task holds is a window and the audit,
which the result has anyway. (A SHA-256 of a whole conversation can only be made in order.)
"""

from __future__ import annotations

import hashlib
import os
from collections import deque
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sieveline.llm.common import give_back

#: Rows of a conversation that are searched at a time.
WINDOW = 256
#: What edits cost, and what a truncated row adds that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: What follows each state of the grammar: by a role's initial (an empty role has none and may stand anywhere), and
#: by an edit that may choose the role.
START, SYSTEM, USER, ASSISTANT = range(4)
BY_INITIAL = ({"s": SYSTEM, "u": USER, "": START}, {"u": USER, "": SYSTEM}, {"a": ASSISTANT, "": USER}, {"u": USER, "": ASSISTANT})
CHOSEN = (USER, USER, ASSISTANT, USER)
ACCEPTING = (START, ASSISTANT)
ROLE = {USER: "user", ASSISTANT: "assistant"}

SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, edit string, turn long, role string, text string"


def search(rows: list[tuple[str, bool, bool]], sources: dict[int, tuple[int, str]], last: bool = True) -> dict[int, tuple[int, str]]:
    """The best (cost, audit) of nodes behind rows (initial, must go, truncated), from nodes before them.

    If these are the last rows, that is one node: the first accepting one. Otherwise all nodes that a best way may
    go through: from an assistant's turn on, whatever is legal after another node is legal as well or with one
    system turn deleted, so nodes that cost more than DELETE above it can't be on one.
    """
    heap, done, ends, most = [(cost, audit, 0, state) for state, (cost, audit) in sources.items()], set(), {}, None
    heap.sort()
    while heap:
        cost, audit, i, state = heappop(heap)
        if (i, state) in done:
            continue
        if most is not None and cost > most:
            break
        done.add((i, state))
        if i == len(rows):
            if last and state in ACCEPTING:
                return {state: (cost, audit)}
            ends[state] = (cost, audit)
            if state == ASSISTANT and not last:
                most = cost + DELETE
        else:
            initial, must_go, cut = rows[i]
            heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
            if not must_go:
                if initial in BY_INITIAL[state]:
                    heappush(heap, (cost + TRUNCATED * cut, audit + "K", i + 1, BY_INITIAL[state][initial]))
                heappush(heap, (cost + REROLE + TRUNCATED * cut, audit + "R", i + 1, CHOSEN[state]))
        heappush(heap, (cost + INSERT, audit + "I", i, CHOSEN[state]))
    return ends


class Repair:
    """One conversation, row after row; give() and end() return the turns of the repaired one as they get certain."""

    def __init__(self, window: int = WINDOW):
        self.window, self.ahead, self.held = window, [], deque()  # rows not searched yet; rows not repaired yet
        self.nodes = {START: (0, "")}  # of the rows searched, with the audit since the last certain edit
        self.state, self.place, self.audit = START, 0, []
        self.sha, self.first = hashlib.sha256(), True
        self.turns, self.low, self.high, self.before, self.initial = 0, None, None, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0

    def give(self, turn: int | None, role: str, text: str, blank: bool, again: bool, ended: bool) -> list[tuple]:
        """The next row: whether it is blank, a duplicate, or ends a sentence."""
        if turn is not None and turn != self.before:
            self.turns, self.before, self.high = self.turns + 1, turn, turn
            self.low = turn if self.low is None else self.low
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        self.blank += blank
        self.duplicate += again and not blank
        cut = not (blank or again or ended)
        self.truncated += cut
        out = self.step(False) if len(self.ahead) >= self.window else []
        self.ahead.append((initial, blank or again, cut))
        self.held.append((turn, role, text))
        return out

    def step(self, last: bool) -> list[tuple]:
        self.nodes = search(self.ahead, self.nodes, last)
        self.ahead = []
        sure = os.path.commonprefix([audit for _, audit in self.nodes.values()])
        self.nodes = {state: (cost, audit[len(sure) :]) for state, (cost, audit) in self.nodes.items()}
        return [*self.edited(sure)]

    def end(self) -> list[tuple]:
        """No rows are left."""
        out = self.step(True)
        self.cost = next(iter(self.nodes.values()))[0]
        return out

    def edited(self, audit: str) -> Iterator[tuple]:
        """(place, edit, turn, role, text) of the next edits; deleted rows have no place."""
        self.audit.append(audit)
        for edit in audit:
            turn, role, text = (None, "", "") if edit == "I" else self.held.popleft()
            if edit == "D":
                yield None, edit, turn, role, text
                continue
            self.state = BY_INITIAL[self.state][role[:1]] if edit == "K" else CHOSEN[self.state]
            role = role if edit == "K" else ROLE[self.state]
            self.sha.update(("" if self.first else "\n").encode() + role.encode() + b":" + text.encode())
            self.first = False
            self.place += 1
            yield self.place, edit, turn, role, text

    def summary(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): rows after damage by the checksum of their names; n says how often one stands,
    0 once or more for each conversation's dropped rows, which have no turn, role or text. A null role or text is
    one space, as is a null conversation or turn in the checksum."""
    name = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" "))
    code = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), code.alias("code"))
    return rows.select(
        "conv_id", F.when(F.col("code") != 0, F.col("turn")).alias("turn"), F.when(F.col("code") == 0, "").when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code").isin(0, 1), "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def judged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, n), equal ones as one, with first (no earlier row of the conversation has
    the role and text), blank and ended (the last character that isn't a space ends a sentence).

    Where a role and text stand first is an aggregation, joined on the turn as well: no key is hot.
    """
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    known = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = rows.where("n > 0").groupBy("conv_id", "role", "digest").agg(F.min(known).alias("at")).select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("at.turn").alias("t"))
    same: Column = (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")) & F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
    return rows.join(first, same, "left").select(
        "conv_id", "turn", "role", "text", "n", F.col("d").isNotNull().alias("first"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z").alias("ended"),
    )


def _stream(window: int, turns: bool):
    """For partitions sorted by conversation and place: summaries, or the turns themselves."""

    target = to_arrow_schema(StructType.fromDDL(TURNS if turns else SUMMARY))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, repair, out = None, None, []

        def put(edits):
            if turns:
                out.extend((name, *e) for e in edits)

        def close():
            put(repair.end())
            if not turns:
                out.append((name, *repair.summary()))

        def flush():
            columns = list(zip(*out)) if out else [[] for _ in target]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, target)], schema=target)

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for conv_id, turn, role, text, n, first, blank, ended in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns)):
                    if repair is None or conv_id != name:
                        if repair is not None:
                            close()
                        name, repair = conv_id, Repair(window)
                    for k in range(n):
                        put(repair.give(turn, role, text, blank, not first or k > 0, ended))
                        if len(out) >= 1024:
                            yield flush()
                if out:
                    yield flush()
        if repair is not None:
            close()
            yield flush()
        give_back()

    return run


def _repaired(rows: DataFrame, window: int, turns: bool) -> DataFrame:
    ordered = judged(rows).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_stream(window, turns), TURNS if turns else SUMMARY)


def summaries(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row a conversation: gaps in its turns, blank, duplicate and truncated rows (the first fault of each),
    neighbours whose roles don't follow each other, cost and audit of the repair, SHA-256 of the repaired rows
    ``role:text`` joined by newlines. rows: conv_id, turn, role, text (none null but conv_id and turn), n.

    A null conversation is one; turns that are null come first; rows of one turn go by role, then text, so the order is
    complete and copies stand side by side. A conversation without rows (n = 0) has zeros, an empty audit and
    the hash of nothing. An empty table gives an empty result; other columns are ignored.
    """
    return _repaired(rows, window, False)


def repaired(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """The repaired turns themselves: (conv_id, place, edit, turn, role, text), from place 1 on; deleted rows have
    no place, inserted ones no turn. rows: as in summaries()."""
    return _repaired(rows, window, True)


SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
coded AS (SELECT *, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT),
  lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS code FROM keyed),
damaged AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE code WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM coded),
names AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
placed AS (SELECT c, turn, role, text, left(role, 1) AS ini, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i
  FROM damaged JOIN names ON damaged.conv_id IS NOT DISTINCT FROM names.conv_id),
seen AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) AS seen FROM placed),
faults AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, seen > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut,
  lag(ini) OVER (PARTITION BY c ORDER BY i) || ini AS pair FROM seen),
numbers AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
  count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faults GROUP BY c),
follows AS (SELECT * FROM (VALUES ('0', 'u', 'U'), ('S', 'u', 'U'), ('U', 'a', 'A'), ('A', 'u', 'U'), ('0', 's', 'S'), ('0', '', '0'), ('S', '', 'S'), ('U', '', 'U'), ('A', '', 'A')) AS t(s, ini, nxt)),
edits AS (SELECT c, i, s, 'K' AS edit, nxt, CASE WHEN cut THEN 1 ELSE 0 END AS price, [role || ':' || text] AS more FROM faults JOIN follows USING (ini) WHERE NOT blank AND NOT again
  UNION ALL SELECT c, i, s, 'R', nxt, CASE WHEN cut THEN 3 ELSE 2 END, [CASE nxt WHEN 'U' THEN 'user' ELSE 'assistant' END || ':' || text] FROM faults, follows WHERE follows.ini IN ('u', 'a') AND NOT blank AND NOT again
  UNION ALL SELECT c, i, s, 'D', s, 3, []::VARCHAR[] FROM faults, (SELECT DISTINCT s FROM follows)),
filled AS (SELECT * FROM (VALUES ('0', '', '0', 0, []::VARCHAR[]), ('S', '', 'S', 0, []), ('U', '', 'U', 0, []), ('A', '', 'A', 0, []),
  ('0', 'I', 'U', 2, ['user:']), ('S', 'I', 'U', 2, ['user:']), ('U', 'I', 'A', 2, ['assistant:']), ('A', 'I', 'U', 2, ['user:']),
  ('0', 'II', 'A', 4, ['user:', 'assistant:']), ('S', 'II', 'A', 4, ['user:', 'assistant:'])) AS t(f, put, g, toll, add)),
walk(c, i, s, cost, audit, kept) AS (
  SELECT c, 0::BIGINT, g, toll::BIGINT, put, add FROM names, filled WHERE f = '0'
  UNION ALL
  SELECT c, i, s, cost, audit, kept FROM (
    SELECT w.c, e.i, g AS s, w.cost + price + toll AS cost, w.audit || edit || put AS audit, list_concat(list_concat(w.kept, more), add) AS kept,
      row_number() OVER (PARTITION BY w.c, g ORDER BY w.cost + price + toll, w.audit || edit || put) AS best
    FROM walk w JOIN edits e ON e.c = w.c AND e.i = w.i + 1 AND e.s = w.s JOIN filled ON f = e.nxt) WHERE best = 1),
ends AS (SELECT c, cost, audit, kept, row_number() OVER (PARTITION BY c ORDER BY cost, audit) AS best FROM walk JOIN (SELECT c, coalesce(n, 0) AS n FROM names LEFT JOIN numbers USING (c)) USING (c) WHERE i = n AND s IN ('0', 'A'))
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, cost::BIGINT AS cost, audit, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS repaired_sha256
FROM names JOIN ends USING (c) LEFT JOIN numbers USING (c) WHERE best = 1
"""
