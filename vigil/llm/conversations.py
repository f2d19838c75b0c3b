"""Repair of damaged conversation structure by the cheapest edits.

Rows of a conversation are edited one by one: Keep (0), Rerole to user or
assistant (1), Delete (2, required for blank and duplicate rows), and Insert of
an empty user or assistant turn anywhere (5); a truncated row that stays adds
5.  The role initials that result must read ``(s?(ua)+)?``.  The audit is the
string of the edits' initials; of the cheapest audits the ASCII-least one wins.

Persistent audit DP.  After every row there is one best audit for each of four
grammar states (nothing, s, u, a at the end).  Audits are nodes of a tree that
share their prefixes; a node knows its 2^k-th ancestors and a rolling hash of
its string.  Audits of equal cost are compared by a search for their longest
common prefix over these ancestors; equal hashes of different nodes are
verified character by character.  (Of two audits of equal cost in one state
none is a prefix of the other, as every edit that uses up no row costs
something; so a better prefix stays better.)

Distribution.  Only numbers move for the DP: per row its conversation, turn,
role, a digest of the text and its faults.  Rows are range-partitioned by
(conversation, turn, role, digest) and cut to pieces of at most ``PIECE_ROWS``
rows, so a conversation of any length spreads over tasks; for a piece that does
not begin its conversation, the best audits from each state to each state are
computed, and pieces are joined in order (min-plus products).  Equal rows are
counted on the map side first.  The digest of the repaired text is a
sequential hash, so texts are exchanged once by conversation and streamed in
order beside their audit; a task holds one audit and one batch of rows.

Defined results: a null role or text is one space, as is a null conversation or
turn in the damage key; a null conversation is one conversation of its own;
rows of equal turn go by role, then by the SHA-256 of their text; roles that do
not begin with s, u or a (an empty role too) cannot be kept; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.base import partitions, query, table

PIECE_ROWS = 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
LEGAL = ("su", "ua", "au")
NONE, SYSTEM, USER, ASSISTANT = range(4)             # grammar states
_NEXT = {"user": USER, "assistant": ASSISTANT}
_TURN = {NONE: "user", SYSTEM: "user", ASSISTANT: "user", USER: "assistant"}       # what may follow a state
_MOD, _BASE = (1 << 61) - 1, 911_382_323


class Audits:
    """A tree of strings: node 0 is empty, every other node adds a character to its parent."""

    def __init__(self):
        self.char, self.depth, self.hash, self.up = [""], [0], [0], [()]

    def add(self, parent: int, char: str) -> int:
        up, node, k = [parent], len(self.char), 0
        while k < len(self.up[up[k]]):
            up.append(self.up[up[k]][k])
            k += 1
        self.char.append(char)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * _BASE + ord(char)) % _MOD)
        self.up.append(tuple(up))
        return node

    def lift(self, node: int, depth: int) -> int:
        """The ancestor of ``node`` that is ``depth`` characters long."""
        rest, k = self.depth[node] - depth, 0
        while rest:
            if rest & 1:
                node = self.up[node][k]
            rest, k = rest >> 1, k + 1
        return node

    def same(self, a: int, b: int) -> bool:
        """Equal strings?  Different nodes with equal hashes are compared to the end."""
        if a == b or self.hash[a] != self.hash[b] or self.depth[a] != self.depth[b]:
            return a == b
        while a != b:
            if self.char[a] != self.char[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Is the string of ``a`` before that of ``b``?"""
        m = min(self.depth[a], self.depth[b])
        x, y = self.lift(a, m), self.lift(b, m)
        if self.same(x, y):
            return self.depth[a] < self.depth[b]
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and not self.same(self.up[x][k], self.up[y][k]):
                x, y = self.up[x][k], self.up[y][k]
        return self.char[x] < self.char[y]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.char[node])
            node = self.up[node][0]
        return "".join(reversed(out))


def _better(tree: Audits, best, cost: int, parent: int, char: str):
    """``best`` or the audit ``parent`` + ``char``, whichever is cheaper (ASCII-least among equals)."""
    if best is not None and best[0] < cost:
        return best
    node = tree.add(parent, char)
    return (cost, node) if best is None or cost < best[0] or tree.less(node, best[1]) else best


def _insert(tree: Audits, state: list) -> list:
    """Best audits when turns may be inserted here."""
    state = list(state)
    for g in (NONE, SYSTEM, ASSISTANT):
        if state[g]:
            state[USER] = _better(tree, state[USER], state[g][0] + INSERT, state[g][1], "I")
    if state[USER]:
        state[ASSISTANT] = _better(tree, state[ASSISTANT], state[USER][0] + INSERT, state[USER][1], "I")
    return state


def _edit(tree: Audits, state: list, initial: str, must_go: bool, truncated: bool) -> list:
    """Best audits after one more row."""
    new = [s and (s[0] + DELETE, tree.add(s[1], "D")) for s in state]
    if must_go:
        return new
    more = TRUNCATED if truncated else 0
    if initial == "s" and state[NONE]:
        new[SYSTEM] = _better(tree, new[SYSTEM], state[NONE][0] + KEEP + more, state[NONE][1], "K")
    for g, s in enumerate(state):
        if s:
            role = _TURN[g]
            keep = initial == role[0]
            new[_NEXT[role]] = _better(tree, new[_NEXT[role]], s[0] + more + (KEEP if keep else REROLE), s[1], "K" if keep else "R")
    return new


class Piece:
    """Some consecutive rows of one conversation: faults, turns, and the best audits from each entry state to each state."""

    def __init__(self, conv, entries):
        self.conv, self.n = conv, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.first_turn = self.last_turn = None
        self.tree = Audits()
        self.states = {e: [(0, 0) if g == e else None for g in range(4)] for e in entries}

    def turn(self, turn):
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn, self.turns = turn, self.turns + 1

    def add(self, turn, initial, blank, duplicate, truncated):
        self.turn(turn)
        if self.n:
            self.illegal += self.last + initial not in LEGAL
        else:
            self.first = initial
        self.last, self.n = initial, self.n + 1
        if blank:
            self.blank += 1
        elif duplicate:
            self.duplicate += 1
        else:
            self.truncated += truncated
        for e, state in self.states.items():
            self.states[e] = _edit(self.tree, _insert(self.tree, state), initial, blank or duplicate, truncated)

    def row(self, part, seq) -> dict:
        costs, audits = [None] * 16, [None] * 16
        for e, state in self.states.items():
            for g, s in enumerate(_insert(self.tree, state)):
                if s:
                    costs[4 * e + g], audits[4 * e + g] = s[0], self.tree.text(s[1])
        return {"conv": self.conv, "part": part, "seq": seq, "n": self.n, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
                "illegal": self.illegal, "first": self.first, "last": self.last, "turns": self.turns, "first_turn": self.first_turn,
                "last_turn": self.last_turn, "costs": costs, "audits": audits}


_PIECE = ("part int, seq long, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, turns long, "
          "first_turn long, last_turn long, costs array<long>, audits array<string>")


def _arrow(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(df.schema)


def damage(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, turn, role, text, copies): rows after damage; a dropped row leaves its conversation with 0 copies."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text(conv), F.lit(":"), text("turn")).cast("binary")) % 20
    src = rows.select(F.col(conv).alias("conv"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    here = lambda c: F.when(F.col("kind") != 0, c)
    return src.select("conv", here(F.col("turn")).alias("turn"), here(F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))).alias("role"),
                      here(F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))).alias("text"),
                      F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _digest() -> F.Column:
    return F.unhex(F.sha2("text", 256)).alias("digest")


def faults(damaged: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, copies, blank, late, truncated): one row per distinct row; late: an earlier turn has it too."""
    end = F.rtrim("text", F.lit(BLANKS))
    distinct = (damaged.select("conv", "turn", "role", _digest(), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("truncated"), "copies")
                .groupBy("conv", "turn", "role", "digest").agg(F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated")))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    # texts that recur at several turns of one conversation
    first = (distinct.filter("copies > 0").groupBy("conv", "role", "digest").agg(F.min(when).alias("earliest"), F.count(F.lit(1)).alias("turns"))
             .filter("turns > 1").select(F.col("conv").alias("f_conv"), F.col("role").alias("f_role"), F.col("digest").alias("f_digest"), "earliest"))
    here = F.col("conv").eqNullSafe(F.col("f_conv")) & (F.col("role") == F.col("f_role")) & (F.col("digest") == F.col("f_digest"))
    return distinct.join(first, here, "left").select(
        "conv", "turn", "role", "digest", "copies", "blank", F.coalesce(when > F.col("earliest"), F.lit(False)).alias("late"), "truncated")


def pieces(rows: DataFrame, piece_rows: int | None = None) -> DataFrame:
    """Pieces of all conversations, from ``faults``."""
    most, spark = piece_rows or PIECE_ROWS, rows.sparkSession
    src = rows.select("conv", "turn", "role", "digest", F.coalesce(F.substring("role", 1, 1), F.lit("")).alias("initial"), "copies", "blank", "late", "truncated")
    src = (src.repartitionByRange(partitions(spark), "conv", "turn", "role", "digest").sortWithinPartitions("conv", "turn", "role", "digest")
           .select("conv", "turn", "initial", "copies", "blank", "late", "truncated", F.spark_partition_id().alias("part")))
    kind = f"conv {src.schema['conv'].dataType.simpleString()}, {_PIECE}"
    schema = _arrow(spark.createDataFrame([], kind))

    def run(batches):
        now, part, seq, out = None, 0, 0, []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(8)]
            for conv, turn, initial, copies, blank, late, truncated, part in zip(*cols):
                if now is None or conv != now.conv:
                    # the first conversation of a task may have begun in another one
                    entries = range(4) if now is None else (NONE,)
                    if now is not None:
                        out.append(now.row(part, seq))
                        seq += 1
                    now = Piece(conv, entries)
                for k in range(copies):
                    if now.n >= most:
                        out.append(now.row(part, seq))
                        seq += 1
                        now = Piece(conv, range(4))
                    now.add(turn, initial, blank, late or k > 0, truncated)
                if len(out) >= 500:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
        if now is not None:
            out.append(now.row(part, seq))
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    return src.mapInArrow(run, kind)


def _text(chain) -> str:
    out = []
    while chain:
        chain, s = chain
        out.append(s)
    return "".join(reversed(out))


class Joined:
    """A conversation put together from its pieces in order."""

    def __init__(self, conv):
        self.conv, self.n = conv, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.last = self.first_turn = self.last_turn = None
        self.state = {NONE: (0, None)}                   # state -> cost, audit as linked segments

    def add(self, p: dict):
        for c in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, c, getattr(self, c) + p[c])
        if p["n"]:
            if self.n:
                self.illegal += self.last + p["first"] not in LEGAL
            self.last, self.n = p["last"], self.n + p["n"]
        if p["first_turn"] is not None:
            self.turns += p["turns"] - (p["first_turn"] == self.last_turn)
            self.first_turn = p["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = p["last_turn"]
        new: dict = {}
        for g, (cost, chain) in self.state.items():
            for h in range(4):
                c = p["costs"][4 * g + h]
                if c is None:
                    continue
                one = (cost + c, (chain, p["audits"][4 * g + h]))
                old = new.get(h)
                if old is None or one[0] < old[0] or (one[0] == old[0] and _text(one[1]) < _text(old[1])):
                    new[h] = one
        self.state = new

    def row(self) -> dict:
        cost, audit = min((c, _text(a)) for g, (c, a) in self.state.items() if g in (NONE, ASSISTANT))
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.first_turn is not None else 0
        return {"conv": self.conv, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
                "illegal": self.illegal, "cost": cost, "audit": audit}


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def join_pieces(parts: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation."""
    spark = parts.sparkSession
    src = parts.repartition(partitions(spark), "conv").sortWithinPartitions("conv", "part", "seq")
    kind = f"conv {src.schema['conv'].dataType.simpleString()}, {_RESULT}"
    schema = _arrow(spark.createDataFrame([], kind))

    def run(batches):
        now, out = None, []
        for batch in batches:
            for p in batch.to_pylist():
                if now is None or p["conv"] != now.conv:
                    if now is not None:
                        out.append(now.row())
                    now = Joined(p["conv"])
                now.add(p)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row()], schema=schema)
    return src.mapInArrow(run, kind)


class Repair:
    """Applies an audit to the rows of a conversation, one after the other; yields what stays."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, NONE

    def _inserted(self):
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            role = _TURN[self.state]
            self.state = _NEXT[role]
            yield role, ""

    def row(self, role: str, text: str):
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            role = _TURN[self.state]
        if edit != "D":
            self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            yield role, text

    def end(self):
        yield from self._inserted()
        if self.at != len(self.audit):
            raise ValueError("an audit has more edits than its conversation has rows")


def _repair(rows: DataFrame, audits: DataFrame, kernel, fields: str) -> DataFrame:
    """Stream every conversation's damaged rows in order beside its audit; ``kernel(head, turns)`` gives rows of ``fields``."""
    spark = rows.sparkSession
    head = audits.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                         F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("copies"),
                         F.struct(*audits.columns[1:]).alias("head"))
    body = rows.filter("copies > 0").select("conv", F.lit(1).alias("kind"), "turn", "role", "text", _digest(), "copies",
                                            F.lit(None).cast(head.schema["head"].dataType).alias("head"))
    src = (head.unionByName(body).repartition(partitions(spark), "conv").sortWithinPartitions("conv", "kind", "turn", "role", "digest")
           .select("conv", "kind", "role", "text", "copies", "head"))
    kind = f"conv {src.schema['conv'].dataType.simpleString()}, {fields}"
    schema = _arrow(spark.createDataFrame([], kind))

    def run(batches):
        now = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    if now is not None:
                        out += now.end()
                    now = kernel(r["conv"], r["head"])
                else:
                    for _ in range(r["copies"]):
                        out += now.row(r["role"], r["text"])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if now is not None and (out := list(now.end())):
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    return src.mapInArrow(run, kind)


class _Digest:
    """SHA-256 of the repaired ``role:text`` lines."""

    def __init__(self, conv, head):
        self.conv, self.head, self.edits, self.sha, self.n = conv, head, Repair(head["audit"]), hashlib.sha256(), 0

    def _take(self, turns):
        for role, text in turns:
            self.sha.update(f"{'\n' if self.n else ''}{role}:{text}".encode())
            self.n += 1
        return ()

    def row(self, role, text):
        return self._take(self.edits.row(role, text))

    def end(self):
        self._take(self.edits.end())
        return [{"conv": self.conv, **self.head, "repaired_sha256": self.sha.hexdigest()}]


class _Turns:
    """The repaired turns themselves."""

    def __init__(self, conv, head):
        self.conv, self.edits, self.n = conv, Repair(head["audit"]), 0

    def _take(self, turns):
        out = []
        for role, text in turns:
            out.append({"conv": self.conv, "turn": self.n, "role": role, "text": text})
            self.n += 1
        return out

    def row(self, role, text):
        return self._take(self.edits.row(role, text))

    def end(self):
        return self._take(self.edits.end())


def audit_conversations(damaged: DataFrame, piece_rows: int | None = None) -> DataFrame:
    """Faults, cost and audit of every conversation of (conv, turn, role, text, copies)."""
    return join_pieces(pieces(faults(damaged), piece_rows))


def repair_digests(damaged: DataFrame, piece_rows: int | None = None) -> DataFrame:
    """``audit_conversations`` plus the digest of the repaired text."""
    return _repair(damaged, audit_conversations(damaged, piece_rows), _Digest, f"{_RESULT}, repaired_sha256 string")


def repair(damaged: DataFrame, piece_rows: int | None = None) -> DataFrame:
    """The repaired conversations: (conv, turn from 0, role, text)."""
    return _repair(damaged, audit_conversations(damaged, piece_rows), _Turns, "turn long, role string, text string")


@query("op11_conversation_repair", r"""
WITH RECURSIVE crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))) ORDER BY i) AS tab FROM range(256) AS b(i)),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS cs FROM conversations),
hit AS (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce([4294967295] || list_transform(cs, lambda c: ord(c)::BIGINT),
  lambda x, y: xor(x >> 8, tab[(xor(x, y) & 255) + 1]))) % 20 AS k FROM src, crc),
dam AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
  CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM hit, range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM dam),
fault AS (SELECT *, left(role, 1) AS c, regexp_full_match(text, '[\x20\x09-\x0D]*') AS blank,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM num),
row AS (SELECT *, blank OR again AS gone, CASE WHEN cut THEN 5 ELSE 0 END AS more FROM fault),
dp(conv_id, i, s0, s1, s2, s3) AS (
  SELECT DISTINCT conv_id, 1::BIGINT, {'c': 0::BIGINT, 'a': '', 't': ''}, {'c': NULL::BIGINT, 'a': '', 't': ''},
    {'c': NULL::BIGINT, 'a': '', 't': ''}, {'c': NULL::BIGINT, 'a': '', 't': ''} FROM conversations
  UNION ALL
  SELECT conv_id, i + 1,
    {'c': s0.c + 2, 'a': s0.a || 'D', 't': s0.t},
    list_sort(list_filter([{'c': s1.c + 2, 'a': s1.a || 'D', 't': s1.t},
      {'c': CASE WHEN NOT gone AND c = 's' THEN s0.c + more END, 'a': s0.a || 'K', 't': s0.t || role || ':' || text || chr(10)}], lambda x: x.c IS NOT NULL))[1],
    list_sort(list_filter([{'c': n2.c + 2, 'a': n2.a || 'D', 't': n2.t}] || list_transform([s0, s1, n3], lambda s:
      {'c': CASE WHEN NOT gone THEN s.c + more + CASE WHEN c = 'u' THEN 0 ELSE 1 END END, 'a': s.a || CASE WHEN c = 'u' THEN 'K' ELSE 'R' END,
       't': s.t || CASE WHEN c = 'u' THEN role ELSE 'user' END || ':' || text || chr(10)}), lambda x: x.c IS NOT NULL))[1],
    list_sort(list_filter([{'c': n3.c + 2, 'a': n3.a || 'D', 't': n3.t},
      {'c': CASE WHEN NOT gone THEN n2.c + more + CASE WHEN c = 'a' THEN 0 ELSE 1 END END, 'a': n2.a || CASE WHEN c = 'a' THEN 'K' ELSE 'R' END,
       't': n2.t || CASE WHEN c = 'a' THEN role ELSE 'assistant' END || ':' || text || chr(10)}], lambda x: x.c IS NOT NULL))[1]
  FROM (SELECT *, list_sort(list_filter([s3, {'c': n2.c + 5, 'a': n2.a || 'I', 't': n2.t || 'assistant:' || chr(10)}], lambda x: x.c IS NOT NULL))[1] AS n3
    FROM (SELECT r.*, s0, s1, s3, list_sort(list_filter([s2] || list_transform([s0, s1, s3], lambda s: {'c': s.c + 5, 'a': s.a || 'I', 't': s.t || 'user:' || chr(10)}),
      lambda x: x.c IS NOT NULL))[1] AS n2 FROM dp JOIN row r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i))),
fin AS (SELECT conv_id, list_sort(list_filter([s0, s3, {'c': s2.c + 5, 'a': s2.a || 'I', 't': s2.t || 'assistant:' || chr(10)},
  {'c': s1.c + 10, 'a': s1.a || 'II', 't': s1.t || 'user:' || chr(10) || 'assistant:' || chr(10)}], lambda x: x.c IS NOT NULL))[1] AS best
  FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
agg AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
  count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT gone) AS truncated,
  count(*) FILTER (prev || c NOT IN ('su', 'ua', 'au')) AS illegal FROM row GROUP BY 1)
SELECT fin.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c AS cost, best.a AS audit,
  sha256(left(best.t, greatest(length(best.t) - 1, 0))) AS repaired_sha256
FROM fin LEFT JOIN agg ON agg.conv_id IS NOT DISTINCT FROM fin.conv_id
""")
def conversation_repair(spark, sf_dir):
    """Damage all conversations as the contract says, then audit and repair them."""
    return repair_digests(damage(table(spark, sf_dir, "conversations"))).withColumnRenamed("conv", "conv_id")
