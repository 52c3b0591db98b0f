"""Repair of conversation structure by whole numbers as weights.

A repair keeps (0), reroles (2) or deletes (3) each row and inserts empty turns (2) anywhere, such that the initials of the roles
that stay give `(s?(ua)+)?`; blank and duplicate rows must go, truncated ones that stay add 1. Its audit is the initials of its
edits in order. A weight is one whole number: high digits hold the cost, low digits of a fixed width the audit's letters, first
letter first, with zeros after the last one. The letters' digits are in ASCII order (D, I, K, R), so the least number is the cheapest
repair with the least audit, and plain minima over the DAG of (row, state) decide everything.

Inserts are put right before the letter of a row or at the end, so audits that end at one row all end with a row's letter: none
begins another, and their order is settled there. So after each BLOCK rows the letters so far are told by their rank among the
states, one digit, and numbers stay as short as a block whatever the conversation's length. The letters themselves are kept as
pieces that states share.

Rows come to a task sorted by conversation and turn, and pass through it once: each state carries the running SHA-256 of its repair,
so no task holds a conversation. The hash runs over a conversation from its first byte to its last, which is why one isn't dealt to
several tasks. What grows with it is its audit, a value of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
BLOCK = 64

#: Digits of an audit's letters, in ASCII order; zero is the end.
LETTERS = ".DIKR"
DIGIT = {c: i for i, c in enumerate(LETTERS)}
#: Bits of a digit. A row has three letters at most (two inserts and its own); one digit is the rank, two are for inserts at the end.
BITS = 3
WIDTH = 1 + 3 * BLOCK + 2

#: States by the initials so far: none, s, ..u, ..a. The role each wants next; the letters with which each may end the repair.
START, SYSTEM, USER, ASSISTANT = range(4)
WANTED = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
ENDS = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
SPACE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}

RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def fault(text: str, duplicate: bool) -> str | None:
    """A row's first fault."""
    said = text.rstrip(SPACE)
    if not said:
        return "blank"
    if duplicate:
        return "duplicate"
    return None if said[-1] in ".!?" else "truncated"


class Way:
    """The best repair that ends in one state: its weight, the length of the letters in it, earlier pieces of the audit, and the hash."""

    __slots__ = ("hash", "length", "pieces", "weight")

    def __init__(self, weight: int, length: int, pieces: tuple | None, digest):
        self.weight, self.length, self.pieces, self.hash = weight, length, pieces, digest


def put(weight: int, length: int, letters: str, cost: int) -> int:
    """weight with letters after the first `length` ones, and cost."""
    for c in letters:
        length += 1
        weight += DIGIT[c] << (BITS * (WIDTH - length))
    return weight + (cost << (BITS * WIDTH))


def letters_of(weight: int, length: int) -> str:
    """The letters in the low digits but the first, which is the rank."""
    return "".join(LETTERS[weight >> (BITS * (WIDTH - k)) & 7] for k in range(2, length + 1))


class Repair:
    """One conversation: rows are given in order, `result` ends it."""

    def __init__(self):
        self.ways = {START: Way(0, 1, None, None)}
        self.rows = 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.before = 0, None

    def add(self, role: str, text: str, duplicate: bool) -> None:
        found = fault(text, duplicate)
        if found:
            self.counts[found] += 1
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in LEGAL
        self.before = initial
        if self.rows and self.rows % BLOCK == 0:
            self._ranked()
        self.rows += 1
        self._step(role, text, initial, found)

    def _step(self, role: str, text: str, initial: str, found: str | None) -> None:
        gone, cost = found in ("blank", "duplicate"), TRUNCATED if found == "truncated" else 0
        best: dict[int, tuple[int, int, int, list[str]]] = {}

        def offer(state: int, weight: int, length: int, source: int, turns: list[str]) -> None:
            if state not in best or weight < best[state][0]:
                best[state] = (weight, length, source, turns)

        for source, way in self.ways.items():
            weight, length, state, turns = way.weight, way.length, source, []
            for inserts in range(3):
                if inserts:
                    wanted, state = WANTED[state]
                    weight, length, turns = put(weight, length, "I", INSERT), length + 1, [*turns, f"{wanted}:"]
                offer(state, put(weight, length, "D", DELETE), length + 1, source, turns)
                if gone:
                    continue
                wanted, after = WANTED[state]
                if initial == wanted[0]:
                    offer(after, put(weight, length, "K", KEEP + cost), length + 1, source, [*turns, f"{role}:{text}"])
                elif initial == "s" and state == START:
                    offer(SYSTEM, put(weight, length, "K", KEEP + cost), length + 1, source, [*turns, f"{role}:{text}"])
                offer(after, put(weight, length, "R", REROLE + cost), length + 1, source, [*turns, f"{wanted}:{text}"])
        before = self.ways
        self.ways = {state: Way(weight, length, before[source].pieces, hashed(before[source].hash, turns)) for state, (weight, length, source, turns) in best.items()}

    def _ranked(self) -> None:
        """Letters so far become pieces; of each state's the rank stays, as the first digit."""
        mask = (1 << (BITS * WIDTH)) - 1
        order = sorted(self.ways, key=lambda s: self.ways[s].weight & mask)
        for rank, state in enumerate(order):
            way = self.ways[state]
            way.pieces = (way.pieces, letters_of(way.weight, way.length))
            way.weight, way.length = (way.weight >> (BITS * WIDTH) << (BITS * WIDTH)) + (rank << (BITS * (WIDTH - 1))), 1

    def result(self) -> tuple[int, str, str]:
        """Cost, audit and hash of the cheapest repair with the least audit."""
        ends = []
        for state, way in self.ways.items():
            n, turns = ENDS[state], []
            for _ in range(n):
                wanted, state = WANTED[state]
                turns.append(f"{wanted}:")
            ends.append((put(way.weight, way.length, "I" * n, INSERT * n), way.length + n, way, turns))
        weight, length, way, turns = min(ends, key=lambda e: e[0])
        parts, piece = [letters_of(weight, length)], way.pieces
        while piece:
            piece, text = piece
            parts.append(text)
        digest = hashed(way.hash, turns)
        return weight >> (BITS * WIDTH), "".join(reversed(parts)), (digest or hashlib.sha256()).hexdigest()


def hashed(digest, turns: list[str]):
    """digest (None before the first turn), not changed itself, with more turns."""
    for turn in turns:
        first = digest is None
        digest = hashlib.sha256() if first else digest.copy()
        digest.update(turn.encode() if first else b"\n" + turn.encode())
    return digest


def text_or_space(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of rows as damage leaves them, and here: false for rows that it drops, whose role and text are
    null."""
    kind = F.crc32(F.concat(text_or_space("conv_id"), F.lit(":"), text_or_space("turn"))) % 20
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_or_space("role").alias("role"), text_or_space("text").alias("text"), F.explode(F.when(kind == 3, F.array(F.lit(3), F.lit(3))).otherwise(F.array(kind.cast("int")))).alias("kind"))
    kind, here = F.col("kind"), F.col("kind") != 0
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return plain.select("conv_id", "turn", F.when(here, F.when(kind == 4, "user").otherwise(F.col("role"))).alias("role"), F.when(here, text).alias("text"), here.alias("here"))


def repaired(rows: DataFrame) -> DataFrame:
    """RESULT for each conversation of rows (conv_id, turn, role, text, and here: false for rows that only tell that there is such
    a conversation).

    Rows are taken by turn, null turns first, rows of one turn by role and text. A null conversation is one like others. A role
    without letters has no initial, so its row isn't kept as it is. A conversation of no rows has zeros, an empty audit and the hash of
    nothing; an empty table gives an empty one.
    """
    seen = W.partitionBy("conv_id", "role", "text", "here").orderBy(F.col("turn").asc_nulls_first())
    told = rows.select("conv_id", "turn", "role", "text", "here", (F.row_number().over(seen) > 1).alias("duplicate"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "duplicate"]
    sorted_rows = told.repartition("conv_id").sortWithinPartitions(*order)
    out = rows.sparkSession.createDataFrame([], RESULT).schema
    kinds = [pa.string() if f.name in ("audit", "repaired_sha256") else pa.int64() for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair, at, turns, done = None, None, [], []

        def ended() -> None:
            cost, audit, digest = repair.result()
            low, high, distinct = turns or (0, -1, 0)
            c = repair.counts
            done.append((at, high - low + 1 - distinct, c["blank"], c["duplicate"], c["truncated"], repair.illegal, cost, audit, digest))

        for batch in batches:
            for conv, turn, role, text, here, duplicate in zip(*(c.to_pylist() for c in batch.columns)):
                if repair is None or conv != at:
                    if repair is not None:
                        ended()
                    repair, at, turns = Repair(), conv, []
                if not here:
                    continue
                if turn is not None:
                    turns = [turns[0], turn, turns[2] + (turn != turns[1])] if turns else [turn, turn, 1]
                repair.add(role, text, duplicate)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*done), kinds)], names=out.names)
                done.clear()
        if repair is not None:
            ended()
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*done), kinds)], names=out.names)

    return sorted_rows.mapInArrow(run, out)


def damage_and_repair(rows: DataFrame) -> DataFrame:
    """`repaired` of `damaged` conversations: nulls of roles and texts are one space. Other columns, whatever their names, stay out."""
    return repaired(damaged(rows.select("conv_id", "turn", "role", "text")))


def oracle() -> str:
    """The same in DuckDB: checksums by their table, repairs row by row as (cost, audit, text), the least of each state kept."""
    step = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
    crc = "(SELECT list(v ORDER BY n) AS t FROM (SELECT n, " + "list_reduce(list_prepend(n, range(8)), lambda x, y: " + step + ") AS v FROM (SELECT unnest(range(256)) AS n)))"
    wants = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}

    def edges(target: int) -> str:
        """Each way into a state, as a list of (cost, audit, text)."""
        found = []
        for source in range(4):
            state, cost, audit, said = source, 0, "", []
            for inserts in range(3):
                if inserts:
                    role, state = wants[state]
                    cost, audit, said = cost + 2, audit + "I", [*said, f"'{role}:'"]
                role, after = wants[state]
                ways = [(state, "true", f"{cost + 3}", "D", said)]
                ways.append((after, f"f <= 1 AND i = '{role[0]}'", f"{cost} + f", "K", [*said, "role || ':' || text"]))
                ways.append((after, "f <= 1", f"{cost + 2} + f", "R", [*said, f"'{role}:' || text"]))
                if state == 0:
                    ways.append((1, "f <= 1 AND i = 's'", f"{cost} + f", "K", [*said, "role || ':' || text"]))
                for to, where, price, letter, turns in ways:
                    if to == target:
                        text = f"list_concat(s{source}.said, [{', '.join(turns)}])" if turns else f"s{source}.said"
                        found.append(f"CASE WHEN s{source} IS NOT NULL AND {where} THEN {{'cost': s{source}.cost + {price}, 'audit': s{source}.audit || '{audit}{letter}', 'said': {text}}} END")
        return f"list_min([{', '.join(found)}])"

    end = "list_min([" + ", ".join(f"CASE WHEN s{s} IS NOT NULL THEN {{'cost': s{s}.cost + {2 * n}, 'audit': s{s}.audit || '{'I' * n}', 'said': list_concat(s{s}.said, {turns})}} END" for s, n, turns in ((0, 0, "CAST([] AS VARCHAR[])"), (1, 2, "['user:', 'assistant:']"), (2, 1, "['assistant:']"), (3, 0, "CAST([] AS VARCHAR[])"))) + "])"
    kind = "STRUCT(cost BIGINT, audit VARCHAR, said VARCHAR[])"
    none = f"CAST(NULL AS {kind})"
    return f"""WITH RECURSIVE crc AS {crc},
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT o.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda x, y: xor(x // 256, t[1 + xor(x % 256, y)])), 4294967295) % 20 AS d FROM o, crc),
a AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
n AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, left(role, 1) AS i FROM a),
r AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 3 WHEN seen > 1 THEN 2 WHEN regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 0 ELSE 1 END AS f, coalesce(lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i NOT IN ('su', 'ua', 'au'), false) AS ill FROM n),
c AS (SELECT DISTINCT conv_id FROM conversations),
p AS (SELECT conv_id, 0 AS n, CAST({{'cost': 0, 'audit': '', 'said': []}} AS {kind}) AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM c
 UNION ALL SELECT r.conv_id, CAST(r.n AS INTEGER), {', '.join(edges(s) for s in range(4))} FROM p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.n = p.n + 1),
e AS (SELECT conv_id, {end} AS best FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 3) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 1) AS truncated, count(*) FILTER (ill) AS illegal FROM r GROUP BY conv_id)
SELECT e.conv_id AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.cost AS cost, best.audit AS audit, sha256(array_to_string(best.said, chr(10))) AS repaired_sha256
FROM e LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM e.conv_id"""
