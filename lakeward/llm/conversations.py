"""Conversation structure repair by Wagner-Fischer target alignment.

A repaired conversation is empty or an optional system turn and then turns of
user and assistant in pairs.  Turns are aligned to every feasible length of
that grammar string: what is left of a target is the same alternating string
for all lengths, so one table over (turns left, target left) serves them all.
Ukkonen's band, as wide as the cost of a first repair allows, bounds it.
Audits of the cheapest lengths are backtraced and compared.

A conversation longer than a piece is aligned piece by piece from every state
of the grammar to every other; pieces are composed like matrices, so that its
turns may lie in any number of tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeward.functions.keyed import null_safe_join, packed_join
from lakeward.llm.common import SPACE_CHARS, free_name
from lakeward.session import materialize

# Fixed values of the contract: prices of edits, legal neighbours and closing marks.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LEGAL = ("su", "ua", "au")
CLOSING = ".!?"
# end of fixed values

PIECE_TURNS, PIECE_BYTES = 128, 4 << 20  # of turns that are aligned at once, of texts in one record
FAN_IN = 64  # partitions whose parts of a conversation one step composes
BEGIN, SYSTEM, USER, ASSISTANT = range(4)  # states: nothing yet, or the last turn's role
FORCED = "x"


# --- alignment of one piece -----------------------------------------------------
# A turn is one character: x must be deleted; else its role's initial (o for
# any other role), in upper case when it is truncated.

def _kept(turn: str, role: str) -> int:
    """Price of a turn that stands for ``role``."""
    return (0 if turn.lower() == role else REROLE) + (TRUNCATED if turn.isupper() else 0)


def _incumbent(turns: str) -> int:
    """Price of a first repair: forced turns go, the others take the role that
    is next.  No entry or exit state costs more than four inserts beyond it."""
    cost, role = 0, "u"
    for t in turns:
        if t == FORCED:
            cost += DELETE
        else:
            cost += _kept(t, role)
            role = "a" if role == "u" else "u"
    return cost + 4 * INSERT


class Alignment:
    """cost(i, k): of aligning turns i.. to the last k roles of a string that
    alternates and ends with ``last``; infinite outside the band."""

    def __init__(self, turns: str, last: str, limit: int):
        self.turns, self.n, self.limit = turns, len(turns), limit
        self.roles = (last, "u" if last == "a" else "a")
        self.rows: list[tuple[int, list[float]]] = [(0, [])] * (self.n + 1)
        lo, hi = self.band(self.n)
        self.rows[self.n] = lo, [INSERT * k for k in range(lo, hi + 1)]
        for i in range(self.n - 1, -1, -1):
            lo, hi = self.band(i)
            row: list[float] = []
            t = turns[i]
            price = (float("inf"),) * 2 if t == FORCED else (_kept(t, self.roles[0]), _kept(t, self.roles[1]))
            before = self.cost
            best = float("inf")
            for k in range(lo, hi + 1):
                best = min(best + INSERT, before(i + 1, k) + DELETE)
                if k:
                    best = min(best, before(i + 1, k - 1) + price[(k - 1) & 1])
                row.append(best)
            self.rows[i] = lo, row

    def band(self, i: int) -> tuple[int, int]:
        """Target lengths that the limit's deletions and insertions can reach."""
        left = self.n - i
        return max(0, left - self.limit // DELETE), left + self.limit // INSERT

    def cost(self, i: int, k: int) -> float:
        lo, row = self.rows[i]
        return row[k - lo] if 0 <= k - lo < len(row) else float("inf")

    def lengths(self, i: int, odd: int, least: int = 0) -> Iterator[tuple[float, int]]:
        lo, row = self.rows[i]
        for j, c in enumerate(row):
            if (lo + j) & 1 == odd and lo + j >= least:
                yield c, lo + j

    def audit(self, i: int, k: int) -> str:
        """The cheapest edits of the least letters."""
        out = []
        while i < self.n or k:
            c = self.cost(i, k)
            if i < self.n and c == self.cost(i + 1, k) + DELETE:
                out.append("D")
                i += 1
            elif k and c == self.cost(i, k - 1) + INSERT:
                out.append("I")
                k -= 1
            else:
                out.append("K" if self.turns[i].lower() == self.roles[(k - 1) & 1] else "R")
                i, k = i + 1, k - 1
        return "".join(out)


Path = tuple[int, str] | None


def _cheapest(options: list[tuple[float, str, Alignment, int, int]]) -> Path:
    """Of (cost, edits before, table, i, k) the least cost, then the least audit."""
    least = min((o[0] for o in options), default=float("inf"))
    if least == float("inf"):
        return None
    return int(least), min(head + table.audit(i, k) for cost, head, table, i, k in options if cost == least)


def _from_begin(table: Alignment, odd: int, least: int) -> Path:
    turns = table.turns
    options = [(c, "", table, 0, k) for c, k in table.lengths(0, odd, least)]
    for r, t in enumerate(turns[:table.limit // DELETE + 1]):
        if t in "sS":
            head = DELETE * r + _kept(t, "s")
            options += [(head + c, "D" * r + "K", table, r + 1, k) for c, k in table.lengths(r + 1, odd, least)]
    return _cheapest(options)


@lru_cache(maxsize=20_000)
def repair(turns: str) -> tuple[int, str]:
    """Least price and audit of a whole conversation."""
    table = Alignment(turns, "a", _incumbent(turns))
    whole = _from_begin(table, 0, 2)
    return min((DELETE * len(turns), "D" * len(turns)), whole or (float("inf"), ""))


@lru_cache(maxsize=2_000)
def transitions(turns: str) -> tuple[Path, ...]:
    """Cheapest path of a piece from every state to every state, row by row."""
    n, limit = len(turns), _incumbent(turns)
    to = {"a": Alignment(turns, "a", limit), "u": Alignment(turns, "u", limit)}

    def run(last, odd, least=0):
        return _cheapest([(c, "", to[last], 0, k) for c, k in to[last].lengths(0, odd, least)])

    gone = (DELETE * n, "D" * n)
    system = min(((DELETE * (n - 1) + _kept(t, "s"), "D" * r + "K" + "D" * (n - 1 - r)) for r, t in enumerate(turns) if t in "sS"), default=None)
    after_u = run("u", 1)
    return (gone, system, _from_begin(to["u"], 1, 1), _from_begin(to["a"], 0, 2),
            None, gone, after_u, run("a", 0, 2),
            None, None, run("u", 0), run("a", 1),
            None, None, after_u, run("a", 0))


def compose(x: tuple[Path, ...], y: tuple[Path, ...]) -> tuple[Path, ...]:
    """Paths through two neighbouring parts.  Of two paths of equal price and
    ends none starts with the other (more edits cost more), so least audits
    of the parts make the least audit of the whole."""
    out: list[Path] = []
    for p in range(4):
        for q in range(4):
            ways = [(a[0] + b[0], a[1], b[1]) for m in range(4) if (a := x[4 * p + m]) and (b := y[4 * m + q])]
            least = min((w[0] for w in ways), default=None)
            out.append(None if least is None else (least, min(a + b for c, a, b in ways if c == least)))
    return tuple(out)


def accepted(paths: tuple[Path, ...]) -> tuple[int, str]:
    return min(p for p in (paths[BEGIN], paths[ASSISTANT]) if p)


class Repaired:
    """Applies an audit to turns that come one after the other."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place = audit, 0, 0
        self.odd = (len(audit) - audit.count("D")) & 1

    def _role(self) -> str:
        return "user" if (self.place - self.odd) & 1 == 0 else "assistant"

    def inserted(self) -> Iterator[str]:
        """Turns that stand before the next one."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield self._role() + ":"
            self.at, self.place = self.at + 1, self.place + 1

    def turn(self, role: str | None, text: str | None) -> Iterator[str]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield f"{role if edit == 'K' else self._role()}:{text}"
            self.place += 1


# --- parts of conversations -----------------------------------------------------

def _part(rows: list[tuple]) -> dict:
    """Counts and paths of consecutive (turn, role, text, blank, duplicate, truncated)."""
    initials = [(r[1] or "")[:1] for r in rows]
    letters = "".join(FORCED if r[3] or r[4] else (c if c in ("s", "u", "a") else "o").upper() if r[5] else c if c in ("s", "u", "a") else "o"
                      for r, c in zip(rows, initials))
    turns = [r[0] for r in rows if r[0] is not None]
    return {"blank": sum(r[3] for r in rows), "duplicate": sum(r[4] for r in rows), "truncated": sum(r[5] for r in rows),
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "first_role": initials[0], "last_role": initials[-1],
            "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
            "turns": sum(a != b for a, b in zip(turns, turns[1:])) + bool(turns), "letters": letters}


def _joined(x: dict, y: dict) -> dict:
    out = {k: x[k] + y[k] for k in ("blank", "duplicate", "truncated")}
    out["illegal"] = x["illegal"] + y["illegal"] + (x["last_role"] + y["first_role"] not in LEGAL)
    out["turns"] = x["turns"] + y["turns"] - (x["last_turn"] is not None and x["last_turn"] == y["first_turn"])
    out |= {"first_role": x["first_role"], "last_role": y["last_role"], "paths": compose(x["paths"], y["paths"]),
            "first_turn": y["first_turn"] if x["first_turn"] is None else x["first_turn"],
            "last_turn": x["last_turn"] if y["last_turn"] is None else y["last_turn"]}
    return out


class Run:
    """Parts of one conversation in order, composed in pairs of like length."""

    def __init__(self):
        self.parts: list[tuple[int, dict]] = []

    def add(self, part: dict) -> None:
        size = 1
        while self.parts and self.parts[-1][0] <= size:
            n, before = self.parts.pop()
            part, size = _joined(before, part), size + n
        self.parts.append((size, part))

    def whole(self) -> dict:
        part = self.parts.pop()[1]
        while self.parts:
            part = _joined(self.parts.pop()[1], part)
        return part


def _gaps(part: dict) -> int:
    return 0 if part["first_turn"] is None else part["last_turn"] - part["first_turn"] + 1 - part["turns"]


def _digest(lines: Iterator[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


COUNTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint"
RESULT = f"gaps bigint, {COUNTS}, cost bigint, audit string, repaired_sha256 string"
PATHS = "first_role string, last_role string, first_turn bigint, last_turn bigint, turns bigint, costs array<bigint>, audits array<string>"
# a conversation that lies inside one task has its result; of the others a part per task, and the turns in records
PIECES = f"kind string, part int, seq bigint, {RESULT}, {PATHS}, roles array<string>, texts array<string>"


def _result(part: dict, cost: int, audit: str) -> dict:
    return {k: part[k] for k in ("blank", "duplicate", "truncated", "illegal")} | {"gaps": _gaps(part), "cost": cost, "audit": audit}


def _packed(part: dict) -> dict:
    flat = {k: part[k] for k in ("blank", "duplicate", "truncated", "illegal", "first_role", "last_role", "first_turn", "last_turn", "turns")}
    return flat | {"costs": [p and p[0] for p in part["paths"]], "audits": [p and p[1] for p in part["paths"]]}


def _unpacked(row: dict) -> dict:
    return row | {"paths": tuple(None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"]))}


class _Sink:
    """Rows gathered into Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.held = schema, [], 0

    def put(self, row: dict, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.held += 200 + size
        if self.held > PIECE_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_pylist([{f: r.get(f) for f in self.schema.names} for r in self.rows], self.schema)
        self.rows, self.held = [], 0


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _pieces(schema: T.StructType, piece_turns: int):
    """Reads turns in order (conversation, turn, role, text, digest, blank,
    duplicate, truncated) and yields results and parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, part_id = _Sink(_arrow(schema)), TaskContext.get().partitionId()
        conv, edge, rows, held, whole, seq, last = None, True, [], 0, Run(), 0, None

        def record():
            nonlocal rows, held, seq
            part = _part(rows)
            whole.add(part | {"paths": transitions(part["letters"])})
            row = {"conv": conv, "kind": "turns", "part": part_id, "seq": seq, "roles": [r[1] for r in rows], "texts": [None if r[3] or r[4] else r[2] for r in rows]}
            out = list(sink.put(row, held))
            rows, held, seq = [], 0, seq + 1
            return out

        def end():
            nonlocal rows, held, seq, whole
            if not edge and not whole.parts:
                part = _part(rows)
                cost, audit = repair(part["letters"])
                fix = Repaired(audit)
                lines = [x for r in rows for x in fix.turn(r[1], r[2])] + list(fix.inserted())
                out = list(sink.put({"conv": conv, "kind": "whole"} | _result(part, cost, audit) | {"repaired_sha256": _digest(lines)}, len(audit)))
            else:
                out = record() if rows else []
                out += sink.put({"conv": conv, "kind": "part", "part": part_id} | _packed(whole.whole()), 16 * seq * PIECE_TURNS)
            rows, held, seq, whole = [], 0, 0, Run()
            return out

        started = False
        for batch in batches:
            for c, turn, role, text, digest, blank, dup, cut in zip(*(col.to_pylist() for col in batch.columns)):
                if started and c != conv:
                    yield from end()
                    edge, last = False, None
                if not started or c != conv:
                    conv, started = c, True
                key = (turn, role, digest)
                dup = not blank and (dup or key == last)  # equal turns stand side by side
                rows.append((turn, role, text, blank, dup, cut and not dup))
                held += len(text or "")
                last = key
                if len(rows) >= piece_turns or held >= PIECE_BYTES:
                    yield from record()
        if started:
            edge = True
            yield from end()
        yield from sink.flush()
    return run


def _composed(schema: T.StructType):
    """Parts of one conversation in a row of partitions as one part."""
    arrow = _arrow(schema)

    def run(table: pa.Table) -> pa.Table:
        whole = Run()
        found = sorted(table.to_pylist(), key=lambda r: r["part"])
        for r in found:
            whole.add(_unpacked(r))
        return pa.Table.from_pylist([{"conv": found[0]["conv"], "part": found[0]["node"]} | _packed(whole.whole())], arrow)
    return run


def _decided(schema: T.StructType):
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                part = _unpacked(r)
                out.append({"conv": r["conv"]} | _result(part, *accepted(part["paths"])))
            yield pa.RecordBatch.from_pylist([{f: r.get(f) for f in arrow.names} for r in out], arrow)
    return run


def _hashed(schema: T.StructType):
    """Reads per conversation its audit, then its turns in order, and hashes
    the repaired lines as they come; holds one record."""
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, conv, fix, sha, lines = _Sink(arrow), None, None, None, 0

        def write(found):
            nonlocal lines
            for line in found:
                sha.update((("\n" if lines else "") + line).encode())
                lines += 1

        def end():
            write(fix.inserted())
            return list(sink.put({"conv": conv, "repaired_sha256": sha.hexdigest()}))

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] < 0:
                    if fix is not None:
                        yield from end()
                    conv, fix, sha, lines = row["conv"], Repaired(row["audit"]), hashlib.sha256(), 0
                else:
                    for role, text in zip(row["roles"], row["texts"]):
                        write(fix.turn(role, text))
        if fix is not None:
            yield from end()
        yield from sink.flush()
    return run


# --- operator -------------------------------------------------------------------

def damage(rows: DataFrame) -> DataFrame:
    """Planted faults, by crc32 of ``conv_id:turn`` (null: one space) modulo
    20: 0 drops a turn, 1 empties its text, 2 removes its closing marks, 3
    repeats it, 4 gives it the role user."""
    def name(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    hurt = free_name(rows.columns, "_hurt")
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    return (rows.withColumn(hurt, kind).filter(F.col(hurt) != 0)
            .withColumn("text", F.when(F.col(hurt) == 1, "").when(F.col(hurt) == 2, F.translate("text", CLOSING, "")).otherwise(F.col("text")))
            .withColumn("role", F.when(F.col(hurt) == 4, "user").otherwise(F.col("role")))
            .withColumn(hurt, F.explode(F.when(F.col(hurt) == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop(hurt))


def _faults(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, digest, blank, duplicate (of an earlier turn
    than this), truncated."""
    stripped = F.rtrim(F.col("text"), F.lit(SPACE_CHARS))
    told = rows.select("conv", "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("digest"),
                       F.coalesce(F.length(stripped) == 0, F.lit(True)).alias("blank"),
                       (~F.coalesce(F.substring(stripped, -1, 1).isin(*CLOSING), F.lit(False))).alias("cut"))
    first = told.filter("not blank").groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("_first"))
    met = packed_join(told, first.select(F.col("conv").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "_first"),
                      ["conv", "role", "digest"], ["_c", "_r", "_d"], "left", null_safe=True)
    later = F.coalesce(~F.col("blank") & (F.struct("turn") > F.col("_first")), F.lit(False))
    return met.select("conv", "turn", "role", "text", "digest", "blank", later.alias("dup"), (F.col("cut") & ~F.col("blank")).alias("cut"))


def _schema(conv: T.StructField, ddl: str) -> T.StructType:
    return T.StructType([T.StructField("conv", conv.dataType), *T.StructType.fromDDL(ddl).fields])


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", piece_turns: int = PIECE_TURNS) -> DataFrame:
    """Per conversation: ``conv_col``, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256 (of the repaired ``role:text`` lines).

    Turns are taken by turn, nulls first; turns of equal number by role and
    then by the SHA-256 of their text.  A null conversation id is a
    conversation of its own; a null text is blank; a null role, or one that
    starts with another letter than s, u and a, can only be changed or
    deleted; equal rows are duplicates of each other; an empty table gives an
    empty result; other columns don't matter, whatever their names.

    Duplicates are found by the first turn per role and text, a partial
    aggregate that is joined back.  Turns are then sorted by range, so that a
    conversation of any length is spread over tasks: pieces of ``piece_turns``
    turns are aligned for themselves and composed in their task, then
    FAN_IN partitions at a time.  Only the audit, which is one value of the
    result, and the hash, which reads the repaired lines of one conversation in
    order, see it whole; the hash holds one record at a time."""
    conv = rows.schema[conv_col]
    taken = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                        F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    order = ["conv", "turn", "role", "digest"]
    sorted_rows = _faults(taken).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = _schema(conv, PIECES)
    pieces = materialize(sorted_rows.mapInArrow(_pieces(schema, piece_turns), schema), "pieces")

    parts_schema = _schema(conv, f"part int, {COUNTS}, {PATHS}")
    parts = pieces.filter("kind = 'part'").select(*parts_schema.names)
    reach = pieces.agg(F.max("part")).first()[0]
    while True:
        node = F.floor(F.col("part") / FAN_IN).cast("int")
        parts = parts.withColumn("node", node).groupBy("conv", "node").applyInArrow(_composed(parts_schema), parts_schema)
        reach = (reach or 0) // FAN_IN
        if not reach:
            break
        parts = materialize(parts, "composed")
    decided_schema = _schema(conv, f"gaps bigint, {COUNTS}, cost bigint, audit string")
    decided = materialize(parts.mapInArrow(_decided(decided_schema), decided_schema), "decided")

    turns = pieces.filter("kind = 'turns'").select("conv", "part", "seq", "roles", "texts", F.lit(None).cast("string").alias("audit"))
    audits = decided.select("conv", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("array<string>").alias("roles"),
                            F.lit(None).cast("array<string>").alias("texts"), "audit")
    hash_schema = _schema(conv, "repaired_sha256 string")
    hashed = (turns.unionByName(audits).repartition("conv").sortWithinPartitions("conv", "part", "seq")
              .mapInArrow(_hashed(hash_schema), hash_schema))
    columns = T.StructType.fromDDL(RESULT).names
    split = null_safe_join(decided, hashed, ["conv"], "inner").select("conv", *columns)
    return pieces.filter("kind = 'whole'").select("conv", *columns).unionByName(split).withColumnRenamed("conv", conv_col)


def repaired_or_empty(ids: DataFrame, repaired: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``repaired`` with a row of zeros for every id that has no turns left."""
    out = null_safe_join(ids.select(conv_col).distinct(), repaired, [conv_col], "left")
    empty = hashlib.sha256(b"").hexdigest()

    def filled(f: T.StructField) -> Column:
        return F.coalesce(F.col(f.name), F.lit({"audit": "", "repaired_sha256": empty}.get(f.name, 0)).cast(f.dataType)).alias(f.name)

    return out.select(conv_col, *[filled(f) for f in T.StructType.fromDDL(RESULT).fields])
