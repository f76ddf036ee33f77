"""Repair of conversation structure by a dynamic program over the turns that are retained.

Rows of a conversation stand by turn (nulls first; of one turn by role, then text). A repaired
conversation has role initials (s?(ua)+)?. The program goes over retained rows: a row can be retained
with its own role or as user or assistant, and the cheapest way to retain row i as r is

    deletions before i + cost of r + min over q of (5 * inserts(q, r) + running[q])

where running[q] is the least of (cost of the best way that ends in a row retained as q, less the
deletions up to it) over all earlier rows: prefix sums of deletions price the gap between two retained
rows, and their pair of roles says what has to be inserted there. Among equal costs the least audit
wins (edits' initials in order, D < I < K < R). No audits are compared as strings: of the four states'
audits, none of which begins another, only the order is kept, and a row changes it by rule.

Conversations of any length: rows are sorted by range over all conversations, a long conversation
lies in several *pieces* (CHUNK_ROWS rows, CHUNK_BYTES bytes, or the border of a partition). A piece
that isn't whole tells, for each state it can be entered in and each it can be left in, the least cost
and the order of the audits; these 4 x 4 tables are chained, one small row for each piece, and then
each piece is repaired between its own two states. Only the hash of a long conversation's text goes
over it in one task, piece by piece as they stream in, since SHA-256 has no other way. Whether a row
repeats an earlier role and text is found by an aggregation of digests, joined back.

Nulls: null roles and texts are one space, null conversation ids are one conversation, null turns come
first and count in no gap. Texts are as long as they are; empty ones are blank. Repeated rows are
duplicates. An empty table gives no rows. Further columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.llm.common import materialize

DELETE, INSERT, REROLE, CUT_OFF = 2, 5, 1, 5
#: Of a piece of a conversation, and of text in a partition.
CHUNK_ROWS, CHUNK_BYTES = 1 << 14, 4 << 20
PART_BYTES = 64 << 20

NONE, SYSTEM, USER, ASSISTANT = range(4)
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Pairs of neighbouring initials that are in order.
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
#: What stands between a row retained as the first and one retained as the second.
BETWEEN = {(q, r): [] for q, r in ((NONE, SYSTEM), (NONE, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))}
BETWEEN |= {(q, ASSISTANT): ["user"] for q in (NONE, SYSTEM, ASSISTANT)} | {(USER, USER): ["assistant"]}
#: What comes after the last retained row.
AFTER = {NONE: [], SYSTEM: ["user", "assistant"], USER: ["assistant"], ASSISTANT: []}
#: Ways into each state.
INTO = {r: [(q, INSERT * len(between)) for (q, into), between in BETWEEN.items() if into == r] for r in (SYSTEM, USER, ASSISTANT)}
#: Of two audits with one beginning, what goes on first.
ONWARD = {"D": 0, "IK": 1, "IR": 2, "K": 3, "R": 4}
INF = math.inf

#: Faults of a row, the first that holds.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)


def forward(rows, entry: int):
    """The dynamic program over rows (initial, fault), entered in a state.

    Gives the costs and the order of the audits of the four states after the last row (INF: not
    reachable), and for each row and state the state before it (-1: the row is deleted).
    """
    running, order = [INF] * 4, [0] * 4
    running[entry] = 0
    steps, gap = [], 0
    for initial, fault in rows:
        if fault in (BLANK, DUPLICATE):
            steps.append(None)
            gap += DELETE
            continue
        own = STATE.get(initial)
        step, new = [-1] * 4, running[:]
        place = [(order[q], ONWARD["D"]) for q in range(4)]
        for r in (SYSTEM, USER, ASSISTANT) if own == SYSTEM else (USER, ASSISTANT):
            kept = r == own
            extra = (0 if kept else REROLE) + (CUT_OFF if fault == TRUNCATED else 0) - DELETE
            best, of = INF, 0
            for q, inserts in INTO[r]:
                cost = running[q] + inserts
                if cost < best or (cost == best < INF and order[q] < order[of]):
                    best, of = cost, q
            best += extra
            if best < running[r] or (best == running[r] < INF and of != r and order[of] < order[r]):
                new[r], step[r] = best, of
                place[r] = (order[of], ONWARD["I" * len(BETWEEN[of, r]) + ("K" if kept else "R")])
        if step != [-1] * 4:
            ranks = {x: k for k, x in enumerate(sorted({place[q] for q in range(4) if new[q] < INF}))}
            order = [ranks.get(p, 0) for p in place]
            running = new
        steps.append(step)
        gap += DELETE
    return [x + gap for x in running], order, steps


def backward(rows, steps, state: int):
    """The audit of rows (role, text, initial) that leads to a state, and the repaired rows as role:text."""
    audit, out = [], []
    for (role, text, initial), step in zip(reversed(rows), reversed(steps)):
        before = -1 if step is None else step[state]
        if before < 0:
            audit.append("D")
            continue
        kept = STATE.get(initial) == state
        audit.append("K" if kept else "R")
        out.append(f"{role if kept else ROLE[state]}:{text}")
        for x in reversed(BETWEEN[before, state]):
            audit.append("I")
            out.append(f"{x}:")
        state = before
    return "".join(reversed(audit)), out[::-1]


def last_state(costs, order) -> int:
    return min((q for q in range(4) if costs[q] < INF), key=lambda q: (costs[q] + INSERT * len(AFTER[q]), order[q]))


def ending(state: int) -> tuple[str, list[str]]:
    return "I" * len(AFTER[state]), [f"{x}:" for x in AFTER[state]]


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text, live, copies: the rows after the audit's damage. A dropped row stays as one that isn't live."""
    key = F.concat(F.coalesce(F.col(conv).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn).cast("string"), F.lit(" ")))
    kind = F.crc32(key) % 20
    said = F.coalesce(F.col(text), F.lit(" "))
    said = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said)
    base = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.when(kind == 4, F.lit("user")).otherwise(F.coalesce(F.col(role), F.lit(" "))).alias("role"), said.alias("text"), (kind != 0).alias("live"), F.when(kind == 3, F.lit(2)).otherwise(F.lit(1)).alias("copies"))
    gone = ~F.col("live")
    return base.select("conv", F.when(~gone, F.col("turn")).alias("turn"), *[F.when(gone, F.lit("")).otherwise(F.col(c)).alias(c) for c in ("role", "text")], "live", "copies")


def marked(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text, live, copies) with blank, cut_off and repeated (seen in an earlier turn of the conversation)."""
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    rows = rows.withColumn("digest", F.unhex(digest))
    seen = rows.where("live").groupBy(F.col("conv").alias("c"), F.col("digest").alias("d")).agg(F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("untimed"), F.count("*").alias("n"))
    seen = seen.where("n > 1").drop("n")  # by row: two of one turn are neighbours in the order, and told there
    joined = rows.join(seen, F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    earlier = F.when(F.col("turn").isNull(), F.lit(False)).otherwise(F.coalesce(F.col("untimed") | (F.col("first") < F.col("turn")), F.lit(False)))
    return joined.select("conv", "turn", "role", "text", "live", "copies", (~F.col("text").rlike("[^\\x20\\x09-\\x0D]")).alias("blank"), (~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")).alias("cut_off"), earlier.alias("repeated"))


COUNTED = ("blank", "duplicate", "truncated", "illegal")
#: A whole conversation has its result, a piece of a longer one its rows and its table.
PIECES = (
    "conv {conv}, open boolean, part int, seq int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, "
    "roles array<string>, texts array<string>, faults array<int>, costs array<int>, orders array<int>, first_turn {turn}, last_turn {turn}, turns long, first_initial string, last_initial string"
)


class Piece:
    """Consecutive rows of a conversation."""

    def __init__(self):
        self.rows, self.faults, self.bytes = [], [], 0
        self.first_turn = self.last_turn = None
        self.turns = 0

    def add(self, turn, role: str, text: str, fault: int) -> None:
        self.rows.append((role, text, role[:1]))
        self.faults.append(fault)
        self.bytes += len(role) + len(text)
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
            self.turns += 1

    def counts(self) -> dict:
        initials = [x for _, _, x in self.rows]
        out = {name: self.faults.count(fault) for name, fault in zip(COUNTED, (BLANK, DUPLICATE, TRUNCATED))}
        return out | {"illegal": sum(pair not in LEGAL for pair in zip(initials, initials[1:]))}

    def tagged(self):
        return [(x, f) for (_, _, x), f in zip(self.rows, self.faults)]

    def whole(self) -> dict:
        costs, order, steps = forward(self.tagged(), NONE)
        end = last_state(costs, order)
        audit, out = backward(self.rows, steps, end)
        more, tail = ending(end)
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        digest = hashlib.sha256("\n".join(out + tail).encode()).hexdigest()
        return self.counts() | {"gaps": gaps, "cost": costs[end] + INSERT * len(AFTER[end]), "audit": audit + more, "repaired_sha256": digest}

    def table(self) -> dict:
        costs, orders = [], []
        for entry in range(4):
            c, o, _ = forward(self.tagged(), entry)
            costs += [-1 if x == INF else int(x) for x in c]
            orders += o
        return self.counts() | {
            "roles": [r for r, _, _ in self.rows], "texts": [t for _, t, _ in self.rows], "faults": self.faults, "costs": costs, "orders": orders,
            "first_turn": self.first_turn, "last_turn": self.last_turn, "turns": self.turns,
            "first_initial": self.rows[0][2] if self.rows else None, "last_initial": self.rows[-1][2] if self.rows else None,
        }


def pieces(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES, parts: int | None = None) -> DataFrame:
    """PIECES of the marked rows: conversations that lie within one partition and piece are whole."""
    spark = rows.sparkSession
    if parts is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PART_BYTES))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = PIECES.format(conv=rows.schema["conv"].dataType.simpleString(), turn=rows.schema["turn"].dataType.simpleString())
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        piece, conv, before, fresh, empty = None, None, None, False, True  # fresh: the piece begins its conversation
        done: list[dict] = []
        types = None

        def close(over: bool) -> None:
            nonlocal seq
            if fresh and over:
                done.append({"conv": conv, "open": False, "part": part, "seq": seq} | piece.whole())
            else:
                done.append({"conv": conv, "open": True, "part": part, "seq": seq} | piece.table())
            seq += 1

        def told():
            columns = [pa.array([d.get(n) for d in done], t) for n, t in zip(names, types)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            if types is None:
                numbers = pa.int64()
                fixed = {"open": pa.bool_(), "part": pa.int32(), "seq": pa.int32(), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()), "faults": pa.list_(pa.int32()), "costs": pa.list_(pa.int32()), "orders": pa.list_(pa.int32())}
                fixed |= dict.fromkeys(("audit", "repaired_sha256", "first_initial", "last_initial"), pa.string())
                fixed |= {"conv": batch.schema.field("conv").type} | dict.fromkeys(("first_turn", "last_turn"), batch.schema.field("turn").type)
                types = [fixed.get(n, numbers) for n in names]
            held = 0
            for c, turn, role, text, live, copies, blank, cut_off, repeated in zip(*[batch.column(n).to_pylist() for n in ("conv", "turn", "role", "text", "live", "copies", "blank", "cut_off", "repeated")]):
                if empty or c != conv:
                    if piece is not None:
                        close(True)
                    piece, conv, before, fresh, empty = Piece(), c, None, not empty, False
                elif len(piece.rows) >= chunk_rows or piece.bytes >= chunk_bytes:
                    close(False)
                    held += piece.bytes
                    piece, fresh = Piece(), False
                    if held > chunk_bytes:
                        yield told()
                        held = 0
                if not live:
                    continue
                again = before == (turn, role, text)
                before = (turn, role, text)
                for k in range(copies):
                    piece.add(turn, role, text, BLANK if blank else DUPLICATE if repeated or again or k else TRUNCATED if cut_off else FINE)
            if done:
                yield told()
        if piece is not None:
            close(False)  # the next partition may go on with it
            yield told()

    return ranged.mapInArrow(run, schema)


def chained(key, table):
    """Of the pieces of one conversation: the states each is entered and left in, and the conversation's numbers."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"]))
    costs, order = [0, INF, INF, INF], [0] * 4
    ways, total = [], dict.fromkeys(("gaps", *COUNTED), 0)
    first = last = initial = None
    turns = 0
    for r in rows:
        for name in COUNTED:
            total[name] += r[name]
        if r["first_initial"] is not None:
            total["illegal"] += initial is not None and (initial, r["first_initial"]) not in LEGAL
            initial = r["last_initial"]
        if r["turns"]:
            turns += r["turns"] - (last == r["first_turn"] and first is not None)
            first = r["first_turn"] if first is None else first
            last = r["last_turn"]
        new, of, place = [INF] * 4, [0] * 4, [None] * 4
        for x in range(4):
            for q in range(4):
                step = r["costs"][4 * q + x]
                if step >= 0 and costs[q] < INF and (costs[q] + step < new[x] or (costs[q] + step == new[x] and order[q] < order[of[x]])):
                    new[x], of[x] = costs[q] + step, q
            place[x] = (order[of[x]], r["orders"][4 * of[x] + x])
        ranks = {p: k for k, p in enumerate(sorted({place[x] for x in range(4) if new[x] < INF}))}
        costs, order = new, [ranks.get(p, 0) for p in place]
        ways.append(of)
    state = end = last_state(costs, order)
    total |= {"gaps": last - first + 1 - turns if turns else 0, "cost": int(costs[end]) + INSERT * len(AFTER[end])}
    out = []
    for k in range(len(rows) - 1, -1, -1):
        out.append({"part": rows[k]["part"], "seq": rows[k]["seq"], "entry": ways[k][state], "leave": state, "last": k == len(rows) - 1} | total)
        state = ways[k][state]
    return pa.Table.from_pylist(out, CHAIN)


CHAIN = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("entry", pa.int32()), ("leave", pa.int32()), ("last", pa.bool_()), *[(c, pa.int64()) for c in ("gaps", *COUNTED, "cost")]])
RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def finish(open_pieces: DataFrame, conv_type: str) -> DataFrame:
    """The results of conversations in several pieces."""
    lean = open_pieces.select("conv", "part", "seq", *COUNTED, "costs", "orders", "first_turn", "last_turn", "turns", "first_initial", "last_initial")
    chain = "part int, seq int, entry int, leave int, last boolean, " + ", ".join(f"{c} long" for c in ("gaps", *COUNTED, "cost"))
    ways = lean.groupBy("conv").applyInArrow(chained, chain)
    joined = open_pieces.select("conv", "part", "seq", "roles", "texts", "faults").join(ways, ["part", "seq"])

    def repair(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                rows = [(role, text, role[:1]) for role, text in zip(r["roles"], r["texts"])]
                _, _, steps = forward([(x, f) for (_, _, x), f in zip(rows, r["faults"])], r["entry"])
                audit, text = backward(rows, steps, r["leave"])
                more, tail = ending(r["leave"]) if r["last"] else ("", [])
                out.append((audit + more, "\n".join(text + tail) if text or tail else None))
            audits, texts = zip(*out) if out else ((), ())
            columns = [batch.column(c) for c in told[:-2]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(audits, pa.string()), pa.array(texts, pa.string())], told)

    told = ["conv", "part", "seq", "last", *RESULT[:6], "audit", "text"]
    schema = f"conv {conv_type}, part int, seq int, last boolean, " + ", ".join(f"{c} long" for c in RESULT[:6]) + ", audit string, text string"
    repaired = joined.select("conv", "part", "seq", "last", *RESULT[:6], "roles", "texts", "faults", "entry", "leave").mapInArrow(repair, schema)
    # a conversation's pieces in order, in the task that hashes them as they come
    streamed = repaired.repartition("conv").sortWithinPartitions("conv", "part", "seq")

    def hashed(batches):
        digest, audit, any_text = hashlib.sha256(), [], False
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["text"] is not None:
                    digest.update((("\n" if any_text else "") + r["text"]).encode())
                    any_text = True
                audit.append(r["audit"])
                if r["last"]:
                    out.append((r["conv"], *[r[c] for c in RESULT[:6]], "".join(audit), digest.hexdigest()))
                    digest, audit, any_text = hashlib.sha256(), [], False
            kinds = [batch.schema.field("conv").type, *[pa.int64()] * 6, pa.string(), pa.string()]
            columns = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["conv", *RESULT])

    return streamed.mapInArrow(hashed, f"conv {conv_type}, " + ", ".join(f"{c} long" for c in RESULT[:6]) + ", audit string, repaired_sha256 string")


def repair(rows: DataFrame, **size) -> DataFrame:
    """conv and RESULT of each conversation of rows (conv, turn, role, text, live, copies)."""
    found = materialize(pieces(marked(rows), **size))
    kind = rows.schema["conv"].dataType.simpleString()
    return found.where("NOT open").select("conv", *RESULT).unionByName(finish(found.where("open"), kind))


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair(damaged(rows)).withColumnRenamed("conv", "conv_id")
