"""Repair of broken conversations by Knuth's lightest-derivation agenda.

A repair is a derivation in a weighted hypergraph. An item [i, q] says that the first i rows of a conversation are
dealt with and the repaired roles so far leave the grammar in state q. Its deductions take an item and an edit of the
next row (Keep, Rerole or Delete, the axioms) or an Insert. Weights are pairs (cost, audit): adding an edit adds its
cost and appends its letter, which never makes a pair smaller (superior) and keeps the order of two pairs of one item
(monotone: two audits of equal cost that deal with the same rows hold equally many letters, so neither begins the
other). The agenda pops the smallest pair first, so a popped item is final, and it ends when the goal is popped.

A conversation that one task sees whole, in at most `block_rows` rows, is derived there. Any other is cut into blocks:
a block's items [p -> q] are derived from each state p, and two neighbours are joined by the deduction
[p -> q] + [q -> r] = [p -> r] in rounds of joins, so no task ever holds a conversation, only its audit, a letter a row.

Defined cases: nulls count as one space, in any column but the turn, and null turns come first; rows of one turn go by
role, then by the md5 of the text; equal rows are added up before any shuffle, and their repetitions are duplicates; a
role whose first letter is not s, u or a (an empty one too) can only be changed or deleted; a null conversation id is
a conversation of its own; an empty table gives no rows; other columns are ignored; texts are held a block at a time.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofset.llm.common import table, written

START, SYSTEM, USER, ASSISTANT = range(4)
ROLE_OF = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
KEPT = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # what a new or changed turn must be
ENDS = (START, ASSISTANT)
NAMES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
LEGAL = ("su", "ua", "au")


@dataclass(frozen=True)
class Row:
    role: str
    text: str
    copies: int  # equal rows; all but the first are duplicates
    fault: str  # blank, duplicate, truncated or empty

    def edits(self, q: int) -> list[tuple[int, str, int]]:
        """(cost, letters, next state) of what may be done with this row in state q."""
        more, left = DELETE * (self.copies - 1), "D" * (self.copies - 1)
        out = [(DELETE + more, "D" + left, q)]
        if self.fault not in ("blank", "duplicate"):
            own = CUT_OFF if self.fault == "truncated" else 0
            state = ROLE_OF.get(self.role[:1])
            if (q, state) in KEPT:
                out.append((own + more, "K" + left, state))
            out.append((own + REROLE + more, "R" + left, NEXT[q]))
        return out


def lightest(rows: list[Row], start: int = START, goal: bool = True) -> dict[int, tuple[int, str]]:
    """The lightest (cost, audit) over all rows from a state, by end state: of the cheapest accepted end alone if a
    goal is sought, else of every end that can be reached."""
    n, final, ends = len(rows), set(), {}
    agenda = [(0, "", 0, start)]
    while agenda:
        cost, audit, i, q = heapq.heappop(agenda)
        if (i, q) in final:
            continue
        final.add((i, q))
        if i == n:
            if goal and q in ENDS:
                return {q: (cost, audit)}
            ends[q] = (cost, audit)
        if (i, NEXT[q]) not in final:
            heapq.heappush(agenda, (cost + INSERT, audit + "I", i, NEXT[q]))
        if i < n:
            for more, letters, to in rows[i].edits(q):
                if (i + 1, to) not in final:
                    heapq.heappush(agenda, (cost + more, audit + letters, i + 1, to))
    return ends


class Applier:
    """Carries an audit out on rows that come one block after another."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START

    def _new(self, edit: str, text: str) -> dict:
        self.state = NEXT[self.state]
        return {"role": NAMES[self.state], "text": text, "edit": edit}

    def block(self, rows: list[Row], last: bool) -> list[dict]:
        out = []
        for row in rows:
            while self.audit[self.at] == "I":
                out.append(self._new("I", ""))
                self.at += 1
            edit = self.audit[self.at]
            self.at += row.copies  # the repetitions go, right behind
            if edit == "K":
                self.state = ROLE_OF[row.role[:1]]
                out.append({"role": row.role, "text": row.text, "edit": "K"})
            elif edit == "R":
                out.append(self._new("R", row.text))
        if last:
            out += [self._new("I", "") for _ in range(len(self.audit) - self.at)]
            self.at = len(self.audit)
        return out


def _is_space(c: str) -> bool:
    return c == " " or "\t" <= c <= "\r"


def fault_of(text: str, late: bool) -> str:
    at = len(text) - 1
    while at >= 0 and _is_space(text[at]):
        at -= 1
    if at < 0:
        return "blank"
    return "duplicate" if late else "" if text[at] in ".!?" else "truncated"


def summed_up(turns: list[int | None], rows: list[Row]) -> dict:
    """What a block adds to its conversation's report."""
    known = [t for t in turns if t is not None]
    initials = [r.role[:1] for r in rows]
    faults = [r.fault for r in rows]
    again = sum(r.copies - 1 for r in rows if r.fault != "blank")
    own = sum(r.copies - 1 for r in rows if 2 * r.role[:1] not in LEGAL)
    return {
        "low": min(known, default=None), "high": max(known, default=None), "turns": len(set(known)), "first_turn": turns[0], "last_turn": turns[-1],
        "blank": sum(r.copies for r in rows if r.fault == "blank"), "duplicate": faults.count("duplicate") + again, "truncated": faults.count("truncated"),
        "illegal": own + sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "first_role": initials[0], "last_role": initials[-1],
    }


_TURN = "struct<role:string,text:string,edit:string>"
_ROW = "struct<role:string,text:string,copies:long,fault:string>"
_SUMS = "low long, high long, turns long, first_turn long, last_turn long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string"
_BLOCK = f"part int, no int, whole boolean, cost long, audit string, repaired array<{_TURN}>, rows array<{_ROW}>, {_SUMS}"
_ARROW_TURN = pa.struct([("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
_ARROW_ROW = pa.struct([("role", pa.string()), ("text", pa.string()), ("copies", pa.int64()), ("fault", pa.string())])


def _arrow_block(id_type: pa.DataType) -> pa.Schema:
    whole = [("part", pa.int32()), ("no", pa.int32()), ("whole", pa.bool_()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired", pa.list_(_ARROW_TURN)), ("rows", pa.list_(_ARROW_ROW))]
    sums = [(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _SUMS.split(", ")]
    return pa.schema([("conv_id", id_type), *whole, *sums])


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch as one."""
    for b in batches:
        if b.num_rows:
            names = [n for n in b.schema.names if n != "copies"]
            t = pa.Table.from_batches([b]).group_by(names).aggregate([("copies", "sum")])
            yield from t.rename_columns([*names, "copies"]).select(b.schema.names).to_batches()


def blocks(turns: DataFrame, block_rows: int, block_chars: int) -> DataFrame:
    """Rows of conversations in order, cut into blocks: a conversation that one task saw whole in one block is repaired
    there; of any other the blocks keep their rows."""
    kind = turns.schema["conv_id"].dataType
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in turns.schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, schema, run, size = [], None, [], 0
        at = {"part": None, "no": 0, "first": True, "conv": None}

        def close(whole: bool) -> None:
            nonlocal run, size
            rows = [r for _, r in run]
            block = {"conv_id": at["conv"], "part": at["part"], "no": at["no"], "whole": whole, "cost": None, "audit": None, "repaired": None, "rows": None} | summed_up([t for t, _ in run], rows)
            if whole:
                ((block["cost"], block["audit"]),) = lightest(rows).values()
                block["repaired"] = Applier(block["audit"]).block(rows, True)
            else:
                block["rows"] = [vars(r) for r in rows]
            out.append(block)
            at["no"] += 1
            run, size = [], 0

        for b in batches:
            schema = schema or _arrow_block(b.schema.field("conv_id").type)
            for x in b.to_pylist():
                at["part"] = x["part"] if at["part"] is None else at["part"]
                if run or at["no"]:
                    if at["conv"] != x["conv_id"]:
                        if run:
                            close(at["no"] == 0 and not at["first"])
                        at |= {"no": 0, "first": False}
                    elif len(run) >= block_rows or size >= block_chars:
                        close(False)
                at["conv"] = x["conv_id"]
                if run and (last := run[-1])[0] == x["turn"] and (last[1].role, last[1].text) == (x["role"], x["text"]):
                    run[-1] = (x["turn"], Row(x["role"], x["text"], last[1].copies + x["copies"], last[1].fault))
                else:
                    run.append((x["turn"], Row(x["role"], x["text"], x["copies"], fault_of(x["text"], x["late"]))))
                    size += len(x["text"])
                if len(out) >= 512:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if run:
            close(False)  # the next task may go on with it
            yield pa.RecordBatch.from_pylist(out, schema)

    order = ["conv_id", "turn", "role", "_h"]
    combined = turns.mapInArrow(_added_up, ddl).withColumn("_h", F.md5(F.col("text").cast("binary")))
    dealt = combined.repartitionByRange(*order).sortWithinPartitions(*order).drop("_h").withColumn("part", F.spark_partition_id())
    return dealt.mapInArrow(cut, f"conv_id {kind.simpleString()}, {_BLOCK}")


def _read(rows: list[dict]) -> list[Row]:
    return [Row(**r) for r in rows]


def chart(open_blocks: DataFrame) -> DataFrame:
    """conv_id, place, p, q, cost, audit: the lightest derivation of each block from each state to each."""
    kind = open_blocks.schema["conv_id"].dataType.simpleString()

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (conv, place, rows) in enumerate(zip(*(b.column(c).to_pylist() for c in ("conv_id", "place", "rows")), strict=True)):
                found = [(p, q, *w) for p in ((START,) if place == 0 else range(4)) for q, w in lightest(_read(rows), p, goal=False).items()]
                ids = b.column("conv_id").slice(k, 1).take(pa.array([0] * len(found)))
                yield pa.record_batch([ids, pa.array([place] * len(found), pa.int64()), *[pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int32(), pa.int64(), pa.string()), strict=True)]], names=["conv_id", "place", "p", "q", "cost", "audit"])

    return open_blocks.select("conv_id", "place", "rows").mapInArrow(derive, f"conv_id {kind}, place long, p int, q int, cost long, audit string")


def derived(open_blocks: DataFrame) -> DataFrame:
    """conv_id, cost, audit of conversations in several blocks: neighbours are joined until one item is left."""
    items = written(chart(open_blocks), "repair-chart")
    pair = F.floor(F.col("place") / 2).cast("long")
    while (items.agg(F.max("place")).first()[0] or 0) > 0:
        left, right = items.filter("place % 2 = 0").alias("l"), items.filter("place % 2 = 1").alias("r")
        alone = items.join(right.select(F.col("conv_id").alias("_c"), (F.col("place") - 1).alias("_p")).distinct(), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("place") == F.col("_p")), "left_anti").filter("place % 2 = 0")
        met = F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("l.place") + 1 == F.col("r.place")) & (F.col("l.q") == F.col("r.p"))
        joined = left.join(right, met).select("l.conv_id", "l.place", "l.p", "r.q", F.struct((F.col("l.cost") + F.col("r.cost")).alias("cost"), F.concat("l.audit", "r.audit").alias("audit")).alias("w"))
        both = joined.groupBy("conv_id", "place", "p", "q").agg(F.min("w").alias("w")).select("conv_id", "place", "p", "q", "w.*")
        items = written(both.unionByName(alone).withColumn("place", pair), "repair-chart")
    return items.filter(F.col("p").isin(START) & F.col("q").isin(*ENDS)).groupBy("conv_id").agg(F.min(F.struct("cost", "audit")).alias("w")).select("conv_id", "w.*")


def in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "place")


def applied(open_blocks: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, place, repaired: audits carried out block after block; a conversation's audit comes before them."""
    kind = open_blocks.schema["conv_id"].dataType.simpleString()

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doing = None
        for b in batches:
            ids, kept, out = b.column("conv_id"), [], []
            for k, (audit, last, rows) in enumerate(zip(*(b.column(c).to_pylist() for c in ("audit", "last", "rows")), strict=True)):
                if rows is None:
                    doing = Applier(audit)
                else:
                    kept.append(k)
                    out.append(doing.block(_read(rows), last))
            if kept:
                yield pa.record_batch([ids.take(pa.array(kept)), b.column("place").take(pa.array(kept)), pa.array(out, pa.list_(_ARROW_TURN))], names=["conv_id", "place", "repaired"])

    none = F.lit(None)
    first = audits.select("conv_id", F.lit(-1).cast("long").alias("place"), "audit", F.lit(False).alias("last"), none.cast(f"array<{_ROW}>").alias("rows"))
    rest = open_blocks.select("conv_id", "place", none.cast("string").alias("audit"), "last", "rows")
    return in_order(first.unionByName(rest)).mapInArrow(carry, f"conv_id {kind}, place long, repaired array<{_TURN}>")


@dataclass(frozen=True)
class Repair:
    report: DataFrame  # conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit
    blocks: DataFrame  # conv_id, place, whole, repaired: turns (role, text, edit) in order, in blocks of bounded size

    def turns(self) -> DataFrame:
        """conv_id, block, place, role, text, edit of every repaired turn."""
        return self.blocks.select("conv_id", F.col("place").alias("block"), F.posexplode("repaired").alias("place", "t")).select("conv_id", "block", "place", "t.*")


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None, block_rows: int = 512, block_chars: int = 4_000_000) -> Repair:
    """Faults and lightest repair of every conversation that has rows. copies: how often a row stands (once)."""
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    turns = rows.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), (F.lit(1) if copies is None else copies).cast("long").alias("copies"))
    # only a text that comes in several turns of its conversation can repeat one of an earlier turn
    same = [F.col("conv_id"), F.col("role"), F.md5(F.col("text").cast("binary")).alias("h")]
    again = turns.groupBy(*same).agg(F.count_if(F.col("turn").isNull()).alias("nulls"), F.min("turn").alias("low"), F.max("turn").alias("high"))
    again = again.filter("(nulls > 0 and high is not null) or low < high").select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("h").alias("_h"), F.when(F.col("nulls") == 0, F.col("low")).alias("_first"))
    met = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.md5(F.col("text").cast("binary")) == F.col("_h"))
    late = F.col("_h").isNotNull() & F.col("turn").isNotNull() & F.coalesce(F.col("turn") > F.col("_first"), F.lit(True))
    turns = turns.join(again, met, "left").select("conv_id", "turn", "role", "text", "copies", late.alias("late"))
    cut = written(blocks(turns, block_rows, block_chars), "repair-blocks")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    counts = ["blank", "duplicate", "truncated", "illegal"]
    whole = cut.filter("whole")
    in_conv = Window.partitionBy("conv_id").orderBy("part", "no")
    rest = cut.filter("not whole")
    place = rest.withColumns({"place": (F.row_number().over(in_conv) - 1).cast("long"), "last": F.lead("no").over(in_conv).isNull()})
    place = written(place, "repair-open")
    audits = derived(place)
    edge = Window.partitionBy("conv_id").orderBy("place")
    pair = F.concat(F.lag("last_role").over(edge), F.col("first_role"))
    sums = place.drop("rows").withColumns({"_bad": F.coalesce(~pair.isin(*LEGAL), F.lit(False)).cast("long"), "_same": F.coalesce(F.lag("last_turn").over(edge) == F.col("first_turn"), F.lit(False)).cast("long")})
    sums = sums.groupBy("conv_id").agg(F.min("low").alias("low"), F.max("high").alias("high"), (F.sum("turns") - F.sum("_same")).alias("turns"), *[F.sum(c).alias(c) for c in counts[:3]], (F.sum("illegal") + F.sum("_bad")).alias("illegal"))
    audits = written(audits, "repair-audits")
    named = audits.select(F.col("conv_id").alias("_c"), "cost", "audit")
    open_report = sums.join(named, F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", gaps.alias("gaps"), *counts, "cost", "audit")
    report = whole.select("conv_id", gaps.alias("gaps"), *counts, "cost", "audit").unionByName(open_report)
    done = applied(place, audits).withColumn("whole", F.lit(False))
    return Repair(report, whole.select("conv_id", F.lit(0).cast("long").alias("place"), "whole", "repaired").unionByName(done.select("conv_id", "place", "whole", "repaired")))


def turn_text(t: Column) -> Column:
    return F.concat(t["role"], F.lit(":"), t["text"])


def digests(blocks: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of `role:text` of the repaired turns, joined by newlines."""
    kind = blocks.schema["conv_id"].dataType.simpleString()
    parts = blocks.select("conv_id", "place", "whole", F.array_join(F.transform("repaired", turn_text), "\n").alias("t"), F.size("repaired").alias("n"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the id (an array of one), the digest so far, whether it has a turn
        close = lambda: pa.record_batch([held[0], pa.array([held[1].hexdigest()])], names=["conv_id", "repaired_sha256"])
        for b in batches:
            for k, (place, t, n) in enumerate(zip(*(b.column(c).to_pylist() for c in ("place", "t", "n")), strict=True)):
                if place == 0:
                    if held:
                        yield close()
                    held = [b.column("conv_id").slice(k, 1), hashlib.sha256(), False]
                if n:
                    held[1].update((("\n" if held[2] else "") + t).encode())
                    held[2] = True
        if held:
            yield close()

    own = parts.filter("whole").select("conv_id", F.sha2(F.col("t").cast("binary"), 256).alias("repaired_sha256"))
    return own.unionByName(in_order(parts.filter("not whole").select("conv_id", "place", "t", "n")).mapInArrow(stream, f"conv_id {kind}, repaired_sha256 string"))


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations as op11 breaks them: conv_id, turn, role, text, copies."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.col("kind")
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("kind")).filter(kind != 0)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies"))


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = repair(damaged(conversations), copies=F.col("copies"))
    found = fixed.report.join(digests(fixed.blocks).withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c").withColumnRenamed("conv_id", "_c")
    all_ids = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return all_ids.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
