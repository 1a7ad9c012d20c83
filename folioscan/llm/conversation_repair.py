"""Repairs the structure of dialogues with the cheapest edits.

What an edit costs depends on a turn's role and fault alone, so a conversation
is a signature, one sign a turn. Signatures are sorted and walked as a prefix
trie: the layers of the dynamic programme that belong to a shared prefix are
made once and stay on a stack, and where a signature ends its answer is read
off. Texts take no part in that; they come in again, streamed, for the result.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, materialise

VISIBLE = r"[^\x20\x09-\x0D]"
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
SYSTEM, USER, ASSISTANT, OTHER = range(4)
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
#: What a turn that was cut off costs besides, unless it is deleted.
CUT_OFF = 5
#: States of what has been kept: nothing, a system turn, then a user's or an assistant's turn last.
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
NEXT = ({SYSTEM: AFTER_SYSTEM, USER: AFTER_USER}, {USER: AFTER_USER}, {ASSISTANT: AFTER_ASSISTANT}, {USER: AFTER_USER})
#: Characters of a text that put turns of one number and role in order; its digest decides beyond them.
LEAD = 100


def sign(role: int, fault: int) -> str:
    return chr(65 + 4 * role + fault)


class Programme:
    """The dynamic programme over signatures, a layer for each sign.

    A layer holds, for each state, the least cost by which the turns so far
    lead there, and among equal costs the edits that come first in ASCII order.
    The edits themselves are not kept: two of them are compared by the rank of
    what they were at the last turn, and by what came after. Layers that differ
    only by a constant cost are one; so few exist that each step between
    them is worked out once.
    """

    def __init__(self):
        self.layers: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.steps: dict[tuple[int, str], tuple[int, int, tuple]] = {}
        self.first = self._number(((0, 0, 0), None, (5, 0, 1), (10, 0, 2)))
        self.signature = ""
        #: The path in the trie, from the root: layer, cost to add to it, and how each of its states was reached.
        self.path, self.costs, self.back = array("i", [self.first]), array("q", [0]), [None]

    def _number(self, layer: tuple) -> int:
        if layer not in self.numbers:
            self.numbers[layer] = len(self.layers)
            self.layers.append(layer)
        return self.numbers[layer]

    def _step(self, number: int, symbol: str) -> tuple[int, int, tuple]:
        """(next layer, cost to add, for each state the state before the turn, the turn's edit and the insertions after it)."""
        role, fault = divmod(ord(symbol) - 65, 4)
        landed: dict[int, tuple] = {}
        for y, state in enumerate(self.layers[number]):
            if state is None:
                continue
            cost, rank, inserted = state
            ways = [(y, DELETE, COST[DELETE])]
            if fault not in (BLANK, DUPLICATE):
                more = CUT_OFF if fault == TRUNCATED else 0
                ways += [(z, KEEP if r == role else REROLE, (COST[KEEP] if r == role else COST[REROLE]) + more) for r, z in NEXT[y].items() if r == role or r != SYSTEM]
            for z, letter, price in ways:
                option = (cost + price, (rank, INSERT * inserted + letter), y, letter)
                landed[z] = min(landed.get(z, option), option)
        ranks = {key: i for i, key in enumerate(sorted({key for _, key, _, _ in landed.values()}))}
        best: list[tuple | None] = [None] * 4
        for z, (cost, key, y, letter) in landed.items():
            best[z] = (cost, ranks[key], 0, y, letter)
        for z, sources in ((AFTER_USER, (START, AFTER_SYSTEM, AFTER_ASSISTANT)), (AFTER_ASSISTANT, (AFTER_USER,))):
            for s in sources:
                if best[s]:
                    cost, rank, inserted, y, letter = best[s]
                    option = (cost + COST[INSERT], rank, inserted + 1, y, letter)
                    best[z] = min(best[z] or option, option)
        # whatever may follow a state that lags behind may as well follow the assistant's turn, for less
        lead = best[AFTER_ASSISTANT][0]
        if best[AFTER_SYSTEM] and best[AFTER_SYSTEM][0] > lead:
            best[AFTER_SYSTEM] = None
        if best[START] and best[START][0] > lead + COST[DELETE]:
            best[START] = None
        low = min(b[0] for b in best if b)
        dense = {r: i for i, r in enumerate(sorted({b[1] for b in best if b}))}
        layer = tuple(b and (b[0] - low, dense[b[1]], b[2]) for b in best)
        return self._number(layer), low, tuple(b and (b[3], b[4], b[2]) for b in best)

    def answer(self, signature: str) -> tuple[int, str]:
        """(cost, edits) of a signature; the prefix that it shares with the one before is not gone over again."""
        shared = len(os.path.commonprefix((self.signature, signature)))
        del self.path[shared + 1 :], self.costs[shared + 1 :], self.back[shared + 1 :]
        at, cost = self.path[-1], self.costs[-1]
        for symbol in signature[shared:]:
            step = self.steps.get((at, symbol))
            if step is None:
                step = self.steps[at, symbol] = self._step(at, symbol)
            at, more, back = step
            cost += more
            self.path.append(at)
            self.costs.append(cost)
            self.back.append(back)
        self.signature = signature
        own = self.layers[at]
        state = min((z for z in (START, AFTER_ASSISTANT) if own[z]), key=lambda z: own[z])
        total = cost + own[state][0]
        edits = []
        for back in reversed(self.back[1:]):
            state, letter, inserted = back[state]
            edits.append(letter + INSERT * inserted)
        edits.append(INSERT * self.layers[self.first][state][2])
        return total, "".join(reversed(edits))


_ROLE_LETTERS = str.maketrans({sign(role, fault): "suao"[role] for role in range(4) for fault in range(4)})


def faults(signature: str) -> tuple[int, int, int, int]:
    """Blank, repeated and cut-off turns, and neighbours whose roles may not follow each other."""
    roles = signature.translate(_ROLE_LETTERS)
    return (*(sum(signature.count(sign(r, f)) for r in range(4)) for f in (BLANK, DUPLICATE, TRUNCATED)), max(0, len(roles) - 1) - sum(map(roles.count, ("su", "ua", "au"))))


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Damages turns by the CRC-32 of ``conv:turn`` modulo 20, for tests of a repair: 0 takes a turn away, 1 its text, 2 its stops, 3 repeats it, 4 makes it the user's.

    Returns the four columns and ``copies``, how often a turn stands there. A
    turn taken away leaves a row without copies, by which its conversation
    is still known. Nulls count as one blank.
    """
    blank = F.lit(" ")
    kind = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in (conv_col, turn_col)])) % 20
    text, role = F.coalesce(F.col(text_col), blank), F.coalesce(F.col(role_col).cast("string"), blank)
    there = kind != 0
    return turns.select(
        F.col(conv_col),
        F.when(there, F.col(turn_col)).alias(turn_col),
        F.when(there, F.when(kind == 4, F.lit("user")).otherwise(role)).alias(role_col),
        F.when(there, F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)).alias(text_col),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


_CLASHES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _order() -> list[Column]:
    return [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("lead").asc(), F.col("mark").asc()]


def _prepared(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, copies_col: str | None) -> DataFrame:
    """conv, turn, role, text, lead, mark, copies; a row without copies keeps its conversation alone."""
    copies = F.coalesce(F.col(copies_col).cast("long"), F.lit(0)) if copies_col else F.lit(1).cast("long")
    text = F.coalesce(F.col(text_col), F.lit(" "))
    there = copies > 0
    return turns.select(
        F.col(conv_col).alias("conv"),
        F.when(there, F.col(turn_col).cast("long")).alias("turn"),
        F.when(there, F.coalesce(F.col(role_col).cast("string"), F.lit(" "))).alias("role"),
        F.when(there, text).alias("text"),
        F.when(there, F.left(text, F.lit(LEAD))).alias("lead"),
        F.when(there, F.unhex(F.sha2(text, 256))).alias("mark"),
        copies.alias("copies"),
    )


def _signed(turns: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """conv, turn, role, lead, mark, copies and the signs of the first and of further copies, for each distinct turn; and the tables it is read from.

    Equal turns are counted where they lie, before they are exchanged; no text is.
    """
    body = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    own = F.when(body == "", BLANK).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(OK)
    initial = F.left("role", F.lit(1))
    role = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    counted = turns.withColumn("fault", own).groupBy("conv", "turn", "role", "lead", "mark").agg(F.sum("copies").alias("copies"), F.first("fault").alias("fault"))
    counted = materialise(counted.withColumn("kind", role), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn")
    said = counted.where("copies > 0").groupBy("conv", "role", "mark").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    said = materialise(said.select(F.col("conv").alias("s_conv"), F.col("role").alias("s_role"), F.col("mark").alias("s_mark"), "first"), "said-again")
    few = F.broadcast(said) if said.count() <= BROADCAST_ROWS else said
    told = counted.join(few, F.col("conv").eqNullSafe(F.col("s_conv")) & (F.col("role") == F.col("s_role")) & (F.col("mark") == F.col("s_mark")), "left")
    earlier = F.coalesce(place != F.col("first"), F.lit(False))
    fault = F.when(F.col("fault") == BLANK, BLANK).when(earlier, DUPLICATE).otherwise(F.col("fault"))
    further = F.when(F.col("fault") == BLANK, BLANK).otherwise(DUPLICATE)
    signed = told.select("conv", "turn", "role", "lead", "mark", "copies", F.char(65 + 4 * F.col("kind") + fault).alias("one"), F.char(65 + 4 * F.col("kind") + further).alias("more"))
    return signed, [counted, said]


def signatures(turns: DataFrame) -> DataFrame:
    """(conv, signature, gaps) from prepared turns, written.

    All turns are range-sorted by conversation, number, role and text, so one
    conversation, however long, is spread over tasks, each of which writes its
    part; the parts, a character a turn, are then joined.
    """
    signed, sources = _signed(turns)
    conv_kind = signed.schema["conv"].dataType.simpleString()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId(), 0
        for batch in batches:
            convs, ones, mores, copies, turns = (batch.column(k).to_pylist() for k in range(5))
            cuts = [i for i in range(len(convs)) if i == 0 or convs[i] != convs[i - 1]]
            rows = []
            for a, b in zip(cuts, [*cuts[1:], len(convs)], strict=True):
                numbers = [t for t in turns[a:b] if t is not None]
                piece = "".join(ones[i] + mores[i] * (copies[i] - 1) for i in range(a, b) if copies[i])
                rows.append((task, serial, piece, len(set(numbers)), numbers[0] if numbers else None, numbers[-1] if numbers else None))
                serial += 1
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cuts, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["conv", "task", "serial", "piece", "numbers", "low", "high"])

    many = signed.repartitionByRange(*_order()).sortWithinPartitions(*_order()).select("conv", "one", "more", "copies", "turn")
    pieces = many.mapInArrow(parts, f"conv {conv_kind}, task int, serial long, piece string, numbers long, low long, high long")
    whole = pieces.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("task", "serial", "piece", "numbers", "low", "high"))).alias("p"))
    numbered = F.filter("p", lambda p: p["low"].isNotNull())
    rows = whole.select("conv", F.array_join(F.transform("p", lambda p: p["piece"]), "").alias("signature"), numbered.alias("p"))
    out = materialise(rows.select("conv", "signature", _gaps(F.col("p")).alias("gaps")), "signatures")
    for source in sources:
        discard(source)
    return out


def _gaps(parts: Column) -> Column:
    """Numbers between the least and the greatest turn that no turn has; a number on both sides of a seam counts once."""
    ends = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    begins = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    seams = F.size(F.filter(F.zip_with(ends, begins, lambda a, b: a["high"] == b["low"]), lambda x: x))
    numbers = F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, p: s + p["numbers"]) - seams
    span = F.array_max(F.transform(parts, lambda p: p["high"])) - F.array_min(F.transform(parts, lambda p: p["low"])) + 1
    return F.when(F.size(parts) > 0, span - numbers).otherwise(F.lit(0)).cast("long")


def solved(signed: DataFrame) -> DataFrame:
    """Adds blank, duplicate, truncated, illegal, cost and audit to rows of (conv, signature, gaps).

    Rows are range-sorted by signature and conversation: those that share a
    prefix meet in a task, and a signature that very many share is split.
    """
    conv_kind = signed.schema["conv"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        programme = Programme()
        last, told = None, ()
        for batch in batches:
            rows = []
            for signature in batch.column(1).to_pylist():
                if signature != last:
                    last, told = signature, (*faults(signature), *programme.answer(signature))
                rows.append(told)
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.string())], names=["conv", "gaps", *_CLASHES[1:7]])

    ordered = signed.repartitionByRange("signature", "conv").sortWithinPartitions("signature", "conv").select("conv", "signature", "gaps")
    return ordered.mapInArrow(walk, f"conv {conv_kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _answers(turns: DataFrame) -> DataFrame:
    """A row of answers for each conversation of prepared turns, written."""
    signed = signatures(turns)
    out = materialise(solved(signed), "answers")
    discard(signed)
    return out


class Rewriter:
    """Goes along one conversation's edits with its turns; keeps a place in the edits and whose turn it is."""

    def __init__(self, audit: str):
        self.audit, self.at, self.next = audit, 0, "user"

    def _turn(self, role: str) -> str:
        self.next = "assistant" if role[:1] == "u" else "user"
        return role

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            self.at += 1
            yield self._turn(self.next), "", INSERT

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(role, text, edit) of what stands before a turn and of the turn itself, unless it goes."""
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter != DELETE:
            yield self._turn(role if letter == KEEP else self.next), text, letter


def _streamed(turns: DataFrame, answers: DataFrame) -> DataFrame:
    """A conversation's answers and then its turns in order: head, conv, the answers' columns, role, text, copies.

    One task sees a whole conversation, a batch at a time, as a digest over all
    its text can be made in no other way; nothing is gathered.
    """
    heads = answers.withColumn("head", F.lit(0))
    bodies = turns.where("copies > 0").withColumn("head", F.lit(1))
    both = heads.unionByName(bodies, allowMissingColumns=True)
    keys = _order()
    both = both.repartition("conv").sortWithinPartitions(keys[0], "head", *keys[1:])
    return both.select("head", "conv", *_CLASHES[:7], "role", "text", "copies")


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """What is wrong with each conversation, the cheapest edits that mend it, and the digest of the result.

    A mended conversation has the roles ``(s?(ua)+)?`` by their initials and no
    blank or repeated turn. Keep costs 0, Rerole to user or assistant 1, Delete
    2, Insert of an empty turn of theirs 5; a turn that is kept though cut off
    costs 5 more. A turn's first fault counts: blank (no visible character),
    duplicate (role and text seen earlier), truncated (the last visible
    character is none of ``.!?``). Returns the conversation's column, gaps
    (numbers missing between its least and greatest turn), blank, duplicate,
    truncated, illegal (neighbours other than su, ua, au), cost, audit (initials
    of the edits in order, the first of the cheapest in ASCII order) and
    repaired_sha256 of its turns as ``role:text``, joined by newlines.

    Turns stand in the order of their numbers, nulls first; among equal
    numbers role, the text's first 100 characters and then its SHA-256 decide.
    Nulls in role and text are one blank; a null conversation is one of its
    own. Equal rows are one turn said again. ``copies_col`` names a column that
    says how often a row stands there (none or null: not at all; its
    conversation stays, and may be left without turns: zeros, no edits, the
    digest of nothing). Other columns are not read, whatever their names. An
    empty table gives no rows. A turn's length has no bound but a row's.
    """
    if conv_col in _CLASHES:
        raise ValueError(f"the result has a column {conv_col} of its own")
    prepared = _prepared(turns, conv_col, turn_col, role_col, text_col, copies_col)
    answers = _answers(prepared)
    kind = answers.schema["conv"].dataType.simpleString()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: tuple | None = None
        rewriter, digest, first = Rewriter(""), hashlib.sha256(), True
        shape = None

        def add(said: Iterator[tuple[str, str, str]]) -> None:
            nonlocal first
            for role, text, _ in said:
                digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                first = False

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*own, digest.hexdigest()), [*shape, pa.string()], strict=True)], names=["conv", *_CLASHES])

        for batch in batches:
            shape = [batch.column(k).type for k in range(1, 9)]
            done = []
            audits = batch.column(8)
            heads, convs, roles, texts, copies = (batch.column(k).to_pylist() for k in (0, 1, 9, 10, 11))
            for i, head in enumerate(heads):
                if head == 0:
                    if own is not None:
                        add(rewriter.inserted())
                        done.append(closed())
                    own = (convs[i], *(batch.column(k)[i].as_py() for k in range(2, 9)))
                    rewriter, digest, first = Rewriter(audits[i].as_py()), hashlib.sha256(), True
                else:
                    for _ in range(copies[i]):
                        add(rewriter.turn(roles[i], texts[i]))
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        if own is not None:
            add(rewriter.inserted())
            yield closed()

    out = _streamed(prepared, answers).mapInArrow(finish, f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    return out.withColumnRenamed("conv", conv_col)


def repaired_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """The mended conversations: conversation, position (from 0), role, text and the edit (K, R or I) that each turn comes from.

    See ``repair`` for what is mended and how odd rows count.
    """
    if conv_col in ("position", "role", "text", "edit"):
        raise ValueError(f"the result has a column {conv_col} of its own")
    prepared = _prepared(turns, conv_col, turn_col, role_col, text_col, copies_col)
    answers = _answers(prepared)
    kind = answers.schema["conv"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, rewriter, position, rows = None, Rewriter(""), 0, []

        def add(said: Iterator[tuple[str, str, str]]) -> None:
            nonlocal position
            for role, text, edit in said:
                rows.append((conv, position, role, text, edit))
                position += 1

        def taken(conv_type: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 5
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (conv_type, pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["conv", "position", "role", "text", "edit"])

        conv_type = None
        for batch in batches:
            conv_type = batch.column(1).type
            heads, convs, audits, roles, texts, copies = (batch.column(k).to_pylist() for k in (0, 1, 8, 9, 10, 11))
            for i, head in enumerate(heads):
                if head == 0:
                    add(rewriter.inserted())
                    conv, rewriter, position = convs[i], Rewriter(audits[i]), 0
                else:
                    for _ in range(copies[i]):
                        add(rewriter.turn(roles[i], texts[i]))
            yield taken(conv_type)
        add(rewriter.inserted())
        if rows:
            yield taken(conv_type)

    return _streamed(prepared, answers).mapInArrow(write, f"conv {kind}, position long, role string, text string, edit string").withColumnRenamed("conv", conv_col)
