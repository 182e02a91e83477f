"""Cheapest repair of conversations to the role grammar `(s?(ua)+)?`, by layers of cost.

A grammar state is a bit: START, after a system turn, after a user turn, after an assistant turn. For each place between
turns a bitset per cost says from which states the end can be reached at exactly that further cost and no less; the sets of all costs lie side
by side in one integer, so an edit is a mask and a shift for all layers at once. The first layer that holds START
is the cost. A trace forward through the sets then takes the least letter that stays on a cheapest path; the state and the
letter decide the next state, so there is one such path.

Above the least reachable cost the layers of a place take few forms, and a turn matters by few traits (its role's initial,
whether it must go, whether it is cut off), so steps are remembered: a conversation costs a lookup for each turn.

Turns are put in order by ranges, so a conversation of any length spreads over tasks; of each turn one byte is gathered,
as many as the audit has letters. Texts are then streamed once, in order, past their conversation's audit, to digest or rewrite them; a
digest runs over all texts of a conversation, so that pass takes one task for each, with one text in memory at a time.

Defined cases: a null role or text is one space; a null turn comes first; turns that tie are ordered by role and then by the
text's digest, equal rows being interchangeable; a null conv_id is a conversation of its own; a conversation that has lost all its turns has counts of
zero and an empty audit; texts count whole, whatever their length; an empty table gives no rows; columns that are not asked for are left aside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.cuts import cut
from dossier.llm.common import WORD

START, SYSTEM, USER, ASSISTANT = (1 << k for k in range(4))  # states
STATES = 4
ROLES = {"u": "user", "a": "assistant"}
#: State after a turn of this initial; a missing entry is against the grammar.
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = START | ASSISTANT
FOLLOWS = frozenset({"su", "ua", "au"})

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5  # costs

#: A turn in one byte: 2 bits of its role's initial, must go, cut off, and its first fault.
INITIALS = "sua?"
MUST_GO, CUT, FAULT = 4, 8, 16
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3

BLANKS = " \t\n\x0b\x0c\r"


def before(layers: int, initial: str) -> int:
    """In all layers: the states from which a turn of this initial leads into a state that is set."""
    out = 0
    for (state, x), then in AFTER.items():
        if x == initial:
            out |= _shifted(layers & _all(then, layers), state.bit_length() - then.bit_length())
    return out


def _shifted(bits: int, by: int) -> int:
    return bits << by if by >= 0 else bits >> -by


def _all(state: int, layers: int) -> int:
    """The state's bit in as many layers as there are."""
    mask = 0
    for k in range(0, layers.bit_length(), STATES):
        mask |= state << k
    return mask


def _least(layers: int) -> int:
    """Each state in its lowest layer only."""
    seen = out = 0
    for k in range(0, layers.bit_length(), STATES):
        new = layers >> k & 15 & ~seen
        seen |= new
        out |= new << k
    return out


def _inserted(layers: int) -> int:
    """With any number of turns inserted at this place."""
    while True:
        more = _least(layers | (before(layers, "u") | before(layers, "a")) << STATES * INSERT)
        if more == layers:
            return layers
        layers = more


def at_end() -> int:
    return _inserted(ENDS)


@lru_cache(maxsize=100_000)
def step(layers: int, turn: int) -> tuple[int, int]:
    """The layers before a turn, from those behind it, less the empty ones at the bottom, and how many those were."""
    out = layers << STATES * DELETE
    if not turn & MUST_GO:
        cost = CUT_OFF if turn & CUT else 0
        out |= before(layers, INITIALS[turn & 3]) << STATES * (KEEP + cost)
        for x in ROLES:
            out |= before(layers, x) << STATES * (REROLE + cost)
    out, low = _inserted(_least(out)), 0
    while not out >> STATES * low & 15:
        low += 1
    return out >> STATES * low, low


def _cost(layers: int, state: int) -> int | None:
    """The layer that holds the state."""
    for k in range(0, layers.bit_length(), STATES):
        if layers >> k & state:
            return k // STATES
    return None


@lru_cache(maxsize=400_000)
def trace(state: int, layers: int, low: int, behind: int, turn: int) -> tuple[str, int]:
    """The least letters for a turn (insertions before it, then its own) and the state after it.

    layers lie before the turn and behind after it; layers' lowest is `low` above behind's.
    """
    out = ""
    while True:
        left = _cost(layers, state) + low

        def leads(then: int | None, cost: int, onto: int, base: int, left: int = left) -> bool:
            rest = None if then is None else _cost(onto, then)
            return rest is not None and rest + base + cost == left

        turned = [then for x in ROLES if (then := AFTER.get((state, x)))][0]
        if leads(state, DELETE, behind, 0):
            return out + "D", state
        if leads(turned, INSERT, layers, low):
            out, state = out + "I", turned
            continue
        cost = CUT_OFF if turn & CUT else 0
        kept = AFTER.get((state, INITIALS[turn & 3]))
        if leads(kept, KEEP + cost, behind, 0):
            return out + "K", kept
        return out + "R", turned


def repair(turns: bytes) -> tuple[int, str]:
    """The least cost and, of the cheapest repairs, the least audit."""
    held, layers, total = [], at_end(), 0
    for turn in reversed(turns):
        behind = layers
        layers, low = step(behind, turn)
        held.append((layers, low, behind))
        total += low
    state, audit = START, []
    cost = total + _cost(layers, START)
    for turn, (here, low, behind) in zip(turns, reversed(held), strict=True):
        letters, state = trace(state, here, low, behind, turn)
        audit.append(letters)
    while _cost(at_end(), state):
        state = [then for x in ROLES if (then := AFTER.get((state, x)))][0]
        audit.append("I")
    return cost, "".join(audit)


def rewritten(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Turns (role, text) as the audit says, in order."""
    state = START
    for letter in audit:
        if letter == "D":
            next(turns)
            continue
        if letter == "K":
            role, text = next(turns)
            x = role[:1]
        else:
            x = next(x for x in ROLES if (state, x) in AFTER)
            role, text = ROLES[x], "" if letter == "I" else next(turns)[1]
        state = AFTER[(state, x)]
        yield role, text


def counts(turns: bytes) -> tuple[int, int, int, int]:
    """blank, duplicate, truncated, illegal."""
    faults = [turns_of(turns, k) for k in (BLANK, DUPLICATE, TRUNCATED)]
    initials = [INITIALS[t & 3] for t in turns]
    return (*faults, sum(a + b not in FOLLOWS for a, b in zip(initials, initials[1:], strict=False)))


def turns_of(turns: bytes, fault: int) -> int:
    return sum(t // FAULT == fault for t in turns)


# ---- on tables


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) of a table after the contract's damage."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", told("conv_id"), told("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with keys that are never null: of the conversation, and of a turn's place in it."""
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")).alias("conv"),
        F.col("turn").isNotNull().alias("timed"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(0)).alias("at"),
        role.alias("role"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        text.alias("text"),
    )


ORDER = ["conv", "timed", "at", "role", "digest"]


def _traits() -> list[Column]:
    """Blank, cut off, and the role's initial as a number, of a row with role and text."""
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    blank = ~F.col("text").rlike(WORD)
    initial = F.instr(F.lit("sua"), F.left("role", F.lit(1)))
    return [blank.alias("blank"), (~last.isin(".", "!", "?")).alias("cut"), F.when((initial > 0) & (F.length("role") > 0), initial - 1).otherwise(3).alias("initial")]


def _turn_bytes(keyed: DataFrame) -> DataFrame:
    """Each conversation's turns in order, a byte each, as stretches (conv, part, turns): no task gathers a conversation."""
    different = keyed.select(*ORDER, *_traits()).groupBy(*ORDER).agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("blank", "cut", "initial")])
    different = cut(different, "turns")
    firsts = different.groupBy("conv", "role", "digest").agg(F.min(F.struct("timed", "at")).alias("first")).select("conv", "role", "digest", "first.*", F.lit(True).alias("first"))
    marked = different.join(firsts, ORDER, "left")
    code = lambda fault: F.col("initial") + F.when(fault.isin(BLANK, DUPLICATE), MUST_GO).otherwise(0) + F.when(F.col("cut") & ~F.col("blank"), CUT).otherwise(0) + FAULT * fault
    again = F.when(F.col("blank"), BLANK).otherwise(DUPLICATE)
    once = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(0)
    dealt = marked.select(*ORDER, "n", code(once).cast("int").alias("once"), code(again).cast("int").alias("again"))
    dealt = cut(dealt, "marked").repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select("conv", F.spark_partition_id().alias("part"), "n", "once", "again")

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, part, turns = None, 0, bytearray()
        for b in batches:
            done = []
            for c, p, n, once, again in zip(*[b.column(k).to_pylist() for k in range(5)], strict=True):
                if c != conv:
                    if turns:
                        done.append((conv, part, bytes(turns)))
                    conv, part, turns = c, p, bytearray()
                turns.append(once)
                turns.extend(bytes([again]) * (n - 1))
            if done:
                yield _batch(done, STRETCH)
        if turns:
            yield _batch([(conv, part, bytes(turns))], STRETCH)

    return dealt.mapInArrow(stretches, STRETCH)


STRETCH = T.StructType([T.StructField("conv", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("turns", T.BinaryType())])
VERDICT = T.StructType([T.StructField("conv", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], T.StructField("audit", T.StringType())])
DIGEST = T.StructType([T.StructField("conv", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
TURN = T.StructType([T.StructField("conv", T.StringType()), T.StructField("place", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
ARROW = {"string": pa.string(), "integer": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    arrays = [pa.array(c, ARROW[f.dataType.typeName()]) for c, f in zip(zip(*rows, strict=True), schema.fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=schema.names)


def verdicts(keyed: DataFrame) -> DataFrame:
    """(conv, blank, duplicate, truncated, illegal, cost, audit) of each conversation that has turns."""
    parts = _turn_bytes(keyed).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "turns"))).alias("parts"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                some = b.slice(k, 1000)
                rows = []
                for conv, held in zip(some.column("conv").to_pylist(), some.column("parts").to_pylist(), strict=True):
                    turns = b"".join(x["turns"] for x in held)
                    rows.append((conv, *counts(turns), *repair(turns)))
                if rows:
                    yield _batch(rows, VERDICT)

    return parts.mapInArrow(judge, VERDICT)


def _past_audits(keyed: DataFrame, judged: DataFrame, work, schema: T.StructType) -> DataFrame:
    """work(conv, audit, turns) -> rows, for each conversation, its turns (role, text) streamed in order."""
    audits = judged.select("conv", F.lit(False).alias("row"), "audit")
    rows = keyed.withColumn("row", F.lit(True)).unionByName(audits, allowMissingColumns=True)
    order = ["conv", "row", *ORDER[1:]]
    sorted_rows = rows.repartition("conv").sortWithinPartitions(*order).select("conv", "row", "audit", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = (r for b in batches for r in zip(*[b.column(k).to_pylist() for k in range(5)], strict=True))
        ahead = next(flat, None)
        out = []

        def turns(conv) -> Iterator[tuple[str, str]]:
            nonlocal ahead
            while ahead and ahead[0] == conv and ahead[1]:
                held = ahead
                ahead = next(flat, None)
                yield held[3], held[4]

        while ahead:
            conv, audit = ahead[0], ahead[2]
            ahead = next(flat, None)
            size = 0
            for row in work(conv, audit, turns(conv)):
                out.append(row)
                size += sum(len(x) for x in row if isinstance(x, str))
                if len(out) >= 1000 or size > 1_000_000:
                    yield _batch(out, schema)
                    out, size = [], 0
        if out:
            yield _batch(out, schema)

    return sorted_rows.mapInArrow(run, schema)


def _digest(conv: str, audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple]:
    """The digest of `role:text` of the repaired turns, joined by line feeds."""
    h, first = hashlib.sha256(), True
    for role, text in rewritten(audit, turns):
        h.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        first = False
    yield conv, h.hexdigest()


def _rewrite(conv: str, audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple]:
    for place, (role, text) in enumerate(rewritten(audit, turns)):
        yield conv, place, role, text


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations' turns: (conv_id as text, place from 0, role, text)."""
    keyed = _keyed(rows)
    turns = _past_audits(keyed, verdicts(keyed), _rewrite, TURN)
    return turns.select(F.when(F.col("conv") != "-", F.substring("conv", 2, 1 << 30)).alias("conv_id"), "place", "role", "text")


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """For every conv_id of conversations: what is wrong with its rows, the cost and audit of its repair, and the repair's digest."""
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")).alias("conv")
    keyed = _keyed(rows)
    timed = rows.filter("turn is not null").groupBy(key, F.col("turn").cast("bigint").alias("turn")).agg(F.lit(1).alias("one"))
    gaps = timed.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("one")).alias("gaps"))
    judged = cut(verdicts(keyed), "verdicts")
    digests = _past_audits(keyed, judged, _digest, DIGEST)
    all_ids = conversations.groupBy("conv_id").agg(F.lit(1).alias("one")).select("conv_id", key)
    found = all_ids.join(judged, "conv", "left").join(gaps, "conv", "left").join(digests, "conv", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return found.select(
        "conv_id",
        *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
