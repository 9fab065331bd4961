"""Repair of the structure of conversations at least cost.

A conversation is legal if the initials of its rows' roles are ``(s?(ua)+)?``:
nothing, or turns of user and assistant after a system row at most.

1. Rows are sorted by conversation and turn over all tasks, so that a very long
   conversation is spread like any other rows, and are marked: blank, duplicate,
   truncated.
2. Marks are cut into units of bounded length and dealt to batches by a hash.  In
   each batch a recursive DuckDB query advances one turn of all units in each
   recursion, and keeps the least cost, and the edits that reach it, for each
   state of the grammar.  A unit within a conversation does so from each state
   that it may be entered in.
3. Units are joined in order by the same recursion: their results are its turns.
   Of edits of equal cost the ASCII-least are kept.  Edits over the same rows at
   equal cost never begin with each other, so the least of the whole is made of
   the least of its parts.
4. The edits are carried out on the rows in a last pass, in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from discloom.llm.support import cut

#: White space as in words: text of these alone is blank.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: Rows of a unit, units joined at once, and rows of a batch.
UNIT, FAN_IN, BATCH_ROWS = 256, 64, 20_000

#: States of the grammar: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an assistant row.
#: Rows that are put in before a row are at most two: more never are the cheapest way.
STEPS_SQL = """
    WITH inserts(s, m, letters, cost) AS (
        VALUES (0, 0, '', 0), (1, 1, '', 0), (2, 2, '', 0), (3, 3, '', 0),
            (0, 2, 'I', 2), (1, 2, 'I', 2), (3, 2, 'I', 2), (2, 3, 'I', 2), (0, 3, 'II', 4), (1, 3, 'II', 4)
    ), edits(m, t, initial, letter, cost) AS (
        VALUES (0, 1, 's', 'K', 0), (0, 2, 'u', 'K', 0), (1, 2, 'u', 'K', 0), (3, 2, 'u', 'K', 0), (2, 3, 'a', 'K', 0),
            (0, 2, NULL, 'R', 2), (1, 2, NULL, 'R', 2), (3, 2, NULL, 'R', 2), (2, 3, NULL, 'R', 2),
            (0, 0, NULL, 'D', 3), (1, 1, NULL, 'D', 3), (2, 2, NULL, 'D', 3), (3, 3, NULL, 'D', 3)
    ), moves AS (
        SELECT s, t, initial, letter, letters || letter AS audit, inserts.cost + edits.cost AS cost FROM inserts JOIN edits USING (m)
    )
    SELECT unit, i, s, t, min({'cost': CAST(cost + (letter <> 'D' AND fault = 'truncated')::INT AS BIGINT), 'audit': audit}) AS best
    FROM turns JOIN moves ON coalesce(moves.initial, turns.initial) = turns.initial AND (letter = 'D' OR fault NOT IN ('blank', 'duplicate'))
    GROUP BY ALL
"""
ADVANCE_SQL = """
    WITH RECURSIVE reached AS (
        SELECT unit, 0 AS i, s AS entry, s, {'cost': 0::BIGINT, 'audit': ''} AS best FROM entries
        UNION ALL
        SELECT reached.unit, reached.i + 1, entry, t, min({'cost': reached.best.cost + steps.best.cost, 'audit': reached.best.audit || steps.best.audit})
        FROM reached JOIN steps ON steps.unit = reached.unit AND steps.i = reached.i + 1 AND steps.s = reached.s GROUP BY ALL
    )
    SELECT unit, entry AS s, s AS t, best.cost AS cost, best.audit AS audit FROM reached JOIN (SELECT unit, max(i) AS i FROM steps GROUP BY unit) USING (unit, i)
"""
MOVES = "conv string, unit long, s int, t int, cost long, audit string"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, with the task's number, their number in its part of the conversation, and the initial before.

    ``inner`` tells that the conversation may have begun in an earlier task.
    """
    part, last, before, n, inner = TaskContext.get().partitionId(), None, None, 0, True
    for b in batches:
        if not b.num_rows:
            continue
        conv, initial = b.column(0), b.column(1)
        new = np.ones(b.num_rows, bool)
        new[1:] = pc.not_equal(conv.slice(1), conv.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        new[0] = conv[0].as_py() != last
        at = np.arange(b.num_rows)
        start = np.maximum.accumulate(np.where(new, at, -1))
        number = np.where(start < 0, at + n, at - start)
        # The first conversation of the task lasts until the first that is another.
        others = np.flatnonzero(new if last is not None else np.concatenate([[False], new[1:]])) if inner else at[:1]
        first = others[0] if len(others) else b.num_rows
        inside = (at < first) & (part > 0) if inner else np.zeros(b.num_rows, bool)
        inner = inner and not len(others)
        prior = [before, *initial.slice(0, b.num_rows - 1).to_pylist()]
        prior = pa.array(prior, pa.string(), mask=new)
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(number), prior, pa.array(inside)],
            ["conv", "initial", "turn", "role", "text", "conv_id", "part", "j", "prior", "inner"],
        )
        last, before, n = conv[b.num_rows - 1].as_py(), initial[b.num_rows - 1].as_py(), int(number[-1]) + 1


def _batches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about so many rows, of whole groups of rows with equal first two columns, which are in order."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held)
        last = [t.column(i)[-1].as_py() for i in (0, 1)]
        same = pc.and_(pc.equal(t.column(0), last[0]), pc.equal(t.column(1), last[1]))
        whole = t.num_rows - pc.sum(same).as_py()
        if whole:
            yield t.slice(0, whole)
            held, n = t.slice(whole).to_batches(), t.num_rows - whole
    if n:
        yield pa.Table.from_batches(held)


def _advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least costs of units: of rows ``conv, unit, i, inner`` with ``initial, fault`` or, of units, with ``s, t, cost, audit``."""
    import duckdb

    for table in _batches(batches, BATCH_ROWS):
        keys = table.group_by(["conv", "unit"], use_threads=False).aggregate([("inner", "max")])
        keys = keys.append_column("number", pa.array(np.arange(keys.num_rows)))
        with duckdb.connect(config={"threads": 1, "memory_limit": "400MB"}) as con:
            con.register("rows", table)
            con.register("keys", keys)
            con.execute("CREATE VIEW turns AS SELECT number AS unit, rows.* EXCLUDE (conv, unit) FROM rows JOIN keys USING (conv, unit)")
            given = "SELECT unit, i, s, t, {'cost': cost, 'audit': audit} AS best FROM turns"
            con.execute(f"CREATE TABLE steps AS {given if 'audit' in table.column_names else STEPS_SQL}")
            con.execute("CREATE TABLE entries AS SELECT number AS unit, unnest(CASE WHEN inner_max THEN [0, 1, 2, 3] ELSE [0] END) AS s FROM keys")
            query = f"SELECT conv, keys.unit, s::INT AS s, t::INT AS t, cost, audit FROM ({ADVANCE_SQL}) found JOIN keys ON number = found.unit"
            found = con.sql(query).to_arrow_table()
        kinds = pa.schema([("conv", pa.string()), ("unit", pa.int64()), ("s", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
        yield from found.cast(kinds).to_batches()


def _dealt(rows: DataFrame) -> DataFrame:
    """Least costs of units that are dealt to batches by a hash."""
    return cut(rows.repartition("conv", "unit").sortWithinPartitions("conv", "unit", "i").mapInArrow(_advance, MOVES))


def _carried_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows: of rows in order, each after the edits that end with its own."""
    conv = piece = None
    state, place = 0, 0
    names = ["conv", "place", "edit", "role", "text"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    for b in batches:
        out: list[tuple] = []
        for name, edits, role, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if name != conv:
                conv, state, place = name, 0, 0
            if edits is not None:
                for _ in range(edits.count("I")):
                    state = 3 if state == 2 else 2
                    out.append((conv, place, "I", "assistant" if state == 3 else "user", ""))
                    place += 1
                piece = edits[-1]
            elif piece != "D":
                state = 1 if piece == "K" and role[:1] == "s" else 3 if state == 2 else 2
                out.append((conv, place, piece, role if piece == "K" else "assistant" if state == 3 else "user", text))
                place += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of repaired rows in order: a hash of each conversation's ``role:text`` lines, in bounded memory."""
    conv, state = None, hashlib.sha256()

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.string()), pa.array([state.hexdigest()])], ["conv", "sha256"])

    for b in batches:
        for name, place, role, text in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
            if name != conv:
                if conv is not None:
                    yield made()
                conv, state = name, hashlib.sha256()
            state.update(f"{chr(10) if place else ''}{role}:{text}".encode())
    if conv is not None:
        yield made()


@dataclass
class Repair:
    """``report`` has a row for each conversation, ``rows`` the repaired rows in order within tasks."""

    report: DataFrame
    rows: DataFrame

    def digests(self) -> DataFrame:
        """``conv, sha256`` of the repaired rows as lines ``role:text``; conversations without any have none."""
        return self.rows.mapInArrow(_digests, "conv string, sha256 string")


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """Faults of conversations and the cheapest edits that make them legal.

    A conversation's rows are taken by turn, null turns first, rows of one turn by
    role and text.  Null roles and texts count as one space; a null conversation
    is one of its own.  A row's fault is the first of: blank (no text but white
    space), duplicate (role and text seen earlier), truncated (the text doesn't end
    in ``.``, ``!`` or ``?``).  Edits: keep (K) for nothing, give the role of user or
    assistant (R) for 2, delete (D) for 3, which blank and duplicate rows need, and
    put in an empty row of user or assistant (I) for 2; truncated rows that stay
    cost 1 more.  A role without letters fits nowhere and is not kept.

    ``report``: ``conv, conv_id, gaps, blank, duplicate, truncated, illegal`` (rows
    whose role can't follow the role before), ``cost`` and ``audit``, the letters of
    the cheapest edits in order, the ASCII-least of equal cost.  ``rows``: ``conv,
    place, edit, role, text``.  Conversations of any length are cut into units; one's
    repaired rows are made in order by one task, which holds none of them.  An empty
    table gives no rows; other columns are ignored.
    """
    key = F.when(F.col(conv_id).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(conv_id).cast("string")))
    own = rows.select(
        key.alias("conv"),
        F.substring(F.coalesce(F.col(role), F.lit(" ")), 1, 1).alias("initial"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
        F.col(conv_id).alias("conv_id"),
    )
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    kind = rows.schema[conv_id].dataType.simpleString()
    schema = f"conv string, initial string, turn long, role string, text string, conv_id {kind}, part int, j long, prior string, inner boolean"
    placed = cut(own.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, schema))

    # Faults.  Of rows with equal role and text all but the first are duplicates.
    trimmed = F.rtrim("text", F.lit(SPACE))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    marks = placed.select(
        "conv", "part", "j", "inner", "turn", "initial", "prior", "conv_id", digest.alias("digest"), (trimmed == "").alias("empty"), F.right(trimmed, F.lit(1)).isin(".", "!", "?").alias("ended")
    )
    repeated = marks.groupBy("conv", "digest").agg(F.count("*").alias("n"), F.min(F.struct("part", "j")).alias("first")).filter("n > 1")
    repeated = cut(repeated.select("conv", "digest", "first"))
    fault = F.expr("case when empty then 'blank' when first is not null and first <> struct(part, j) then 'duplicate' when not ended then 'truncated' else '' end")
    marks = cut(marks.join(repeated, ["conv", "digest"], "left").withColumn("fault", fault).drop("digest", "first", "empty", "ended"))

    # Parts of a conversation that lie in several tasks: numbers and initials carry over.
    ends = marks.groupBy("conv", "part").agg(F.count("*").alias("n"), F.min_by("initial", "j").alias("low"), F.max_by("initial", "j").alias("high"), F.max("inner").alias("inner"))
    several = ends.join(ends.filter("inner").select("conv").distinct(), "conv")  # at most one for each task
    parts = Window.partitionBy("conv").orderBy("part")
    before = F.coalesce(F.sum("n").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = cut(several.select("conv", "part", before.alias("before"), "low", F.lag("high").over(parts).alias("high")))
    seams = carried.filter("concat(high, low) not in ('su', 'ua', 'au')").groupBy("conv").agg(F.count("*").alias("seams"))

    # Units, batch by batch; then units of units, until each conversation is one.
    units = marks.select("conv", F.struct("part", F.expr(f"j div {UNIT}").alias("block")).alias("u"), F.expr(f"j % {UNIT} + 1").cast("int").alias("i"), (F.col("inner") | (F.col("j") >= UNIT)).alias("inner"), "initial", "fault")
    found = _dealt(units.select("conv", F.expr("u.part * 1000000000000L + u.block").alias("unit"), "i", "inner", "initial", "fault"))
    rank = F.dense_rank().over(Window.partitionBy("conv").orderBy("unit")).cast("long") - 1
    found = cut(found.withColumn("unit", rank))
    while (most := found.agg(F.max("unit")).first()[0] or 0) > 0:
        open_ones = found.filter("unit > 0").select("conv").distinct()
        mixed = found.join(open_ones, "conv").withColumn("i", (F.col("unit") % FAN_IN + 1).cast("int")).withColumn("unit", F.expr(f"unit div {FAN_IN}"))
        joined = _dealt(mixed.select("conv", "unit", "i", (F.col("unit") > 0).alias("inner"), "s", "t", "cost", "audit"))
        found = cut(found.join(open_ones, "conv", "left_anti").union(joined)) if most >= FAN_IN else found.join(open_ones, "conv", "left_anti").union(joined)
    end = F.expr("case t when 1 then 'II' when 2 then 'I' else '' end")
    best = found.filter("s = 0").groupBy("conv").agg(F.min(F.struct((F.col("cost") + 2 * F.length(end)).alias("cost"), F.concat("audit", end).alias("audit"))).alias("best"))
    best = cut(best.select("conv", "best.*"))

    illegal = F.expr("prior is not null and concat(prior, initial) not in ('su', 'ua', 'au')")
    report = marks.groupBy("conv").agg(
        F.first("conv_id").alias("conv_id"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        *(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")),
        F.count_if(illegal).alias("illegal"),
    )
    report = report.join(seams, "conv", "left").join(best, "conv")
    report = report.withColumn("illegal", F.col("illegal") + F.coalesce("seams", F.lit(0))).drop("seams")

    # Edits of each row come before it; those after the last row are an item of their own.
    pieces = best.select("conv", F.posexplode(F.regexp_extract_all("audit", F.lit("I*[KRD]|I+"), F.lit(0))).alias("k", "edits"))
    pieces = pieces.select("conv", F.col("k").cast("long").alias("k"), F.lit(0).alias("own"), "edits", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    texts = placed.join(F.broadcast(carried.select("conv", "part", "before")), ["conv", "part"], "left")
    texts = texts.select("conv", (F.col("j") + F.coalesce("before", F.lit(0))).alias("k"), F.lit(1).alias("own"), F.lit(None).cast("string").alias("edits"), "role", "text")
    both = pieces.union(texts).repartition("conv").sortWithinPartitions("conv", "k", "own")
    repaired = both.select("conv", "edits", "role", "text").mapInArrow(_carried_out, "conv string, place long, edit string, role string, text string")
    return Repair(report, repaired)
