"""Binary row-change messages to change events.

Each message is parsed on its own inside the task that holds it; which table it belongs to is a
join by arrival order, so no task needs another one's state.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.lsn import lsn_format, pg_micros_to_ts, ts_to_pg_micros
from tidemark.operators.filters import dml_only, split_rejects
from tidemark.operators.joins import resolve_relations
from tidemark.operators.scale import block_count, neighbour, running
from tidemark.session import stored_copy

RELATION_SCHEMA = "seq bigint, rel_oid bigint, schema string, table string, columns array<struct<name:string,type_oid:bigint>>"
DML_SCHEMA = "seq bigint, lsn bigint, rel_oid bigint, op string, old_kinds string, old_cells array<string>, new_kinds string, new_cells array<string>, malformed string"


class Malformed(ValueError):
    """The message does not follow the layout; it yields no event."""


def _text(data: bytes, at: int) -> tuple[str, int]:
    end = data.find(b"\0", at)
    if end < 0:
        raise Malformed("unterminated text")
    return data[at:end].decode("utf-8"), end + 1


def parse_relation(data: bytes) -> tuple[int, str, str, list[dict]]:
    """Tag R: oid, schema, table, identity byte, then flag, name, type oid and modifier per column."""
    (oid,) = struct.unpack_from(">I", data, 1)
    schema, at = _text(data, 5)
    table, at = _text(data, at)
    (count,) = struct.unpack_from(">xH", data, at)
    at += 3
    columns = []
    for _ in range(count):
        name, at = _text(data, at + 1)
        type_oid, _modifier = struct.unpack_from(">II", data, at)
        at += 8
        columns.append({"name": name, "type_oid": type_oid})
    return oid, schema, table, columns


def parse_row(data: bytes, at: int) -> tuple[str, list[str | None], int]:
    """Cells from an offset: one kind letter per cell (n null, u unchanged, t text) and the texts."""
    (count,) = struct.unpack_from(">H", data, at)
    at += 2
    kinds, cells = [], []
    for _ in range(count):
        kind = data[at:at + 1]
        at += 1
        if kind == b"t":
            (size,) = struct.unpack_from(">i", data, at)
            at += 4
            if size < 0 or at + size > len(data):
                raise Malformed("cell outside the message")
            cells.append(data[at:at + size].decode("utf-8"))
            at += size
        elif kind in (b"n", b"u"):
            cells.append(None)
        else:
            raise Malformed("unknown cell kind")
        kinds.append(kind.decode())
    return "".join(kinds), cells, at


def parse_dml(data: bytes) -> tuple:
    """Tags I, U and D: relation oid, operation, and the kinds and cells of both images."""
    (oid,) = struct.unpack_from(">I", data, 1)
    old: tuple = (None, None)
    new: tuple = (None, None)
    tag, marker, at = data[:1], data[5:6], 6
    if not marker:
        raise Malformed("no row marker")
    if tag == b"I":
        kinds, cells, _ = parse_row(data, at)
        return oid, "insert", *old, kinds, cells, None
    if marker in (b"O", b"K"):
        kinds, cells, at = parse_row(data, at)
        old = (kinds, cells)
    if tag == b"D":
        if old[0] is None:
            raise Malformed("delete without an old row")
        return oid, "delete", *old, *new, None
    if old[0] is not None:
        marker, at = data[at:at + 1], at + 1
    if marker != b"N":
        raise Malformed("update without a new row")
    kinds, cells, _ = parse_row(data, at)
    return oid, "update", *old, kinds, cells, None


def _parsed(parse, arrow: pa.Schema, with_lsn: bool):
    """Parsed fields per message. Where the schema ends in ``malformed``, a message that can't be parsed
    gives a row that says why; else it gives none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            seqs, lsns = batch.column("seq").to_pylist(), batch.column("lsn").to_pylist()
            for seq, lsn, data in zip(seqs, lsns, batch.column("data").to_pylist()):
                place = (seq, lsn) if with_lsn else (seq,)
                try:
                    rows.append((*place, *parse(data)))
                except (Malformed, struct.error, UnicodeDecodeError) as problem:
                    if arrow.names[-1] == "malformed":
                        rows.append((*place, *[None] * (len(arrow) - len(place) - 1), f"malformed: {type(problem).__name__}: {problem}"))
            columns = list(zip(*rows)) if rows else [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return run


_RELATION_ARROW = pa.schema([
    ("seq", pa.int64()), ("rel_oid", pa.int64()), ("schema", pa.string()), ("table", pa.string()),
    ("columns", pa.list_(pa.struct([("name", pa.string()), ("type_oid", pa.int64())])))])
_DML_ARROW = pa.schema([
    ("seq", pa.int64()), ("lsn", pa.int64()), ("rel_oid", pa.int64()), ("op", pa.string()),
    ("old_kinds", pa.string()), ("old_cells", pa.list_(pa.string())),
    ("new_kinds", pa.string()), ("new_cells", pa.list_(pa.string())), ("malformed", pa.string())])


def relation_messages(frames: DataFrame) -> DataFrame:
    """Descriptors announced in ``frames(seq, lsn, data)``; other messages never reach Python."""
    tagged = frames.where(F.substring("data", 1, 1).cast("string") == "R")
    return tagged.select("seq", "lsn", "data").mapInArrow(_parsed(parse_relation, _RELATION_ARROW, False), RELATION_SCHEMA)


def dml_messages(frames: DataFrame) -> DataFrame:
    """Parsed row changes; ``malformed`` says why a message holds none (it then has no other field)."""
    return dml_only(frames).select("seq", "lsn", "data").mapInArrow(_parsed(parse_dml, _DML_ARROW, True), DML_SCHEMA)


def _image(kinds: str, cells: str) -> Column:
    """Map of the cells by column name, unchanged cells left out."""
    width = F.size("columns")
    at = F.sequence(F.lit(1), F.greatest(width, F.lit(1)))
    entries = F.transform(at, lambda i: F.struct(
        F.try_element_at("columns", i)["name"].alias("key"), F.try_element_at(cells, i).alias("value"),
        F.substring(F.col(kinds), i, F.lit(1)).alias("kind")))
    sent = F.filter(entries, lambda e: e["key"].isNotNull() & (e["kind"] != "u"))
    pairs = F.transform(sent, lambda e: F.struct(e["key"], e["value"]))
    return F.when(F.col(kinds).isNotNull() & (F.length(kinds) == width), F.map_from_entries(pairs))


def resolve_events(dml: DataFrame, relations: DataFrame) -> DataFrame:
    """Events of parsed row changes; ``reject`` names why a change cannot become one."""
    known = resolve_relations(dml, relations, keep_unknown=True)
    width = F.size("columns")
    fits = lambda kinds: F.col(kinds).isNull() | (F.length(kinds) == width)
    reject = (
        F.when(F.col("malformed").isNotNull(), F.col("malformed")).when(F.col("table").isNull(), "unknown relation")
        .when(~(fits("old_kinds") & fits("new_kinds")), "column count mismatch")
    )
    types = F.map_from_entries(F.transform("columns", lambda c: F.struct(c["name"], c["type_oid"].cast("int"))))
    return known.select(
        "seq", "lsn", lsn_format(F.col("lsn")).alias("lsn_text"), "op", "schema", "table",
        _image("old_kinds", "old_cells").alias("old"), _image("new_kinds", "new_cells").alias("new"),
        types.alias("types"), reject.alias("reject"))


def decode_pgoutput(frames: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """Change events of a log of frames ``(seq, lsn, data)``. Descriptors come from the frames
    themselves, plus ``relations`` known from before."""
    # few rows out of a large log: kept as a table, so that the join knows their size
    own = stored_copy(relation_messages(frames), "relations")
    known = own if relations is None else own.unionByName(relations)
    events, _ = split_rejects(resolve_events(dml_messages(frames), known))
    return events


# Lengths of the messages that open and close a transaction.
BEGIN_BYTES, COMMIT_BYTES = 21, 26


def transaction_brackets(frames: DataFrame, group: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """``(group, seq, kind, xid, commit_ts, committed)`` of the messages that open (B) and close (C) a
    transaction. A transaction is committed if the next bracket of its log closes it; its time is the
    closing one's. The fields stand at fixed places, so nothing is parsed in Python."""
    number = lambda at, size: F.conv(F.hex(F.substring("data", at, size)), 16, 10).try_cast("bigint")
    kind = F.substring("data", 1, 1).cast("string")
    size = F.octet_length("data")
    marks = frames.where(((kind == "B") & (size == BEGIN_BYTES)) | ((kind == "C") & (size == COMMIT_BYTES)))
    opens = kind == "B"
    marks = marks.select(*group, "seq", kind.alias("kind"), F.when(opens, number(18, 4)).alias("xid"),
                         pg_micros_to_ts(F.when(opens, number(10, 8)).otherwise(number(19, 8))).alias("commit_ts"))
    ahead = neighbour(marks, list(group), ["seq"], {"_kind": F.col("kind"), "_ts": F.col("commit_ts")}, following=True, blocks=blocks)
    committed = (F.col("kind") == "B") & F.coalesce(F.col("_kind") == "C", F.lit(False))
    return ahead.select(*group, "seq", "kind", "xid", F.when(committed, F.col("_ts")).otherwise(F.col("commit_ts")).alias("commit_ts"), committed.alias("committed"))


# Source bytes of a block of decoded events, which are many times as wide as their frames.
EVENT_BLOCK_BYTES = 8 << 20


def with_transactions(events: DataFrame, frames: DataFrame, group: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """Events with ``xid``, ``commit_ts`` and ``bracket``: committed, open (the log ends, or begins another
    transaction, before it is closed) or outside. Brackets and events are put in one order of arrival,
    and each event sees the newest bracket before it."""
    marks = transaction_brackets(frames, group, blocks).select(
        *group, "seq", F.lit(0).alias("_rank"), F.struct("kind", "xid", "commit_ts", "committed").alias("_mark"))
    base = events.drop("xid", "commit_ts", "bracket")
    rows = base.select(*group, F.col("seq").cast("bigint").alias("seq"), F.lit(1).alias("_rank"), F.struct("*").alias("_event"))
    line = rows.unionByName(marks, allowMissingColumns=True)
    if not blocks:
        line, blocks = block_count(line, EVENT_BLOCK_BYTES)
    seen = running(line, list(group), ["seq", "_rank"], {"_seen": ("last", F.col("_mark"))}, blocks).where("_rank = 1")
    inside = F.col("_seen.kind") == "B"
    bracket = F.when(inside & F.col("_seen.committed"), "committed").when(inside, "open").otherwise("outside")
    return seen.select("_event.*", F.when(inside, F.col("_seen.xid")).alias("xid"),
                       F.when(inside & F.col("_seen.committed"), F.col("_seen.commit_ts")).alias("commit_ts"), bracket.alias("bracket"))


def committed_events(frames: DataFrame, relations: DataFrame | None = None, group: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """Decoded events of committed transactions, with ``commit_ts`` and ``xid``: what a table can be rebuilt
    from at any position or time. Changes of transactions that are still open are left to a later read."""
    events = with_transactions(decode_pgoutput(frames, relations), frames, group, blocks)
    return events.where(F.col("bracket") == "committed").drop("bracket")


def encode_brackets(rows: DataFrame) -> DataFrame:
    """Frames that open and close transactions, from rows ``(seq, lsn, tag, xid, commit_ts)``."""
    number = lambda value, digits: F.unhex(F.lpad(F.hex(value.cast("bigint")), digits, "0"))
    ts, at = number(ts_to_pg_micros(F.col("commit_ts")), 16), number(F.col("lsn"), 16)
    opening = F.concat(F.lit("B").cast("binary"), at, ts, number(F.col("xid"), 8))
    closing = F.concat(F.lit("C").cast("binary"), F.unhex(F.lit("00")), at, at, ts)
    return rows.select("seq", "lsn", F.when(F.col("tag") == "B", opening).otherwise(closing).alias("data"))


def encode_frames(rows: DataFrame) -> DataFrame:
    """Frames from rows ``(seq, lsn, tag, rel_oid, old, new)`` whose images are arrays of
    ``struct(kind, value)``: the inverse of parsing, as expressions, for replays and tests."""
    def number(value: Column, digits: int) -> Column:
        return F.unhex(F.lpad(F.hex(value.cast("bigint")), digits, "0"))

    def row(image: str) -> Column:
        cells = F.transform(image, lambda c: F.when(
            c["kind"] == "t",
            F.concat(F.lit("74"), F.lpad(F.hex(F.octet_length(c["value"]).cast("bigint")), 8, "0"), F.hex(c["value"]))
        ).otherwise(F.hex(c["kind"])))
        return F.concat(number(F.size(image), 4), F.unhex(F.array_join(cells, "")))

    nothing = F.lit("").cast("binary")
    old = F.when(F.col("old").isNotNull(), F.concat(F.lit("K").cast("binary"), row("old"))).otherwise(nothing)
    new = F.when(F.col("new").isNotNull(), F.concat(F.lit("N").cast("binary"), row("new"))).otherwise(nothing)
    return rows.select("seq", "lsn", F.concat(
        F.col("tag").cast("binary"), number(F.col("rel_oid"), 8), old, new).alias("data"))


def encode_relations(relations: DataFrame) -> DataFrame:
    """Descriptor frames from rows ``(seq, lsn, rel_oid, schema, table, columns)``."""
    def number(value: Column, digits: int) -> Column:
        return F.unhex(F.lpad(F.hex(value.cast("bigint")), digits, "0"))

    text = lambda c: F.concat(c.cast("binary"), F.unhex(F.lit("00")))
    columns = F.unhex(F.array_join(F.transform("columns", lambda c: F.concat(
        F.lit("00"), F.hex(c["name"]), F.lit("00"), F.lpad(F.hex(c["type_oid"].cast("bigint")), 8, "0"), F.lit("FFFFFFFF"))), ""))
    return relations.select("seq", "lsn", F.concat(
        F.lit("R").cast("binary"), number(F.col("rel_oid"), 8), text(F.col("schema")), text(F.col("table")),
        F.lit("d").cast("binary"), number(F.size("columns"), 4), columns).alias("data"))
