"""Rebuilding tables from change events.

Events carry ``lsn, seq, op, schema, table, old, new`` (and ``commit_ts`` for targets in time).
``seq`` is the arrival number and breaks ties between equal positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.scale import running
from tidemark.session import cut_lineage

CELL, LAST_OP, LAST_INSERT = 0, 1, 2

# Tables with more columns than this are rebuilt cell by cell.
WIDE_TABLE = 200


def until(changes: DataFrame, until_lsn: int | None = None, until_ts=None) -> DataFrame:
    """Keep events up to a position or commit time, the target included."""
    if until_lsn is not None:
        changes = changes.where(F.col("lsn") <= until_lsn)
    if until_ts is not None:
        changes = changes.where(F.col("commit_ts") <= F.lit(until_ts))
    return changes


def _key_of(image: str, key: Sequence[str]) -> Column:
    return F.struct(*[F.try_element_at(image, F.lit(k)).alias(k) for k in key])


def _moves(key: Sequence[str]) -> Column:
    """Whether an update changed the key: the log then sends the old key."""
    sent = (F.col("op") == "update") & F.col("old").isNotNull()
    for k in key:
        sent = sent & F.map_contains_key("old", k)
    return sent & (_key_of("new", key) != _key_of("old", key))


def _kept_old(key: Sequence[str]) -> Column:
    """Cells of a full old image that the new one leaves out. A key-only old image holds nulls for
    the columns outside the key, which say nothing."""
    full = F.size(F.map_filter("old", lambda c, v: v.isNotNull() & ~c.isin(*key))) > 0
    return F.map_filter("old", lambda c, _: full & ~F.map_contains_key("new", c))


def _missing(changes: DataFrame, key: Sequence[str]) -> Column:
    """Columns of the table that a moved row was sent neither in the new nor in the old image."""
    none = F.array().cast("array<string>")
    if "types" not in changes.columns:
        return none
    sent = F.concat(F.map_keys("new"), F.map_keys(_kept_old(key)))
    return F.coalesce(F.array_except(F.map_keys("types"), sent), none)


def _told(changes: DataFrame, key: Sequence[str]) -> tuple[Column, Column]:
    """Whether a row changed its key, and whether it lacks columns then."""
    moved = F.coalesce(_moves(key), F.lit(False))
    return moved, moved & (F.size(_missing(changes, key)) > 0)


def moved_rows(changes: DataFrame, key: Sequence[str]) -> tuple[bool, bool]:
    """Whether any row changed its key, and whether any of these lacks columns: one scan."""
    moved, lacking = _told(changes, key)
    row = changes.agg(F.max(moved), F.max(lacking)).first()
    return bool(row[0]), bool(row[1])


def keyed_events(changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows ``(k, pos, op, image, from_k, missing)``, ``k`` the key cells as a struct. An update that
    changes the key becomes a delete of the old key and an insert of the new one; cells the log did
    not send for it are taken from the old image, and columns it sent in neither are ``missing``."""
    no_image, no_columns = F.lit(None).cast("map<string,string>"), F.array().cast("array<string>")
    old_key, new_key = _key_of("old", key), _key_of("new", key)
    plain_key = F.when(F.col("op") == "delete", old_key).otherwise(new_key)

    def step(k: Column, place: int, op: Column, image: Column, from_k: Column, lacking: Column) -> Column:
        pos = F.struct("lsn", "seq", F.lit(place).alias("step"))
        return F.struct(k.alias("k"), pos.alias("pos"), op.alias("op"), image.alias("image"),
                        from_k.alias("from_k"), lacking.alias("missing"))

    nobody = F.when(F.lit(False), old_key)
    steps = F.when(_moves(key), F.array(
        step(old_key, 0, F.lit("delete"), no_image, nobody, no_columns),
        step(new_key, 1, F.lit("insert"), F.map_concat(_kept_old(key), "new"), old_key, _missing(changes, key)),
    )).otherwise(F.array(step(
        plain_key, 0, F.col("op"), F.when(F.col("op") != "delete", F.col("new")), nobody, no_columns,
    )))
    return changes.select(F.inline(steps))


def completed_events(
    changes: DataFrame, key: Sequence[str], earlier: DataFrame | None = None, moves: tuple[bool, bool] | None = None,
) -> DataFrame:
    """Rows ``(k, pos, op, image)`` with moved rows split and their images filled. Most logs have no
    moved rows, and then each event is one row as it is. ``moves`` is what ``moved_rows`` tells, where
    that is known."""
    moved, lacking = moves or moved_rows(changes, key)
    if moved:
        events = keyed_events(changes, key)
        if lacking:
            events = complete_moves(events, earlier)
        return events.select("k", "pos", "op", "image")
    removed = F.col("op") == "delete"
    return changes.select(
        F.when(removed, _key_of("old", key)).otherwise(_key_of("new", key)).alias("k"),
        F.struct("lsn", "seq", F.lit(0).alias("step")).alias("pos"), "op", F.when(~removed, F.col("new")).alias("image"))


def _by_key(df: DataFrame, key: Sequence[str], *more: str):
    """Group by the key cells themselves, which sort by their prefix; a struct does not."""
    return df.groupBy(*[F.col(f"k.{c}").alias(f"_k{i}") for i, c in enumerate(key)], *more)


def _key_struct(key: Sequence[str]) -> Column:
    return F.struct(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(key)]).alias("k")


def complete_moves(events: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Fill the missing columns of rows that moved to another key with what the old key held just
    before. Only keys that rows moved from are looked at. A row that moved several times is filled
    in as many rounds. ``earlier`` holds folded cells from before these events."""
    asked = events.where(F.size("missing") > 0).select("k", "pos", "from_k", F.explode("missing").alias("col"))
    asked = cut_lineage(asked)
    filled = None
    sources = asked.select(F.col("from_k").alias("k"), "col").distinct()
    mine = events.join(sources.select("k").distinct(), "k", "left_semi")
    sent = mine.where(F.col("image").isNotNull()).select("k", "pos", F.explode("image").alias("col", "value"))
    births = mine.where(F.col("op") == "insert").join(sources, "k")
    starts = births.where(~F.array_contains("missing", F.col("col"))).select("k", "pos", "col")
    no_value = F.lit(None).cast("string")
    # what is known of a source column over time: its cells, and nothing at the start of a life
    facts = sent.join(sources, ["k", "col"], "left_semi").select("k", "col", "pos", F.lit(1).alias("rank"), F.struct(F.lit("cell").alias("fact"), "value").alias("what"))
    facts = facts.unionByName(starts.select("k", "col", "pos", F.lit(0).alias("rank"), F.struct(F.lit("start").alias("fact"), no_value.alias("value")).alias("what")))
    if earlier is not None:
        old = earlier.join(sources.select("k").distinct(), "k", "left_semi")
        first = F.struct(F.lit(-1).cast("bigint").alias("lsn"), F.lit(-1).cast("bigint").alias("seq"), F.lit(0).alias("step"))
        state = table_from_cells(old).select("k", F.explode("image").alias("col", "value"))
        facts = facts.unionByName(state.select("k", "col", first.alias("pos"), F.lit(1).alias("rank"), F.struct(F.lit("cell").alias("fact"), "value").alias("what")))
    facts = cut_lineage(facts)
    while True:
        waiting = asked.select("k", "col", "pos", F.lit(0).alias("rank"), F.struct(F.lit("waiting").alias("fact"), no_value.alias("value")).alias("what"))
        asking = asked.select(F.col("from_k").alias("k"), "col", "pos", F.lit(-1).alias("rank"),
                              F.lit(None).cast("struct<fact:string,value:string>").alias("what"), F.col("k").alias("to_k"))
        line = facts.unionByName(waiting).unionByName(asking, allowMissingColumns=True).withColumn("lsn", F.col("pos.lsn"))
        answers = running(line, ["k", "col"], ["lsn", "pos", "rank"], {"answer": ("last", F.col("what"))})
        answered = cut_lineage(answers.where(F.col("rank") == -1).select(
            F.col("to_k").alias("k"), "col", "pos", F.col("k").alias("from_k"), "answer"))
        ready = answered.where(F.col("answer").isNull() | (F.col("answer.fact") != "waiting"))
        found = ready.select("k", "col", "pos", F.coalesce("answer", F.struct(F.lit("start").alias("fact"), no_value.alias("value"))).alias("what"))
        filled = found if filled is None else filled.unionByName(found)
        asked = answered.where(F.col("answer.fact") == "waiting").select("k", "pos", "from_k", "col")
        if asked.isEmpty():
            break
        facts = facts.unionByName(found.select("k", "col", "pos", F.lit(1).alias("rank"), "what"))
    cells = filled.where(F.col("what.fact") == "cell")
    # as many entries as the row has missing columns
    images = cells.groupBy("k", "pos").agg(F.map_from_entries(F.collect_list(F.struct("col", "what.value"))).alias("carried"))
    joined = events.join(images, ["k", "pos"], "left")
    return joined.withColumn("image", F.when(F.col("carried").isNotNull(), F.map_concat("image", "carried")).otherwise(F.col("image"))).drop("carried")


def survey(changes: DataFrame, key: Sequence[str]) -> tuple[list[str] | None, tuple[bool, bool]]:
    """Names of the columns the log holds, or nothing when they are more than WIDE_TABLE, and what
    ``moved_rows`` tells, in one scan. The driver gets a few more than WIDE_TABLE names at most; logs of
    more columns are scanned once more."""
    moved, lacking = _told(changes, key)
    cells = changes.select(F.explode_outer(F.map_keys("new")).alias("c"), moved.alias("m"), lacking.alias("l"))
    found = cells.groupBy("c").agg(F.max("m").alias("m"), F.max("l").alias("l")).limit(WIDE_TABLE + 2).collect()
    names = sorted(r.c for r in found if r.c is not None)
    if len(names) > WIDE_TABLE:
        return None, moved_rows(changes, key)
    return names, (any(r.m for r in found), any(r.l for r in found))


def newest_per_key(events: DataFrame, key: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per key: newest operation, newest insert, and per column its newest cell."""
    cell = {c: F.struct("pos", F.try_element_at("image", F.lit(c)).alias("value")) for c in names}
    return _by_key(events, key).agg(
        F.max(F.struct("pos", F.col("op").alias("value"))).alias("_last"),
        F.max(F.when(F.col("op") == "insert", F.col("pos"))).alias("_born"),
        *[F.max(F.when(F.map_contains_key("image", c), cell[c])).alias(f"_c{i}") for i, c in enumerate(names)])


def fold_cells(changes: DataFrame, key: Sequence[str], earlier: DataFrame | None = None) -> DataFrame:
    """Newest cell per key and column, plus the newest operation and the newest insert per key:
    rows ``(k, kind, col, top(pos, value))``. Folding folds of parts again gives the fold of the
    whole, so the newest value survives partial aggregation, shuffles and incremental batches."""
    names, moves = survey(changes, key)
    events = completed_events(changes, key, earlier, moves)
    no_value = F.lit(None).cast("string")

    def entry(kind: int, col: Column, top: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), col.alias("col"), top.alias("top"))

    def top(pos: Column, value: Column) -> Column:
        return F.struct(pos.alias("pos"), value.alias("value"))

    if names is not None:
        newest = newest_per_key(events, key, names)
        born = F.when(F.col("_born").isNotNull(), entry(LAST_INSERT, F.lit(""), top(F.col("_born"), no_value)))
        cells = [F.when(F.col(f"_c{i}").isNotNull(), entry(CELL, F.lit(c), F.col(f"_c{i}"))) for i, c in enumerate(names)]
        entries = F.array_compact(F.array(entry(LAST_OP, F.lit(""), F.col("_last")), born, *cells))
        return newest.select(_key_struct(key), F.inline(entries))
    pos = F.col("pos")
    sent = F.transform(F.map_entries("image"), lambda e: entry(CELL, e["key"], top(pos, e["value"])))
    last = F.array(entry(LAST_OP, F.lit(""), top(pos, F.col("op"))))
    born = F.filter(F.array(entry(LAST_INSERT, F.lit(""), top(pos, no_value))), lambda _: F.col("op") == "insert")
    exploded = events.select("k", F.inline(F.concat(F.coalesce(sent, F.slice(last, 1, 0)), last, born)))
    return merge_cells(exploded)


def merge_cells(cells: DataFrame) -> DataFrame:
    key = cells.schema["k"].dataType.names
    return _by_key(cells, key, "kind", "col").agg(F.max("top").alias("top")).select(_key_struct(key), "kind", "col", "top")


def table_from_cells(cells: DataFrame) -> DataFrame:
    """Rows ``(k, image, complete)`` of the live keys. A cell counts only if it is not older than
    the key's newest insert; ``complete`` is false when the log holds no insert of the key."""
    def newest(kind: int) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col("top")))

    cell = F.struct("col", F.col("top.pos").alias("pos"), F.col("top.value").alias("value"))
    per_key = cells.groupBy("k").agg(
        newest(LAST_OP)["value"].alias("op"), newest(LAST_INSERT)["pos"].alias("born"),
        # as long as the table has columns, whatever the length of the key's history
        F.collect_list(F.when(F.col("kind") == CELL, cell)).alias("cells"),
    ).where(F.col("op") != "delete")
    alive = F.filter("cells", lambda c: F.col("born").isNull() | (c["pos"] >= F.col("born")))
    entries = F.transform(F.array_sort(alive), lambda c: F.struct(c["col"], c["value"]))
    return per_key.select("k", F.map_from_entries(entries).alias("image"), F.col("born").isNotNull().alias("complete"))


def table_as_of(
    changes: DataFrame, key: Sequence[str], until_lsn: int | None = None, until_ts=None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """State of a table at an inclusive target: deleted keys removed, unchanged columns carried
    forward. With ``columns`` the result has one text column each; without, the image is a map of
    whatever columns the log holds. Partial aggregation runs before the shuffle, so a key with a
    long history costs no more than others. Logs of very many columns go through folded cells."""
    history = until(changes, until_lsn, until_ts)
    names, moves = (columns, None) if columns is not None else survey(history, key)
    if names is None:
        return table_from_cells(fold_cells(history, key)).select("k.*", "image", "complete")
    newest = newest_per_key(completed_events(history, key, moves=moves), key, names).where(F.col("_last.value") != "delete")
    own_key = [F.col(f"_k{i}").alias(k) for i, k in enumerate(key)]
    complete = F.col("_born").isNotNull().alias("complete")

    def alive(i: int) -> Column:
        return F.col(f"_c{i}").isNotNull() & (F.col("_born").isNull() | (F.col(f"_c{i}.pos") >= F.col("_born")))

    if columns is not None:
        values = [F.when(alive(i), F.col(f"_c{i}.value")).alias(c) for i, c in enumerate(names) if c not in key]
        return newest.select(*own_key, *values, complete)
    entries = [F.when(alive(i), F.struct(F.lit(c).alias("key"), F.col(f"_c{i}.value").alias("value"))) for i, c in enumerate(names)]
    image = F.map_from_entries(F.array_compact(F.array(*entries))) if entries else F.create_map().cast("map<string,string>")
    return newest.select(*own_key, image.alias("image"), complete)


def snapshot_events(snapshot: DataFrame, snapshot_lsn: int, schema: str, table: str) -> DataFrame:
    """A base image as inserts at its position; every column becomes a text cell."""
    cells = [x for c in snapshot.columns for x in (F.lit(c), F.col(c).cast("string"))]
    return snapshot.select(
        F.lit(snapshot_lsn).cast("bigint").alias("lsn"), F.lit(-1).cast("bigint").alias("seq"),
        F.lit("insert").alias("op"), F.lit(schema).alias("schema"), F.lit(table).alias("table"),
        F.lit(None).cast("map<string,string>").alias("old"), F.create_map(*cells).alias("new"),
    )


def apply_changes(
    snapshot: DataFrame, changes: DataFrame, key: Sequence[str], snapshot_lsn: int,
    until_lsn: int | None = None, columns: Sequence[str] | None = None,
) -> DataFrame:
    """Base image plus the changes after it, up to an inclusive target."""
    base = snapshot_events(snapshot, snapshot_lsn, "", "")
    later = changes.where(F.col("lsn") > snapshot_lsn)
    return table_as_of(union_history(base, later), key, until_lsn, columns=columns)


def union_history(*parts: DataFrame) -> DataFrame:
    """Base, archived and live events as one log; columns missing from a part become null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def dedupe_replay(events: DataFrame, key: Sequence[str] | None = None, delay: str | None = None) -> DataFrame:
    """One copy of each redelivered event: same position, table, operation and key. The key cells are
    taken from the images; without ``key`` the whole images count (rows written in one go may share a
    position). A stream keeps what it has seen for ``delay`` behind the newest ``commit_ts``; later
    redeliveries are not recognised."""
    cells = lambda image: F.array_sort(F.map_entries(image if key is None else F.map_filter(image, lambda c, _: c.isin(*key))))
    told = events.withColumns({"_old": cells("old"), "_new": cells("new")})
    identity = ["lsn", "schema", "table", "op", "_old", "_new"]
    if events.isStreaming:
        if delay is None:
            raise ValueError("a stream needs a delay after which redeliveries are no longer expected")
        told = told.withWatermark("commit_ts", delay).dropDuplicatesWithinWatermark(identity)
    else:
        told = told.dropDuplicates(identity)
    return told.drop("_old", "_new")
