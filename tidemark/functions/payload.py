"""Row images: text cells to typed values and to JSON.

A row image is ``MAP<STRING,STRING>``: a null value is SQL NULL, an absent key is a column the
log did not send because it was unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The type oids that become native JSON values or typed columns.
OID_TYPES = {
    16: "boolean",
    20: "bigint",
    21: "smallint",
    23: "int",
    700: "float",
    701: "double",
}
INTEGER_OIDS = (20, 21, 23)
FLOAT_OIDS = (700, 701)
BOOL_OID = 16

_INTEGER = "^-?[0-9]+$"
_FLOAT = "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _bool(text: Column) -> Column:
    return F.when(text == "t", F.lit(True)).when(text == "f", F.lit(False))


def _finite(text: Column) -> Column:
    number = F.when(text.rlike(_FLOAT), text.try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def coerce_pg(text: Column, oid: int) -> Column:
    """Text cell to the Spark type of one type oid; null where the text is not such a value.
    Types outside the seven known ones, and exact decimals, stay text."""
    kind = OID_TYPES.get(oid)
    if kind is None:
        return text
    if kind == "boolean":
        return _bool(text)
    if oid in INTEGER_OIDS:
        return F.when(text.rlike(_INTEGER), text.try_cast(kind))
    return _finite(text).cast(kind)


def json_quote(text: Column) -> Column:
    """JSON string literal. Quote, backslash, newline, carriage return and tab get the short
    escape; other control characters ``\\u00xx`` in lower case."""
    out = text
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    spelled = F.array_join(
        F.transform(
            F.split(out, ""),
            lambda c: F.when(
                c.rlike("^[\\x00-\\x1f]$"),
                F.concat(F.lit("\\u00"), F.lpad(F.lower(F.hex(F.ascii(c))), 2, "0")),
            ).otherwise(c),
        ),
        "",
    )
    out = F.when(out.rlike("[\\x00-\\x1f]"), spelled).otherwise(out)
    return F.concat(F.lit('"'), out, F.lit('"'))


def json_value(text: Column, oid: Column) -> Column:
    """JSON text of one cell, typed by its oid column; what does not parse stays a string."""
    number = _finite(text)
    return (
        F.when(text.isNull(), F.lit("null"))
        .when((oid == BOOL_OID) & text.isin("t", "f"), F.when(text == "t", "true").otherwise("false"))
        .when(oid.isin(*INTEGER_OIDS) & text.rlike(_INTEGER) & text.try_cast("bigint").isNotNull(), text)
        .when(oid.isin(*FLOAT_OIDS) & number.isNotNull(), number.cast("string"))
        .otherwise(json_quote(text))
    )


def row_image_json(image: Column, types: Column) -> Column:
    """JSON object of a row image: null kept, absent keys omitted, column order kept."""
    fields = F.transform(
        F.map_entries(image),
        lambda e: F.concat(json_quote(e["key"]), F.lit(":"), json_value(e["value"], types[e["key"]])),
    )
    return F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}"))


def event_json(
    lsn_text: Column, op: Column, schema: Column, table: Column,
    old: Column, new: Column, types: Column,
) -> Column:
    """One change event as JSON text, keys in the order lsn, op, schema, table, old, new."""
    head = [
        F.concat(F.lit(f'"{key}":'), json_quote(value))
        for key, value in (("lsn", lsn_text), ("op", op), ("schema", schema), ("table", table))
    ]
    images = [
        F.when(image.isNotNull(), F.concat(F.lit(f'"{key}":'), row_image_json(image, types)))
        for key, image in (("old", old), ("new", new))
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *head, *images), F.lit("}"))


def typed_view(events: DataFrame, table: str, columns: dict[str, int], schema: str = "public") -> DataFrame:
    """Columns of one table's new row images, typed by ``{column: type oid}``."""
    rows = events.where((F.col("schema") == schema) & (F.col("table") == table) & F.col("new").isNotNull())
    return rows.select(
        "lsn", "op",
        *[coerce_pg(F.try_element_at("new", F.lit(name)), oid).alias(name) for name, oid in columns.items()],
    )
