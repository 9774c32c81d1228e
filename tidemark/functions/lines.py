"""Log-line text: lossy decoding, clipping and the server's line prefix."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the longest log line kept, in bytes.
MAX_LINE_BYTES = 262_144

# Fixed value: the shipped prefix '%m [%p] %q[%a] db=%d,user=%u,client=%h ', then level and message.
_CUT = "\x01"
_LINE = (r"(?s)^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d+ \S+) \[(\d+)\] "
         r"(?:\[([^\]\x01]*)\] db=([^,\x01]*),user=([^,\x01]*),(client=)([^\s\x01]*) )?"
         r"(?:(LOG|ERROR|FATAL|PANIC|WARNING|NOTICE|STATEMENT|DETAIL|HINT):  )?(.*)$")
_TIMED = r"(?s)^duration: ([0-9.]+) ms(?:  (statement|execute [^:]*): )?(.*)$"


def utf8_lossy(raw: Column) -> Column:
    """Bytes to text; every invalid sequence becomes U+FFFD."""
    return F.make_valid_utf8(raw.cast("string"))


def clip_line(raw: Column, had_newline: Column, max_bytes: int = MAX_LINE_BYTES) -> Column:
    """Struct ``(line BINARY, truncated)`` of a line without its newline. The flag compares the
    bytes consumed, newline included, with the limit; one trailing carriage return is removed
    from what is kept."""
    kept = F.substring(raw, 1, max_bytes)
    ends_cr = F.hex(F.substring(kept, -1, 1)) == "0D"
    line = F.when(ends_cr, F.substring(kept, F.lit(1), F.octet_length(kept) - 1)).otherwise(kept)
    consumed = F.octet_length(raw) + had_newline.cast("int")
    return F.struct(line.alias("line"), (consumed > max_bytes).alias("truncated"))


def _fields(text: Column, pattern: str, groups: int) -> Column:
    """The groups of a pattern that spans the whole text, the last one unrestricted; null where it does not match."""
    joined = _CUT.join(f"${i}" for i in range(1, groups + 1))
    return F.split(F.when(text.rlike(pattern), F.regexp_replace(text, pattern, joined)), _CUT, groups)


def parse_pg_log_prefix(line: Column) -> Column:
    """Struct of the prefix fields, the message level, the duration and the statement of a server
    log line; session fields are null for lines of background processes. All fields are null for lines
    without time and process number, such as the further lines of a statement; level and message are
    null where no level follows the prefix. The line is matched as a whole, once for all fields."""
    head = _fields(line, _LINE, 9)
    session, levelled = head[5] != "", head[7] != ""
    message = F.when(levelled, head[8])
    timed = _fields(F.when(head[7] == "LOG", head[8]), _TIMED, 3)
    return F.struct(
        head[0].alias("logged_at"),
        head[1].cast("bigint").alias("pid"),
        F.when(session, head[2]).alias("app"),
        F.when(session, head[3]).alias("db"),
        F.when(session, head[4]).alias("usr"),
        F.when(session, head[6]).alias("client"),
        F.when(levelled, head[7]).alias("level"),
        message.alias("message"),
        timed[0].try_cast("double").alias("duration_ms"),
        F.when(timed[1] != "", timed[2]).alias("statement"),
    )
