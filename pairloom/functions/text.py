"""Scalar column functions. All of them are built-in expressions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marker line of a decompiled function and the decompiler's warning of a truncated body.
MARKER_PREFIX = "// FUNCTION "
# "d": only \n ends a line, as in the files' own format; plain "m" would also break at NEL and U+2028.
# A marker needs a name: at least one more character in its line.
MARKER_START = r"(?md)^// FUNCTION (?=.)"
TRUNCATION_WARNING = "Truncating control flow here"

_REPLACEMENT = "\ufffd"
_ESC = "\u0001"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decode_lossy(content: Column | str) -> Column:
    """Bytes to text, dropping every invalid UTF-8 sequence; genuine U+FFFD characters are kept."""
    raw = _col(content).cast("string")
    # Only invalid input pays for the escaping that tells genuine U+FFFD from the ones make_valid_utf8 inserts.
    escaped = F.replace(F.replace(raw, F.lit(_ESC), F.lit(_ESC + "1")), F.lit(_REPLACEMENT), F.lit(_ESC + "2"))
    cleaned = F.replace(F.make_valid_utf8(escaped), F.lit(_REPLACEMENT), F.lit(""))
    restored = F.replace(F.replace(cleaned, F.lit(_ESC + "2"), F.lit(_REPLACEMENT)), F.lit(_ESC + "1"), F.lit(_ESC))
    return F.when(F.is_valid_utf8(raw), raw).otherwise(restored)


def has_body(text: Column | str) -> Column:
    return F.contains(_col(text), F.lit("{"))


def split_function(text: Column | str) -> Column:
    """Cut at the first ``{`` and the last ``}`` into ``struct(head, body, tail)``; null when there is no ``{``."""
    text = _col(text)
    open_at = F.instr(text, "{")
    rest = F.substr(text, open_at + 1)
    after_close = F.substring_index(rest, "}", -1)
    closed = F.contains(rest, F.lit("}"))
    body = F.when(closed, F.left(rest, F.length(rest) - F.length(after_close) - 1)).otherwise(rest)
    tail = F.when(closed, F.concat(F.lit("}"), after_close)).otherwise(F.lit(""))
    return F.when(
        open_at > 0,
        F.struct(F.left(text, open_at).alias("head"), body.alias("body"), tail.alias("tail")),
    )


def file_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def function_id(path: Column | str, name: Column | str) -> Column:
    """``<file name up to the first dot>::<name up to the first '<'>``; directories and overloads do not count."""
    return F.concat(
        F.substring_index(file_name(path), ".", 1), F.lit("::"), F.substring_index(_col(name), "<", 1)
    )


def is_blank(text: Column | str) -> Column:
    """Only Unicode white space (including U+001C-001F), or nothing at all."""
    return ~F.rlike(_col(text), F.lit(r"(?U)[^\s\x1c-\x1f]"))


def output_path(path: Column | str, suffix: Column | str, target: Column | str) -> Column:
    """Replace the matched ``suffix`` at the end of ``path`` by ``target``."""
    path, suffix = _col(path), _col(suffix)
    return F.concat(F.left(path, F.length(path) - F.length(suffix)), _col(target))


def decompiled_path(path: Column | str) -> Column:
    return F.concat(_col(path), F.lit(".c"))


def normalize_path(path: Column | str) -> Column:
    """Resolve ``.``, ``..`` and doubled slashes without touching a file system."""
    def step(acc: Column, part: Column) -> Column:
        skip = (part == ".") | ((part == "") & (F.size(acc) > 0))
        up = (part == "..") & (F.size(acc) > 0)
        return (
            F.when(skip, acc)
            .when(up, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(part)))
        )

    empty = F.array().cast("array<string>")
    return F.array_join(F.aggregate(F.split(_col(path), "/"), empty, step), "/")
