"""Registry of code types: which file-name suffixes belong to which side, and how functions are found.

A new language is a ``CodeType`` of the caller's, given to the operators in place of a name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pairloom import schemas


@dataclass(frozen=True)
class CodeType:
    name: str
    display: str
    source: tuple[str, ...]
    bytecode: tuple[str, ...]
    decompiled: tuple[str, ...]
    language: str = ""  # which built-in extraction rules apply: "c" or "cpp"
    # A type's own extractor: text to (name, text of the function) in order, and what was wrong with it, if anything.
    extract: Callable[[str], tuple[list[tuple[str, str]], str | None]] | None = None
    # The same for its marked files, in place of the built-in marker lines.
    split: Callable[[str], tuple[list[tuple[str, str]], str | None]] | None = None
    # Its own cut of a function of either side into (head, body, tail); None for one without a body.
    parts: Callable[[str], tuple[str, str, str] | None] | None = None

    @property
    def output_suffix(self) -> str:
        """Suffix given to transformed files."""
        return self.source[0]


# Suffix lists and display names.
C = CodeType("c", "C", (".c",), (".o",), (".o.c",), "c")
CPP = CodeType(
    "cpp", "C/C++",
    (".c", ".cpp", ".cc", ".cxx", ".c++"),
    (".o",),
    (".o.c", ".o.cpp", ".o.cc", ".o.cxx", ".o.c++"),
    "cpp",
)

CODE_TYPES: dict[str, CodeType] = {ct.name: ct for ct in (C, CPP)}
DEFAULT_CODE_TYPES = ("cpp",)


def resolve(code_types: str | Iterable[str | CodeType] | None) -> list[CodeType]:
    """Accept a comma string, names or instances; ``None`` means the default selection."""
    if code_types is None:
        code_types = DEFAULT_CODE_TYPES
    if isinstance(code_types, str):
        code_types = code_types.split(",")
    out = []
    for ct in code_types:
        if isinstance(ct, CodeType):
            out.append(ct)
        elif ct in CODE_TYPES:
            out.append(CODE_TYPES[ct])
        else:
            raise ValueError(f"unknown code type {ct!r}; known: {sorted(CODE_TYPES)}")
    return out


def code_type_table(spark: SparkSession, code_types=None) -> DataFrame:
    """The registry as a small dimension table."""
    rows = [
        (ct.name, ct.display, side, suffix)
        for ct in (resolve(code_types) if code_types is not None else CODE_TYPES.values())
        for side in ("source", "bytecode", "decompiled")
        for suffix in getattr(ct, side)
    ]
    return spark.createDataFrame(rows, schemas.CODE_TYPES)
