"""Helpers for expressions written as SQL text.

The parser is a few hundred small expressions. As SQL text each projection
crosses to the JVM once; built from Column objects it would cross thousands of
times before the job even starts.
"""

from __future__ import annotations

from logspark.functions.text import ANSI_COLOUR, SPACES


def literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literals(texts) -> str:
    return ", ".join(literal(text) for text in texts)


def when(condition: str, value: str, otherwise: str = "NULL") -> str:
    return f"CASE WHEN {condition} THEN {value} ELSE {otherwise} END"


def coalesce(*values: str) -> str:
    return values[0] if len(values) == 1 else f"coalesce({', '.join(values)})"


def opaque(value: str) -> str:
    """``value``, computed here and nowhere else.

    Spark moves filters below a projection by repeating the projection's
    expressions inside the filter. For the parser that would repeat its regexes
    and JSON parses many times over; it does not happen to an expression that
    holds the partition number.
    """
    return when("spark_partition_id() >= 0", value)


def own_stage(value: str) -> str:
    """``value``, in a projection that Spark compiles on its own.

    Fused into one method with its neighbours, a large projection outgrows what
    the JVM is willing to optimise. A higher-order function keeps it apart.
    """
    return f"transform(array({value}), x -> x)[0]"


def trim_space(text: str) -> str:
    return f"btrim({text}, {literal(SPACES)})"


def strip_ansi(text: str) -> str:
    """Remove terminal colour sequences; lines without ESC skip the regex."""
    cleaned = f"regexp_replace({text}, {literal(ANSI_COLOUR)}, '')"
    return when(f"contains({text}, {literal(chr(27))})", cleaned, text)
