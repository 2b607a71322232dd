"""Log level normalisation (SQL text in, SQL text out)."""

from __future__ import annotations

from logspark.functions.sqltext import literals, trim_space

UNKNOWN = "UNKNOWN"

# Accepted spellings of each level, upper case.
LEVEL_SPELLINGS = {
    "TRACE": ("TRACE", "TRC"),
    "DEBUG": ("DEBUG", "DBG", "DEBG"),
    "INFO": ("INFO", "INF", "INFORMATION"),
    "WARN": ("WARN", "WRN", "WARNING"),
    "ERROR": ("ERROR", "ERR", "ERRO"),
    "FATAL": ("FATAL", "FTL", "CRIT", "CRITICAL"),
    "PANIC": ("PANIC", "PNC"),
}


def normalize_level(text: str) -> str:
    words = [
        word
        for level, spellings in LEVEL_SPELLINGS.items()
        for spelling in spellings
        for word in (spelling, level)
    ]
    found = f"try_element_at(map({literals(words)}), upper({trim_space(text)}))"
    return f"coalesce({found}, '{UNKNOWN}')"
