"""Look at physical plans."""

from __future__ import annotations


def physical(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def scan_line(frame) -> str:
    lines = [line for line in physical(frame).split("\n") if "FileScan" in line]
    assert len(lines) == 1, lines
    return lines[0]
