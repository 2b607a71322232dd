"""Column expressions: text, levels, times, JSON lines, key=value pairs."""
