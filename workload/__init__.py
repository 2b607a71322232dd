"""Queries over the test tables and the DuckDB SQL they must agree with."""
