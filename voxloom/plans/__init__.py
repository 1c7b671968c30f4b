"""Registered queries: operators applied to the test tables, each beside DuckDB SQL for the same rows."""
