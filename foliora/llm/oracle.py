"""DuckDB SQL of this subpackage's queries."""

SQL: dict[str, str] = {}
