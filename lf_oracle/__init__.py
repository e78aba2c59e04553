"""DuckDB SQL oracle for every catalogued query (test infrastructure)."""
