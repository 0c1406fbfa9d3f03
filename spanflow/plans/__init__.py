"""Query plans over the test tables: ``QUERIES`` (Spark) and ``ORACLE``
(DuckDB SQL of the same result, same column names)."""
