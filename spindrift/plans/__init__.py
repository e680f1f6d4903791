"""Query registry: Spark plans and the DuckDB SQL that checks them."""
