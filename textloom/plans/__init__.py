"""Named queries over the driver's tables, with DuckDB SQL for each that SQL can express."""
