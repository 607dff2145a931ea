"""Sources and sinks (file formats, dumps, HTML tables, driver tables)."""
