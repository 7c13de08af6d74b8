"""Registered queries (``queries``) and their DuckDB counterparts (``oracle``)."""
