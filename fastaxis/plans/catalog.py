"""All queries over the driver tables, by name, and their SQL."""

from fastaxis.plans import quality_queries, store_queries, waveform_queries

PARTS = (store_queries, waveform_queries, quality_queries)
QUERIES = {k: v for part in PARTS for k, v in part.Q.items()}
ORACLE_SQL = {k: v for part in PARTS for k, v in part.SQL.items()}
