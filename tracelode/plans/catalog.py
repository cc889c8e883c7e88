"""All queries of the evidence engine by name, with their DuckDB SQL."""

from . import corpus, records

QUERIES = {**corpus.QUERIES, **records.QUERIES}
ORACLE_SQL = {**corpus.ORACLE_SQL, **records.ORACLE_SQL}
