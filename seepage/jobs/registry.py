"""Registered queries and their SQL."""

from seepage.jobs import choices, evaluation, spatial, stored

QUERIES: dict = {**spatial.QUERIES, **evaluation.QUERIES, **choices.QUERIES, **stored.QUERIES}
ORACLE_SQL: dict = {**spatial.ORACLE_SQL, **evaluation.ORACLE_SQL, **choices.ORACLE_SQL, **stored.ORACLE_SQL}
FLAGSHIP = "o48_corrected"
