"""All queries by name, with the SQL that gives the same rows."""

from .plans import answers, deck, library, notes, pages, prose, search, structure, study, text

_PLANS = (text, search, structure, study, library, pages, prose, notes, answers, deck)
QUERIES: dict = {name: f for plan in _PLANS for name, f in plan.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for plan in _PLANS for name, sql in plan.ORACLE_SQL.items()}
