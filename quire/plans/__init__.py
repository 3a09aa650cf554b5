"""Registered queries by subject; QUERIES and ORACLES hold all of them."""

from quire.plans import books, cases, relational, styles

QUERIES = {**relational.QUERIES, **books.QUERIES, **cases.QUERIES, **styles.QUERIES}
ORACLES = {**relational.ORACLES, **books.ORACLES, **cases.ORACLES, **styles.ORACLES}
