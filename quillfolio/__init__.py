"""Equity-research and portfolio analytics as PySpark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame.  Nothing is collected
to the driver, and no operator puts an unbounded group into one task: ledgers
are netted to one row per calendar day before any per-key sequence is built,
and the few per-event sequences run over bounded chunks (see ``operators.scan``).
"""
