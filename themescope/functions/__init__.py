"""Column expressions: text, dates, nulls, draws, responses and vectors."""
