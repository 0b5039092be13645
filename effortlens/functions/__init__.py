"""Column expressions: text, numbers, dates. No Python UDFs."""
