"""Column expressions: coercion, time parsing, label normalising, list statistics."""
