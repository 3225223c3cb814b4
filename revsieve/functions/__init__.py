"""Column expressions: text, languages, scoring, feedback and vectors."""
