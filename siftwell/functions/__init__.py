"""Column expressions and scalar rules: text, vectors, languages."""
