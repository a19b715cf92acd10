"""Column expressions: business rules, text handling, presentation."""
