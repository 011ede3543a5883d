"""Column expressions: predicates, rules and texts. No DataFrame enters here."""
