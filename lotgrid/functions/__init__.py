"""Column expressions: keys, text, rules, units."""
