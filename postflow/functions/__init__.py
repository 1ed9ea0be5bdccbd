"""Column expressions: text rules, link verdicts, prompts."""
