"""Column expressions (text, labels, prompts, metrics, signals)."""
