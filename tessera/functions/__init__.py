"""Column expressions: geometry, labels, text, rewards and vectors."""
