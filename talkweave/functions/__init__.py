"""Column functions: text, scores, labels, model output."""
