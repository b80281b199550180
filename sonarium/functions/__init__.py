"""Column functions: canonical keys, text, numbers, validity."""
