"""Column functions: URLs, text, tokens, and the word lists they use."""
