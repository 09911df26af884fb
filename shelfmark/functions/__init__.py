"""Column expressions: category paths, text cleaning, tokens, measurements."""
