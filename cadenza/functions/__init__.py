"""Column expressions: bits, sample types, frame timing, names and levels."""
