"""Column functions: cost models, order prices, levels."""
