"""streaming of the price catalogue engine."""
