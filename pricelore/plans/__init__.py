"""plans of the price catalogue engine."""
