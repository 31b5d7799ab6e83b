"""Streaming additions. The batch operators are the engine; these run the same steps over unbounded input."""
