"""Streaming adapters (the reference itself has no streaming operators)."""
