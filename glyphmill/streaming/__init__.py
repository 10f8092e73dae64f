"""Structured Streaming forms of the sampler operators."""
