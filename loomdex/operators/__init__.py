"""Operators of the index: graph, chunks, packing, cache, index, usage."""
