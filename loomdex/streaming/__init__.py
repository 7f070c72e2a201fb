"""Streams: bursts of file events, upkeep of the index, rate limits per key."""
