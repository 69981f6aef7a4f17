"""Operators on frames, index entries, packets, channels and tracks, as DataFrame recipes."""
