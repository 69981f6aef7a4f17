"""Column functions: rational time, timecode, identifiers and text."""
