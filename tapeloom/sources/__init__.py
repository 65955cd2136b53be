"""Reading, standardising and writing the input and stage tables."""
