"""Whole flows composed of the operators, one lazy plan each."""
