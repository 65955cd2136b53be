"""Incremental reading of arriving files with the same expressions as the batch flows."""
