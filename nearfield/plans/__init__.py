"""Placement of rows on shards and targets, and choice of search plan."""
