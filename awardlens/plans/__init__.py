"""Compositions: reports and the whole classification."""
