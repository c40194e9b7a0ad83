"""Whole jobs composed of operators, from stored input to stored output."""
