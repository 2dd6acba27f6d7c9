"""Preparing, fitting, judging and applying models."""
