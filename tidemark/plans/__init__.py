"""Whole workflows: the feature pipeline, tuning, serving and publishing, and the registered queries."""
