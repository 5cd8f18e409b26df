"""Operators over interactions: splits, features, models, candidates, evaluation, statistics."""
