"""Operators on tables with an order key: keys and splits, preparation, profiles, metrics, rankers, transforms, models."""
