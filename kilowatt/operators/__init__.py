"""Operators: relational, splits, preparation, features, models, tuning,
metrics, clustering, text, graph and itemset mining."""
