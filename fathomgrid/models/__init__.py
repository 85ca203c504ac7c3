"""Hierarchical SUR regressions in NumPy, one fit to a task: R (assets, months), F (assets, months, predictors)."""
