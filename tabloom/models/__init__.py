"""Regressors and classifiers."""
