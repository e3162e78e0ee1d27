"""Whole workflows: training, prediction, cross-validation, lift."""
