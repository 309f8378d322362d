"""Operators over document collections for training-data pipelines, and their registered queries."""
