"""Whole plans: the pipeline, the synthetic adapter, and the registered queries."""
