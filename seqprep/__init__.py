"""Preparation of sample datasets for language models as DataFrame pipelines."""
