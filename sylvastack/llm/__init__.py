"""Operators for large training-corpus pipelines. Nothing outside this subpackage imports it."""
