"""Operators for training data made of prompts, traces and documents.

Nothing outside this subpackage imports it.
"""
