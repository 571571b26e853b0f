"""Operators over DataFrames of documents."""
