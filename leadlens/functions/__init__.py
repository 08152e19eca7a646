"""Scalar column functions: number formats, random draws, tokenisation."""
