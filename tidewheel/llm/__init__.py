"""Operators that prepare text for training language models.

Nothing outside this package imports it. Every operator takes DataFrames,
names the columns it reads, and states what nulls, empty texts, ties and
repeated rows give.
"""
