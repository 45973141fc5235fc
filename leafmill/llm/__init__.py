"""Operators of a training-data pipeline: packing, chat formatting, mixing, filters and deduplication.

Every operator takes DataFrames and returns DataFrames. Operators read only the columns they are told to
(``id_col``, ``text_col``, ...), so extra columns never clash with theirs.
"""
