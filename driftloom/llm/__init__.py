"""Operators of a training-data pipeline: token counts, search, packing, language, quality, joins, secrets, mixing, scoring, archives.

Nothing else in the library imports this subpackage.
"""
