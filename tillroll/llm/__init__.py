"""Operators of a training-data pipeline: quality, licences, secrets, repeated
passages, personal data, languages, token counts, benchmark leaks, near copies
and source mixing.  Nothing else in the library imports this subpackage."""
