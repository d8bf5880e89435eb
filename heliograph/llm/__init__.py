"""Training-data operators: packing, quotes, privacy, decontamination, token
counts, page text, similarity join, language, audio and quality.

Nothing else in the library imports this subpackage; it can be removed whole.
"""
