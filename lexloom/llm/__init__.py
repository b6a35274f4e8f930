"""Training-data operators: decontamination, personal data, tokenising, deduplication, licences, quality and LM scores.

Nothing else in the library imports this subpackage.
"""
