"""Training-data operators: filters, models, joins and writers for large text corpora.

Nothing outside this package imports it; it can be deleted as a whole.
"""
