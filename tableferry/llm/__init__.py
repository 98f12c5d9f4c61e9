"""Training-data operators: cleaning, deduplication, scanning and tokenizing of whole corpora.

Nothing else in the library imports this package; ``llm.queries`` holds its registered queries.
"""
