"""Training-data operators: quality rules, near-duplicate detection, language
identification, exact search, tokenisation, toxicity, secrets, page rendering,
passage removal and source mixing.

Nothing else in the library imports this subpackage.
"""
