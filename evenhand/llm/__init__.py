"""Operations of a training-data pipeline: deduplication, scoring, mixing, search and tokenisation.

Nothing outside this folder imports it; ``queries`` holds the registered queries.
"""
