"""Training-data operators: ten stand-alone DataFrame operators and their queries.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
when it is present.
"""
