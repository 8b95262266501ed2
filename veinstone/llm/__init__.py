"""Training-data pipeline operators: tokenising, media, near-duplicates, filters, language ID.

Nothing outside this subpackage imports it; ``__spark_entry__`` registers its queries only when
it is present.
"""
