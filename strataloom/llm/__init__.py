"""Training-data operators: deduplication, filtering, scanning, encoding and archiving.

Nothing outside this subpackage imports it.  Each module holds one operator with a general
interface; ``queries`` registers the thin queries over the synthetic tables.
"""
