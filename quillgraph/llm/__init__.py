"""Training-data operators over text corpora.

Each module holds one operator; ``queries`` registers them. Nothing outside this
subpackage imports it, so the rest of the library works without it.
"""
