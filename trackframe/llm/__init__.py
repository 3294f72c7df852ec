"""Training-data operators: secrets, media, near-duplicates, packing and the rest.

Nothing outside this subpackage imports it; its queries live in
``trackframe.llm.queries``.
"""
