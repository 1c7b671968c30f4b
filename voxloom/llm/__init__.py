"""Training-data operators: joins, mixing, archives, quality, search, sharding, formatting, packing and secret scans.

Nothing outside this folder imports it; ``voxloom.llm.queries`` registers its queries.
"""
