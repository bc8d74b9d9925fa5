"""Training-data preparation operators: dedup, decontamination, packing, filtering.

Nothing outside this subpackage imports it; `registry` lists its queries.
"""
