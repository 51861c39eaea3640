"""Training-data operators: mixing, filters, dedup, packing, sharding, scoring.

Nothing outside this subpackage imports it.  Each module holds one operator
(DataFrame in, DataFrame out); ``queries`` registers the thin ``opN_`` queries
and their SQL.
"""
