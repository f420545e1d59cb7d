"""Training-data operators: each module holds one operator and its thin query.

Nothing outside this folder imports it; the top-level registry adds its queries when it is present.
"""
