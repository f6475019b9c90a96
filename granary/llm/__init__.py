"""Operators that prepare training data: deduplication, packing, filters, sharding and token counts.

Nothing outside this package imports it. Every operator selects the columns it needs from its input by
name before anything else, so further columns, whatever their names, neither clash nor pass through.
"""
