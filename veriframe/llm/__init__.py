"""Training-data operators: media, quality, language, dedup, packing and scoring.

Nothing outside this subpackage imports it.  Every operator takes DataFrames
and returns DataFrames; the ``opN_`` queries in :mod:`.queries` apply them to
whole tables.
"""
