"""Training-data pipeline operators: sharding, quality, formatting, URL, WARC, dedup, licences, tokens.

Nothing outside this subpackage imports it; the registry in ``queries.py`` is read by the entry
module only when the subpackage is present.
"""
