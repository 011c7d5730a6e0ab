"""Operations of a training-data pipeline over plain document tables.

Every module holds one operator with its own general interface; ``queries``
holds the thin registered queries.  Nothing outside this subpackage imports it.
"""
