"""verbaloom: corpus-linguistics analytics as Spark jobs.

The central table is *sentences*: one row per sentence, with its words and entities as
arrays of structs (``verbaloom.schemas.SENTENCES``).  Text becomes that table without a
shuffle, the exports read it without a shuffle, and the flat token, word and entity tables
are views of it.
"""
