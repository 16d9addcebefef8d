"""Entities from a table of names, of any size: the leftmost, longest names of each sentence.

``names`` has ``name, type``; a name is one token or many, compared in lower case and token by token.
Two lookups in the corpus' vocabulary (``vocabulary``) replace a trie in every task: the first says
for each token how long the names are that begin with it and the token behind it, the second which of the
stretches of those lengths are names.  The choice is made inside the sentence's row.

Of stretches that begin at one token the longest wins, and the next one begins behind it, so
entities do not overlap.  A name with several types has the first of them by name.  Names
without a token are no names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbaloom.functions.arrays import let
from verbaloom.operators.segment import token_array
from verbaloom.operators.views import first_words
from verbaloom.operators.vocabulary import looked_up, one_value_each
from verbaloom.schemas import ENTITY, require_columns

#: Second tokens that are told apart behind one first token.
SECONDS = 256


def name_tables(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``key, value`` of first tokens and of names (``type``).

    A first token's value tells whether it is a name ``alone`` and, for every second token, the ``lengths`` of the
    names that go on with it (``after``).  Behind more than ``SECONDS`` second tokens ``after`` is null, and
    ``lengths`` are those of all of its names.  Lengths fall.
    """
    require_columns(names, "name", "type")
    tokens = F.transform(token_array(F.col("name")), F.lower)
    split = names.select("type", tokens.alias("tokens")).filter(F.size("tokens") > 0)
    lengths = split.select(F.get("tokens", F.lit(0)).alias("key"), F.get("tokens", F.lit(1)).alias("second"), F.size("tokens").alias("length"))
    falling = F.sort_array(F.collect_set("length"), False).alias("lengths")
    seconds = lengths.groupBy("key", "second").agg(falling)
    sizes = seconds.groupBy("key").agg(F.count("second").alias("n"), (F.count(F.lit(1)) > F.count("second")).alias("alone"))
    few, many = (sizes.filter(which).select("key") for which in (F.col("n") <= SECONDS, F.col("n") > SECONDS))
    after = seconds.filter("second IS NOT NULL").join(few, "key", "left_semi").groupBy("key").agg(
        F.map_from_entries(F.collect_list(F.struct("second", "lengths"))).alias("after"))
    every = lengths.filter("second IS NOT NULL").join(many, "key", "left_semi").groupBy("key").agg(falling)
    starts = sizes.join(after, "key", "left").join(every, "key", "left").select("key", F.struct("alone", "after", "lengths").alias("value"))
    whole = split.withColumn("name_key", F.array_join("tokens", " "))
    return starts, one_value_each(whole, "name_key", [F.col("type")], ["type"])


def _stretches(tokens: Column, starts: Column) -> Column:
    """Start, length and words of every stretch that may be a name, by start and falling length."""
    def of_token(words: Column):
        def stretches(found: Column, i: Column) -> Column:
            longer = F.coalesce(F.try_element_at(found["after"], F.get(words, i + 1)), found["lengths"])
            alone = F.when(found["alone"], F.array(F.lit(1)))
            lengths = F.when(longer.isNull(), alone).when(alone.isNull(), longer).otherwise(F.concat(longer, alone))
            fit = F.filter(lengths, lambda length: length <= F.size(words) - i)
            return F.transform(fit, lambda length: F.struct(
                (i + 1).alias("start"), length.alias("length"), F.array_join(F.slice(words, i + 1, length), " ").alias("phrase"),
            ))
        return stretches
    def of_all(words: Column) -> Column:
        found = F.transform(starts, lambda f, i: F.when(f.isNotNull(), of_token(words)(f, i)))
        return F.flatten(F.array_compact(found))
    return let(tokens, of_all)


def _chosen(stretches: Column, types: Column) -> Column:
    """The names among the stretches, without overlaps."""
    pairs = F.arrays_zip(stretches.alias("at"), types.alias("found"))
    names = F.filter(pairs, lambda p: p["found"].isNotNull())
    rows = F.transform(names, lambda p: F.struct(p["at"]["start"].alias("start"), p["at"]["length"].alias("length"), p["found"]["type"].alias("type")))
    nothing = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,length:int,type:string>>").alias("kept"))
    return F.aggregate(rows, nothing, lambda state, row: F.when(row["start"] <= state["end"], state).otherwise(F.struct(
        (row["start"] + row["length"] - 1).alias("end"), F.concat(state["kept"], F.array(row)).alias("kept"))), lambda state: state["kept"])


def apply_names(sentences: DataFrame, names: DataFrame) -> DataFrame:
    """``sentences`` with the entities that the table names, in place of what they had."""
    starts, whole = name_tables(names)
    key = ["doc_id", "sent_ix"]
    first = F.transform(first_words(F.col("words")), lambda w: w["tok_form"])
    parts = F.col("words.part")  # a null part makes the second condition null
    one_each = (F.array_max(parts) == 1) & ~F.array_contains(parts, F.lit(2)) & (F.array_min(parts) == 1)
    rows = sentences.withColumn("tokens", F.when(one_each, F.col("words.tok_form")).otherwise(first))
    rows = rows.withColumn("lower_tokens", F.transform("tokens", F.lower))
    rows = looked_up(rows, "lower_tokens", starts, "name_starts", key)
    rows = rows.withColumn("stretches", _stretches(F.col("lower_tokens"), F.col("name_starts")))
    rows = looked_up(rows.withColumn("phrases", F.col("stretches.phrase")), "phrases", whole, "name_types", key)

    def entity(words: Column):
        return lambda row, i: F.struct(
            (i + 1).alias("ent_ix"), row["type"].alias("type"), F.array_join(F.slice(words, row["start"], row["length"]), " ").alias("text"),
            row["start"].cast("long").alias("tok_start"), (row["start"] + row["length"] - 1).cast("long").alias("tok_end"))
    entities = let(F.col("tokens"), lambda words: F.transform(_chosen(F.col("stretches"), F.col("name_types")), entity(words)))
    kind = f"array<{ENTITY.simpleString()}>"
    # Unpacked from an array of one, so that what is asked of entities later is not asked of these expressions again.
    sealed = rows.withColumn("named", F.explode(F.array(F.struct(entities.cast(kind).alias("entities")))))
    return sealed.withColumn("entities", F.col("named.entities")).drop(
        "tokens", "lower_tokens", "name_starts", "stretches", "phrases", "name_types", "named")
