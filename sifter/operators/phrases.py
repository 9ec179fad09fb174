"""Many phrases against many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Words of a key, and bytes of the short phrases that one pass over the texts looks for.
KEY_WORDS = 4
BLOCK_BYTES = 4 << 20


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")


def phrase_hits(texts: DataFrame, phrases: DataFrame, text_id: str, phrase_id: str) -> DataFrame:
    """phrase_id, text_id of every folded phrase and each folded text (norm_text) that holds it.

    A phrase of six words or more has four whole words in a row in any text that holds it, though it
    may begin and end within words: the texts meet it by the hash of four such words, the longest
    ones, as they are the rarest, and are then searched. Shorter phrases are looked for all at once
    by an automaton, as many of them in a pass over the texts as a block of bytes holds. Empty and
    null phrases are in no text.
    """
    listed = phrases.filter("phrase <> ''").withColumn("w", _words(F.col("phrase")))
    inner = F.size("w") - KEY_WORDS - 1  # places of a key within the whole words
    places = F.transform(F.sequence(F.lit(0), F.greatest(inner, F.lit(1)) - 1), lambda i: F.slice("w", i + 2, KEY_WORDS))
    rarest = F.array_max(F.transform(places, lambda k: F.struct(F.length(F.array_join(k, "")).alias("size"), k.alias("key"))))["key"]
    keyed = listed.filter(inner >= 1).select(phrase_id, "phrase", F.xxhash64(rarest).alias("key"))
    spots = texts.withColumn("w", _words(F.col("norm_text"))).filter(F.size("w") >= KEY_WORDS)
    keys = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - KEY_WORDS + 1), lambda i: F.xxhash64(F.slice("w", i, KEY_WORDS))))
    met = spots.select(text_id, F.explode(keys).alias("key")).join(keyed, "key").select(text_id, phrase_id, "phrase").distinct()
    long = met.join(texts, text_id).filter(F.contains("norm_text", "phrase")).select(phrase_id, text_id)
    short = listed.filter(inner < 1).select(phrase_id, "phrase")
    total = short.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES)
    kinds = {f.name: f.dataType.simpleString() for f in (*texts.schema, *phrases.schema)}
    for k in range(blocks):
        rows = short.filter(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == k).collect()  # a block of bytes
        found = texts.select(text_id, "norm_text").mapInArrow(_search(rows, to_arrow_type(phrases.schema[phrase_id].dataType)), f"{phrase_id} {kinds[phrase_id]}, {text_id} {kinds[text_id]}")
        long = long.unionByName(found)
    return long


def _search(rows: list, kind: pa.DataType):
    ids: dict[str, list] = {}
    for key, phrase in rows:
        ids.setdefault(phrase, []).append(key)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for phrase in ids:
            machine.add_word(phrase, phrase)
        machine.make_automaton()
        for batch in batches:
            at, keys = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                for phrase in {p for _, p in machine.iter(text or "")}:
                    at += [row] * len(ids[phrase])
                    keys += ids[phrase]
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), batch.column(0).take(pa.array(at, pa.int64()))], ["key", "id"])

    return search
