"""Encoding with a public byte-level BPE vocabulary through a table of distinct words.

Texts are split into words in Spark, each distinct word is encoded once, and the ids come back by position. Null and empty texts have
the empty list. Decoding joins ids with the table of pieces.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.plans.storage import materialize

#: Words that hold at least 1/MAX_HOT of all positions are looked up in a broadcast: at most so many words, of at most HOT_LENGTH characters.
#: Longer ones take the way of all other words, spread over SALTS tasks each.
MAX_HOT = 50_000
HOT_LENGTH, SALTS = 100, 16
#: Positions of a text that are gathered at a time.
BLOCK = 4_096

# fixed values: the white space of the vocabulary's word pattern
SPACE = r"\t-\r\x20\x85\xa0  -     　"
#: The vocabulary's word pattern, with white space spelled out because Java's \s is ASCII only.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Path of a vocabulary file, in ``folder`` or where the installed package has it."""
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary(path: str) -> dict[bytes, int]:
    """Piece to id, from lines of a base64 piece and an id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _ranks(spark: SparkSession, path: str | None) -> Broadcast:
    return spark.sparkContext.broadcast(vocabulary(path or tokenizer_file()))


def split_words(text: Column) -> Column:
    """The words of a text; their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def _worded(documents: DataFrame) -> DataFrame:
    """rid (one per row), doc_id, words: the texts split once and written. Null and empty texts have no words.

    Code points that the JVM's Unicode tables do not know may be letters in newer ones; texts with any are split by Python's tables.
    """
    rows = documents.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("rid", F.monotonically_increasing_id())
    new = F.col("text").rlike(r"\p{Cn}")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        pattern = regex.compile(WORDS)
        for b in batches:
            yield pd.DataFrame({"rid": b.rid, "doc_id": b.doc_id, "words": [pattern.findall(t) for t in b.text]})

    known = rows.where(~new).select("rid", "doc_id", split_words(F.col("text")).alias("words"))
    schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("words", T.ArrayType(T.StringType()))])
    other = rows.where(new).select("rid", "doc_id", "text").mapInPandas(split, schema)
    return materialize(known.unionByName(other), "worded")


def word_table(worded: DataFrame, path: str | None = None) -> DataFrame:
    """word, n (positions), ids of each distinct word, written once."""
    ranks = _ranks(worded.sparkSession, path)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        # a word is one piece to merge, so the pattern takes it whole
        e = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks.value, special_tokens={})
        for b in batches:
            yield pd.DataFrame({"word": b.word, "n": b.n, "ids": [e.encode_ordinary(w) for w in b.word]})

    counts = worded.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return materialize(counts.mapInPandas(encode, "word string, n bigint, ids array<int>"), "words")


def encode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) for every row of ``documents``: repeated and null doc_ids keep their rows.

    A row's words become one array of ids in which the words that are not hot leave a gap, -1 for the first, -2 for the second distinct one
    and so on. Only these words are joined with the word table, and their ids come back to fill the gaps of their rows.
    """
    spark = documents.sparkSession
    worded = _worded(documents)
    words = word_table(worded, path)
    total = F.broadcast(words.agg(F.sum("n").alias("total")))
    ranked = words.crossJoin(total).withColumn("often", F.col("n") * MAX_HOT >= F.col("total"))
    hot = ranked.where(F.col("often") & (F.length("word") <= HOT_LENGTH)).select("word", "ids").toArrow()  # at most MAX_HOT rows
    held = spark.sparkContext.broadcast((hot["word"].to_pylist(), hot["ids"].to_pylist()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(held.value[0], pa.string())
        ids = pa.array(held.value[1], pa.list_(pa.int32()))
        for b in batches:
            lists = b.column("words")
            flat = lists.flatten()
            at = pc.index_in(flat, known)
            rows = lists.value_parent_indices() if hasattr(lists, "value_parent_indices") else pc.list_parent_indices(lists)
            gap = pc.is_null(at)
            # distinct words of the gaps per row, in order of appearance
            gaps, slots = [[] for _ in range(len(b))], []
            seen: dict[tuple[int, str], int] = {}
            for r, w in zip(rows.filter(gap).to_pylist(), flat.filter(gap).to_pylist()):
                k = seen.get((r, w))
                if k is None:
                    k = seen[r, w] = len(gaps[r])
                    gaps[r].append(w)
                slots.append([-1 - k])
            taken = pc.replace_with_mask(pc.fill_null(at, 0), gap, pa.array(range(len(known), len(known) + len(slots)), pa.int32()))
            pieces = pa.concat_arrays([ids, pa.array(slots, pa.list_(pa.int32()))]).take(taken)
            # the words' lists joined into one list per row
            ends = pieces.offsets.take(lists.offsets) if len(pieces) else lists.offsets
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), pa.ListArray.from_arrays(ends, pieces.values), pa.array(gaps, pa.list_(pa.string()))], ["rid", "doc_id", "ids", "gaps"])

    schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField("doc_id", worded.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("gaps", T.ArrayType(T.StringType()))])
    rows = materialize(worded.mapInArrow(place, schema), "placed")
    salt = F.when(F.length("word") > HOT_LENGTH, F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int")).otherwise(0).alias("salt")
    far = rows.select("rid", F.posexplode("gaps").alias("k", "word")).select("rid", "k", "word", salt)
    rest = ranked.where(~F.col("often") | (F.length("word") > HOT_LENGTH)).select("word", "ids")
    rest = rest.withColumn("salt", F.explode(F.when(F.length("word") > HOT_LENGTH, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    filled = far.join(rest, ["word", "salt"]).groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"]).alias("found"))
    whole = rows.where(F.size("gaps") == 0).select("doc_id", "ids")
    ids = F.flatten(F.transform("ids", lambda i: F.when(i < 0, F.get("found", -i - 1)).otherwise(F.array(i))))
    return whole.unionByName(rows.where(F.size("gaps") > 0).select("rid", "doc_id", "ids").join(filled, "rid").select("doc_id", ids.alias("ids")))


def pieces(spark: SparkSession, path: str | None = None) -> DataFrame:
    """id, piece (binary) of the vocabulary: as many rows as the file has lines."""
    ranks = vocabulary(path or tokenizer_file())
    return spark.createDataFrame(pd.DataFrame({"id": list(ranks.values()), "piece": list(ranks)}), "id int, piece binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of rows with doc_id and ids. The empty list gives the empty text; an id outside the vocabulary gives nothing."""
    table = F.broadcast(pieces(encoded.sparkSession, path).select("id", F.hex("piece").alias("piece")))  # the vocabulary's fixed size
    rows = encoded.select("doc_id", "ids").withColumn("rid", F.monotonically_increasing_id())
    at = rows.select("rid", "doc_id", F.posexplode_outer("ids").alias("pos", "id")).join(table, "id", "left")
    l = F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", "piece")))  # noqa: E741
    block = F.floor(F.col("pos") / BLOCK).alias("block")
    parts = at.withColumn("block", block).repartition("rid").groupBy("rid", "doc_id", "block").agg(l.alias("l"))
    joined = F.array_join(F.transform(F.array_sort("l"), lambda x: x["piece"]), "")
    whole = parts.select("rid", "doc_id", F.struct("block", joined.alias("h")).alias("p")).groupBy("rid", "doc_id").agg(F.collect_list("p").alias("p"))
    return whole.select("doc_id", F.decode(F.unhex(F.array_join(F.transform(F.array_sort("p"), lambda x: x["h"]), "")), "UTF-8").alias("text"))


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens (0 for null and empty texts) of every row, without keeping the ids."""
    ranks = _ranks(documents.sparkSession, path)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers
        import tiktoken

        e = tiktoken.Encoding("texts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.value, special_tokens={})
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "n_tokens": [len(e.encode_ordinary(t)) if t else 0 for t in b.text]})

    schema = T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType())])
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(count, schema)


