"""Stages that turn ``documents`` into packed training sequences.

Toxic documents go, one document of each class of near copies stays, documents
with benchmark passages go, personal data is masked, and the rest is packed
into sequences. Each stage works on all that its predecessor kept; all but the
last return the columns of ``documents``, any others that the table has as they
are, whatever their names.

=================  ==========================  ==========================  =================================
stage              null or empty text          repeated rows               null doc_id
=================  ==========================  ==========================  =================================
toxicity           score of the bias alone     judged each                 judged, never learned from
near copies        one group                   one stays                   a group's choice only if no other
decontamination    kept                        judged each                 judged
personal data      kept as it is               masked each                 masked
packing            the end token alone         packed each                 packed
=================  ==========================  ==========================  =================================

An empty table stays empty in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefield.llm import decontaminate, minhash, packing, pii, toxicity
from tracefield.llm.common import table
from tracefield.llm.queries import tokenizer_path
from tracefield.session import checkpoint


def _own_names(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with columns other than doc_id and text under numbers, and the way back: no name can clash."""
    mine = [c for c in docs.columns if c not in ("doc_id", "text")]
    numbers = {c: f"column {i}" for i, c in enumerate(mine)}
    plain = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(n) for c, n in numbers.items()))
    return plain, lambda out: out.select(*(F.col(f"`{numbers.get(c, c)}`").alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score lies below the threshold; the model learns from the labelled ones among them.

    Null and empty texts have the score of the bias; repeated rows are judged
    each; rows with a null id are judged and never learned from.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    plain, back = _own_names(docs)
    return back(toxicity.score(plain, model).filter("predicted = 0"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the least doc_id; of rows equal in id and text, one.

    Null and empty texts are one class; a null id stays only where its class
    has no other.
    """
    plain, back = _own_names(docs)
    key = F.md5(F.concat(F.hex(minhash.node_of()), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).cast("binary"))
    classes = minhash.near_duplicates(docs, keep_node=True).filter("kept")
    kept = classes.select(F.md5(F.concat(F.hex("node"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).cast("binary")).alias("_key")).distinct()
    return back(plain.withColumn("_key", key).join(kept, "_key", "left_semi").dropDuplicates(["_key"]))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, repeated rows and null ids are judged each."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked; ``n_chars`` follows the text.

    Null and empty texts stay; repeated rows and null ids are masked like others.
    """
    out = pii.mask(docs, pii.learn(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return out.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one end token; every row is packed, repeated ones
    and those with a null id too.
    """
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("personal data", mask_personal_data),
    ("packing", pack_sequences),
]

#: classifiers, sketches and tokenizers are not SQL; tests hold the stages against brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
