"""A training-data pipeline: each stage reads what the one before wrote, and its decisions take effect.

All but the last stage return the columns of documents.

Cases, for every stage: a null text counts as empty and stays null; texts of any length are read whole; repeated rows are
rows of their own (near-duplicates keep one of them); an empty table gives no rows; columns of the caller keep
their values, whatever their names; the last stage returns lang and source where they are there.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansmith.llm import bpe, decontaminate, near_dedup, suffix_dedup, toxicity
from plansmith.llm.common import scratch, table, tidied
from plansmith.llm.queries import vocabulary
from plansmith.llm.text import slices

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Rows of a batch between Spark and a Python worker: both sides hold one or two, and texts are long.
ROWS = 1000


def by_few_rows(stage: Stage) -> Stage:
    """A stage whose session sends its workers ROWS rows at a time, from now on, as the result is computed later."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
        return stage(spark, docs, sf_dir)

    return run


def apart(docs: DataFrame, *taken: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with columns that are named as one of `taken` renamed, and what takes a result back to the columns of docs."""
    columns = docs.columns
    new = {c: suffix_dedup.free([*columns, *taken], c)[0] for c in columns if c.lower() in taken}
    return docs.withColumnsRenamed(new), lambda out: out.select(*(F.col(new.get(c, c)).alias(c) for c in columns))


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    own, back = apart(docs, "score", "predicted")
    return back(toxicity.score(own, model, keep=own.columns).where("predicted = 0"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the row with the smallest doc_id stays, of several the one whose text has the smallest hash; rows without an id come after all others."""
    docs, back = apart(docs, "id_", "h_")
    named = docs.withColumns({"id_": F.coalesce("doc_id", F.lit(2**62) + F.pmod(F.xxhash64("text"), F.lit(2**62))), "h_": F.xxhash64("text")})
    group = near_dedup.groups(named.select(F.col("id_").alias("doc_id"), "text", "h_"), keep=["h_"])
    # A minimum is taken before the shuffle, and every row only asks whether it is one that stays, so no group is gathered.
    stay = group.where(F.col("doc_id") == F.col("class_id")).groupBy("root").agg(F.min(F.struct(F.col("doc_id").alias("id_"), "h_")).alias("s")).select("s.*")
    return back(named.join(stay, ["id_", "h_"], "left_semi").dropDuplicates(["id_", "h_"]))


def letters(text: bytes, start: int, end: int) -> tuple[int, int]:
    """A span widened to the letters that it touches."""
    while start > 0 and text[start] & 0xC0 == 0x80:
        start -= 1
    while end < len(text) and text[end] & 0xC0 == 0x80:
        end += 1
    return start, end


def shortened(text: bytes, starts: list[int], ends: list[int]) -> str:
    spans = [letters(text, a, b) for a, b in zip(starts or [], ends or [], strict=True)]
    return suffix_dedup.kept(text, [a for a, _ in spans], [b for _, b in spans])[0].decode()


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that earlier documents hold go from each text; a letter that loses some of its bytes goes whole.  A null text stays null, and one that loses everything becomes empty."""
    columns = docs.columns
    found, starts, ends = suffix_dedup.with_spans(docs)
    names = found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", suffix_dedup.STEP):
                at = {c: b.column(k) for k, c in enumerate(names)}
                text = [None if t is None else shortened(t, s, e) for t, s, e in zip(at["text"].cast(pa.binary()).to_pylist(), at[starts].to_pylist(), at[ends].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()) if c == "text" else at[c] for c in columns], columns)

    out = found.mapInArrow(tidied(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*columns) if "n_chars" in columns else out


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which a window of a benchmark item occurs go."""
    own, back = apart(docs, "n_words", "starts", "ends", "items")
    return back(decontaminate.hits(own, table(spark, sf_dir, "benchmark")).where(F.size("starts") == 0))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with what decoding gives."""
    keep = [c for c in ("lang", "source") if c in docs.columns]
    got = bpe.encode_decode(docs, vocabulary("word_bpe_49k.json"), keep=keep)
    return got.select("doc_id", *keep, "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", by_few_rows(clean_of_toxicity)),
    ("near_dedup", by_few_rows(one_of_each_group)),
    ("suffix_dedup", by_few_rows(without_repeats)),
    ("decontaminate", by_few_rows(without_benchmark)),
    ("bpe", by_few_rows(encoded)),
]

#: SQL cannot express the classifier, the signatures or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = scratch(spark, f"pipeline-{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
