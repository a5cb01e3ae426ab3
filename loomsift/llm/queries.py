"""Queries of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsift.llm import canon, defects, mixing, mojibake, overlap, packing, pii, sentences, tokens
from loomsift.session import written
from loomsift.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _p3_assigned(spark: SparkSession, d: str) -> DataFrame:
    keyed = (
        canon.keyed_chat(table(spark, d, "clean"), "clean", "messages", "role", "content")
        .unionByName(canon.keyed_chat(table(spark, d, "sharegpt_clean"), "sharegpt_clean", "conversations", "from", "value"))
        .unionByName(canon.keyed_lines(table(spark, d, "raw_lines"), "raw_lines"))
    )
    return canon.runs(keyed)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows equal to an earlier row of their table."""
    return canon.copies(_p3_assigned(spark, d))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    """One row for each kind of record, with its number of copies."""
    return canon.collapsed(_p3_assigned(spark, d))


def turn_texts(df: DataFrame, name: str, turns: str, text: str) -> DataFrame:
    """(table_name, line_no, turn, text) of every turn that has a text."""
    each = df.select("line_no", F.posexplode(turns).alias("turn", "m"))
    return each.select(F.lit(name).alias("table_name"), "line_no", F.col("turn").cast("bigint"), F.col("m")[text].alias("text")).where("text is not null")


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    """Damaged texts, restored as far as they can be."""
    chat = turn_texts(table(spark, d, "clean"), "clean", "messages", "content")
    answers = table(spark, d, "alpaca_clean").select(F.lit("alpaca_clean").alias("table_name"), "line_no", F.lit(0).cast("bigint").alias("turn"), F.col("output").alias("text"))
    return mojibake.damaged_texts(chat.unionByName(answers.where("text is not null")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts of which any part was decoded with a wrong encoding."""
    return p5_restored(spark, d).select("table_name", "line_no", "turn").distinct()


def _p1_texts(spark: SparkSession, d: str) -> DataFrame:
    chat = turn_texts(table(spark, d, "clean"), "clean", "messages", "content")
    return chat.unionByName(turn_texts(table(spark, d, "sharegpt_clean"), "sharegpt_clean", "conversations", "value"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of personal information in each message."""
    return pii.kinds_found(_p1_texts(spark, d), table(spark, d, "name_list")).distinct()


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Messages that hold personal information, with typed placeholders in its place."""
    return pii.redacted(_p1_texts(spark, d), table(spark, d, "name_list"))


def p2_rows(spark: SparkSession, d: str) -> DataFrame:
    """The texts of both sides: first user messages of clean, instructions of alpaca_clean."""
    role = lambda m: F.regexp_replace(F.lower(m["role"]), "\\s+", "") == "user"
    chat = overlap.sided(table(spark, d, "clean"), "clean", F.get(F.filter("messages", role), F.lit(0))["content"])
    return chat.unionByName(overlap.sided(table(spark, d, "alpaca_clean"), "alpaca_clean", F.col("instruction")))


def _p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = p2_rows(spark, d)
    return overlap.row_pairs(rows, overlap.text_pairs(rows))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of rows, one in training and one held out, with equal or near-equal texts."""
    a, b = F.col("train_line"), F.col("eval_line")
    return _p2_pairs(spark, d).select("table_name", F.least(a, b).alias("line_a"), F.greatest(a, b).alias("line_b")).distinct()


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping pairs and held-out rows by table, split and source."""
    pairs = _p2_pairs(spark, d)
    return pairs.groupBy("table_name", "eval_split", "eval_source", "train_source").agg(
        F.count("*").alias("pairs"), F.countDistinct("eval_line").alias("eval_rows"), F.countDistinct("train_line").alias("train_rows"), F.count_if(F.col("distance") == 0).alias("exact_pairs")
    )


def p4_answers(spark: SparkSession, d: str) -> DataFrame:
    """(table_name, line_no, field_name, question, extra, answer) of every answer."""
    alpaca = table(spark, d, "alpaca_clean").select(
        F.lit("alpaca_clean").alias("table_name"), "line_no", F.lit("output").alias("field_name"), F.coalesce("instruction", F.lit("")).alias("question"), F.col("input").alias("extra"), F.col("output").alias("answer")
    )
    pairs = table(spark, d, "preference_clean").select(
        F.lit("preference_clean").alias("table_name"), "line_no", F.col("prompt").alias("question"), F.lit(None).cast("string").alias("extra"),
        F.explode(F.array(*(F.struct(F.lit(x).alias("field_name"), F.col(x).alias("answer")) for x in ("chosen", "rejected")))).alias("a"),
    )
    return alpaca.unionByName(pairs.select("table_name", "line_no", "a.field_name", "question", "extra", "a.answer"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective answers with their defects."""
    return defects.defects(p4_answers(spark, d)).distinct()


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    """The container of each text or piece, for each capacity."""
    sized = tokens.sized(table(spark, d, "documents").select("doc_id", "text"))
    return packing.packed(written(sized, "sizes"), packing.pack_capacities(table(spark, d, "pack_sizes")))


def p6_room(spark: SparkSession, d: str) -> DataFrame:
    """Containers used and room wasted, for each capacity."""
    return packing.room_left(p6_packing(spark, d), packing.pack_capacities(table(spark, d, "pack_sizes")))


def _p7(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, d, "documents")
    keyed = documents.select("doc_id", "source", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"), "text")
    targets = mixing.read_targets(table(spark, d, "mix_targets"))
    wanted = keyed.where(F.col("source").isin(list(targets)))
    return mixing.mixture(tokens.sized(wanted), targets)


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The chosen texts with their repeats."""
    return _p7(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and actual share of each source."""
    return _p7(spark, d)[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Sentence units of every document."""
    return sentences.sentence_units(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p1_redacted": p1_redacted, "p3_found": p3_found, "p3_records": p3_records, "p2_found": p2_found, "p2_report": p2_report, "p4_found": p4_found, "p5_found": p5_found, "p5_restored": p5_restored, "p6_packing": p6_packing, "p6_room": p6_room, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found}
ORACLE: dict[str, str] = {}
