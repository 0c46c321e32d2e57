"""Scenes, chunks and extraction windows of ordered text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

SCENE_GAP, CHUNK_MAX, CHUNK_MIN, WINDOW_MAX = 4.0, 1400, 200, 2200


def scenes(rows: DataFrame, doc: str, order: list[str], start: Column, end: Column, gap: float = SCENE_GAP) -> DataFrame:
    """`scene`, from 0: a new one where a row starts gap or more after the end of the row before."""
    w = W.partitionBy(doc).orderBy(*order)
    far = rows.withColumn("_s", start).withColumn("_e", end)
    far = far.withColumn("_new", F.when(F.col("_s") - F.lag("_e").over(w) >= gap, 1).otherwise(0))
    return far.withColumn("scene", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("_s", "_e", "_new")


def _pack(keys: list[str], most: int, least: int | None, joined: int):
    """Numbers of the groups of ordered rows, streaming over sorted batches; memory holds one row's state."""

    def run(batches):
        last, number, held = None, 0, 0
        for batch in batches:
            out = []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*keys, "_n", "_ends")]
            for *key, n, ends in zip(*columns, strict=True):
                n = n or 0
                if key != last:
                    last, number, held = key, 0, 0
                grown = held + n + 1 if least is not None else held + n
                if held and (grown > most or (least is not None and ends and grown > least)):
                    number, held = number + 1, 0
                held += n + 1 if least is not None else n + (joined if held else 0)
                out.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.int32())], names=[*batch.schema.names[:-2], "group"])

    return run


def pack(rows: DataFrame, doc: str | list[str], order: list[str], text: str, most: int, least: int | None = None, joined: int = 1, carried: tuple[str, ...] = ()) -> DataFrame:
    """`group`, from 0 in each doc (or doc and scene): consecutive rows of limited length.

    With `least`, a group closes before a row that would exceed `most`, or before one that ends a
    sentence and takes it over `least`. Without, only before one that would exceed `most`, joining spaces
    of what is held counted and the new one's not. carried: other columns to keep.
    """
    keys = [doc] if isinstance(doc, str) else doc
    kept = rows.select(*keys, *[o for o in order if o not in keys], text, *carried)
    held = kept.withColumn("_n", F.length(text)).withColumn("_ends", F.col(text).rlike(r"[.!?]\z"))  # `$` would look past a last line break
    schema = T.StructType([*kept.schema.fields, T.StructField("group", T.IntegerType())])
    return held.repartition(F.col(keys[0])).sortWithinPartitions(*keys, *order).mapInArrow(_pack(keys, most, least, joined), schema)


def _joined(order: str, text: str) -> Column:
    """Texts in order, joined by spaces, without empty ones; spaces of any width at the ends go."""
    pieces = F.array_sort(F.collect_list(F.struct(order, text)))
    return F.regexp_replace(F.array_join(F.filter(F.transform(pieces, lambda p: p[text]), lambda t: t != ""), " "), r"^\p{Zs}+|\p{Zs}+\z", "")


def chunks(rows: DataFrame, doc: str, order: str, text: str, most: int = CHUNK_MAX, least: int = CHUNK_MIN) -> DataFrame:
    """(doc, group, first, last, n, text): packed rows of one scene each."""
    packed = pack(rows, doc, [order], text, most, least)
    return packed.groupBy(doc, "group").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), _joined(order, text).alias("text"))


def chunk_records(cues: DataFrame, doc: str, order: str, text: str, start: str, end: str, gap: float = SCENE_GAP, most: int = CHUNK_MAX, least: int = CHUNK_MIN) -> DataFrame:
    """Chunks of cleaned cues, never over a scene's end: (chunk_id, document_id, scene_i, cue_start, cue_end, start_ms, end_ms, text).

    A chunk lasts from the earliest start to the latest end of its cues, which may overlap or stand out of order.
    """
    spoken = scenes(cues.where(F.col(text) != ""), doc, [order], F.col(start), F.col(end), gap)
    packed = pack(spoken, [doc, "scene"], [order], text, most, least, carried=(start, end))
    held = packed.groupBy(doc, "scene", "group").agg(
        F.min(order).alias("cue_start"), F.max(order).alias("cue_end"), millis(F.min(start)).alias("start_ms"), millis(F.max(end)).alias("end_ms"), _joined(order, text).alias("text")
    )
    return held.select(chunk_id(F.col(doc), F.col("scene"), F.col("cue_start")).alias("chunk_id"), F.col(doc).alias("document_id"), F.col("scene").alias("scene_i"), "cue_start", "cue_end", "start_ms", "end_ms", "text")


def millis(seconds: Column) -> Column:
    """Whole milliseconds, cut off."""
    return (seconds * 1000).cast("int")


def chunk_id(doc: Column, scene: Column, first: Column) -> Column:
    return F.format_string("%s#s%04dc%05d", doc, scene, first)


def window_id(doc: Column, number: Column) -> Column:
    return F.format_string("%s#w%04d", doc, number)
