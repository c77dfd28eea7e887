"""Structure-aware chunks: sections packed to a token budget under their heading path, tables and equations whole.

Packing resets whenever the budget overflows, which no window expresses: each
document's ordered blocks go through one pandas group (a document is small).
Null contents count as empty; a single block over the limit is cut by sentences.
A heading closes those of its level and deeper; one without a recorded level has level 1.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.layout import blocks, reading_order

#: Tokens a section aims at and may not pass (fixed values).
TARGET, MOST = 450, 600
OUT = "doc_id bigint, chunk_no int, kind string, heading string, text string, block_ids array<string>, pages array<int>, min_confidence double, tokens int"
WHOLE = {"table": "table", "equation": "equation", "chart": "chart"}


def estimate(text: str) -> int:
    return int(len(text.split()) * 1.3) + 1


def split_long(text: str, limit: int) -> list[str]:
    """Sentences packed in order up to ``limit`` tokens; one longer sentence stays whole."""
    parts, held = [], ""
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        joined = f"{held} {sentence}".strip()
        if held and estimate(joined) > limit:
            parts.append(held)
            held = sentence
        else:
            held = joined
    return [*parts, held] if held else parts


def pack(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("position", kind="stable")
    out, path, held = [], [], []  # path: (level, heading)

    def emit(kind: str, rows: list[tuple], text: str) -> None:
        known = [r[2] for r in rows if r[2] is not None and r[2] == r[2]]
        pages = sorted({int(r[1]) for r in rows if r[1] is not None and r[1] == r[1]})
        out.append((part["doc_id"].iloc[0], len(out), kind, json.dumps([t for _, t in path], ensure_ascii=False), text, [r[0] for r in rows], pages, round(min(known), 4) if known else None, estimate(text)))

    def close() -> None:
        nonlocal held
        if held:
            emit("section", held, "\n".join(r[3] for r in held))
            held = []

    for block, kind, content, page, confidence, level in part[["block_id", "type", "content", "page", "confidence", "level"]].itertuples(index=False):
        text = content if isinstance(content, str) else ""
        if kind == "heading":
            close()
            depth = int(level) if level == level and level else 1
            while path and path[-1][0] >= depth:
                path.pop()
            path.append((depth, text.strip()))
        elif kind in WHOLE:
            close()
            emit(WHOLE[kind], [(block, page, confidence, text)], text)
        elif kind not in ("header", "footer") and text.strip():
            for piece in split_long(text, MOST) if estimate(text) > MOST else [text]:
                if held and estimate("\n".join(r[3] for r in held) + "\n" + piece) > TARGET:
                    close()
                held.append((block, page, confidence, piece))
    close()
    return pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def build_chunks(rows: DataFrame) -> DataFrame:
    """Chunks of placed blocks (``doc_id, block_id, type, content, page, confidence, level, position``)."""
    wanted = rows.select("doc_id", "block_id", "type", "content", "page", "confidence", "level", "position")
    return wanted.groupBy("doc_id").applyInPandas(pack, OUT)


def placed_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return reading_order(blocks(spark, folder)).withColumnRenamed("heading_level", "level")


def chunk_sections(spark: SparkSession, folder: str) -> DataFrame:
    return build_chunks(placed_blocks(spark, folder))


def chunk_conservation(spark: SparkSession, folder: str) -> DataFrame:
    """Words of body blocks against words of their chunks: packing loses and invents none."""
    from paperloom.functions.text import content_words

    placed = placed_blocks(spark, folder)
    body = placed.filter(~F.col("type").isin("heading", "header", "footer") & (F.trim("content") != ""))
    a = body.groupBy("doc_id").agg(F.sum(F.size(content_words(F.col("content")))).alias("block_words"))
    b = build_chunks(placed).groupBy("doc_id").agg(F.sum(F.size(content_words(F.col("text")))).alias("chunk_words"))
    return a.join(b, "doc_id", "full_outer")


QUERIES = {"chunk_sections": chunk_sections, "chunk_conservation": chunk_conservation}
ORACLE: dict[str, str] = {}
