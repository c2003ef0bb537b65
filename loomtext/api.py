"""The library's short names, over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.classify import classify
from loomtext.functions.jsonx import normalize_json
from loomtext.functions.providers import PROVIDERS, detect, parse
from loomtext.functions.text import normalize_prompt, prompt_type
from loomtext.operators import prompts, responses
from loomtext.operators.blocks import parse as parse_blocks
from loomtext.operators.blocks import reconstruct
from loomtext.operators.chunk import chunk
from loomtext.operators.dedup import flag, hashed, survivors
from loomtext.operators.segment import segment
from loomtext.plans.pipeline import normalize_any, normalize_inputs, normalize_outputs, process_file, process_prompts, process_texts

__all__ = [
    "PROVIDERS", "Prompts", "chunk", "classify", "detect", "flag", "hashed", "normalize_any", "normalize_inputs", "normalize_json", "normalize_outputs", "normalize_prompt",
    "parse", "parse_blocks", "process_file", "process_prompts", "process_texts", "prompt_type", "quick_process", "reconstruct", "responses", "segment", "survivors",
]


class Prompts:
    """Prompts in batches that share what has been seen."""

    def __init__(self, most: int = 2048, overlap: int = 200, auto_deduplicate: bool = False, seen: DataFrame | None = None):
        self.most, self.overlap, self.auto_deduplicate, self.seen = most, overlap, auto_deduplicate, seen

    def process(self, df: DataFrame, order: list[str]) -> DataFrame:
        """Segments of a batch (id, content); repeated ones are flagged, or dropped with auto_deduplicate."""
        found = prompts.process(df, order, most=self.most, overlap=self.overlap, seen=self.seen)
        return found.where(~F.col("duplicate")) if self.auto_deduplicate else found

    def remember(self, segments: DataFrame) -> None:
        """Later batches count these segments as seen. Pass written segments, so that they aren't computed again."""
        new = segments.select("hash").distinct()
        self.seen = new if self.seen is None else self.seen.select("hash").unionByName(new).distinct()

    def reset(self) -> None:
        self.seen = None

    def statistics(self, segments: DataFrame) -> DataFrame:
        return prompts.statistics(segments, self.most, self.overlap)


def quick_process(df: DataFrame, order: list[str], text: str | Column = "content") -> DataFrame:
    """Segments of a column of prompts without ids."""
    body = F.col(text) if isinstance(text, str) else text
    return Prompts().process(prompts.with_ids(df.select(*order, F.lit(None).cast("string").alias("id"), body.alias("content")), order), order)
