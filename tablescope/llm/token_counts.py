"""Token counts of whole texts by a tokenizer that is compiled to finite-state machines (see ``transducer``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import ship_by_value, text_slices, utf8
from tablescope.llm.transducer import character_classes, transducer

LIMIT = 512


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    ``n_tokens`` is the length of what the ``tokenizers`` library gives without added begin or end; ``n_bytes`` counts
    UTF-8. Null and empty texts have neither bytes nor tokens. Repeated rows and ids stay, each counted by itself; other
    columns are not read; an empty table gives an empty result. Long texts are read in windows. ``vocabulary`` is a
    file of a byte-level BPE that executors can open.
    """
    ship_by_value()
    classes = character_classes(vocabulary)
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = transducer(vocabulary, classes)
        for batch in batches:
            for part in text_slices(batch):
                data, places = utf8(part.column("text"))
                count = compiled.counts(data, places)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(places)), pa.array(count), pa.array(count > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return chosen.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
