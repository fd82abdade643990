"""SentencePiece encoding and decoding through a distinct-chunk table.

No piece of the model has a space marker after another character, so a marked word is segmented the
same way wherever it stands: each distinct marked word is segmented once per worker table and the ids
are joined back by position. The table is kept by each Python worker and bounded
(tokens.MAX_CHUNKS); one table for the whole corpus would need a join of every word position.

Nulls and empty texts give no ids and decode to "". Models whose pieces cross markers are encoded
whole. Extra columns, clashing names among them, are ignored: only the id and text columns are read. Repeated
rows come as often as they are there. An empty table gives no row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of
from .tokens import PieceChunks, shared

OUTPUTS = {
    "ids": "array<int>",
    "decoded": "string",
    "n_tokens": "long",
    "ids_sha256": "string",
    "decoded_sha256": "string",
}


def encode_decode(df: DataFrame, model: str, outputs=("ids", "decoded"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text with the model and decode its ids again.

    outputs names the columns wanted beside the id: the real ids and the decoded text, or digests of
    them where only those are needed (ids_sha256 is over decimal ids joined by commas).
    """
    outputs = tuple(outputs)
    schema = ", ".join([f"{id_col} long", *(f"{o} {OUTPUTS[o]}" for o in outputs)])
    want_text = {"decoded", "decoded_sha256"} & set(outputs)

    def run(batches):
        table = shared(PieceChunks, model)
        for batch in batches:
            texts = texts_of(batch, "text")
            cols: dict[str, list] = {o: [] for o in outputs}
            for raw in table.encode(texts):
                ids = np.frombuffer(raw, "<u4").tolist()
                text = table.lib.decode(ids) if want_text and ids else ""
                for o, col in cols.items():
                    if o == "ids":
                        col.append(ids)
                    elif o == "n_tokens":
                        col.append(len(ids))
                    elif o == "ids_sha256":
                        col.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                    elif o == "decoded":
                        col.append(text)
                    else:
                        col.append(hashlib.sha256(text.encode()).hexdigest())
            kinds = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(cols[o], kinds.get(o, pa.string())) for o in outputs)], names=[id_col, *outputs]
            )

    rows = df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)
