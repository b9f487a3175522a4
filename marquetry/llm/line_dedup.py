"""Line dedup: lines that several documents share stay only in the first document that has them.

One Arrow pass explodes every document into the 128-bit hashes of its distinct normalised lines. An aggregate
counts the distinct documents per hash (map-side combined, so a line of a third of all documents is no hot group);
hashes over the threshold are joined back to their occurrences - that join's hot side is split by adaptive
execution - and the hashes to drop, gathered per document, meet the texts in one left join. The last pass
reassembles the remaining lines by position. Texts are shuffled once, hashes three times.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, explode_rows, fresh, others

SPACE = b" \t\n\x0b\x0c\r"


def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """Hash of the key (ASCII space stripped at both ends, A-Z lower-cased), or None for a key that is too short."""
    key = line.strip(SPACE)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh128_digest(key.lower())  # bytes.lower() changes A-Z only


def shared_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """One row per document that loses lines: its id and ``drops``, the hashes of those lines."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def make():
        def hashes(ids, texts):
            out_ids, digests = [], []
            for doc, text in zip(ids, texts):
                if doc is None or not text:
                    continue
                own = {line_hash(x, min_chars) for x in text.encode().split(b"\n")}
                own.discard(None)
                out_ids += [doc] * len(own)
                digests += own
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            return out_ids, pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())

        return hashes

    lines = explode_rows(docs, [id_col, text_col], make, f"doc {id_type}, h1 bigint, h2 bigint")
    shared = (
        lines.groupBy("h1", "h2")
        .agg(F.count_distinct("doc").alias("docs"), F.min("doc").alias("first"))
        .where(F.col("docs") >= min_docs)
        .select("h1", "h2", "first")
    )
    later = lines.join(shared, ["h1", "h2"]).where(F.col("doc") != F.col("first"))
    return later.groupBy("doc").agg(F.collect_list(F.struct("h1", "h2")).alias("drops"))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    min_docs: int = 2,
    n_lines: str = "n_lines",
    n_dropped: str = "n_dropped",
) -> DataFrame:
    r"""``docs`` with shared lines removed from ``text_col`` and the columns ``n_lines`` and ``n_dropped``.

    A text is split at ``\n`` (null or empty: one empty line, and the text becomes empty). A line whose key has
    ``min_chars`` code points or more and occurs in ``min_docs`` documents or more stays only in the smallest
    id holding it, in all its repeats there. Rows with the same id are one document. A row without an id keeps all its
    lines and counts for no other. An empty table gives an empty table; other columns pass through unchanged, but for
    columns named like the two counts, which are replaced.
    """
    drops = shared_lines(docs, id_col, text_col, min_chars, min_docs)
    drop_col, doc_col = fresh(docs, "_drops"), fresh(docs, "_doc")
    drops = drops.select(F.col("doc").alias(doc_col), F.col("drops").alias(drop_col))
    joined = docs.join(drops, F.col(f"`{id_col}`") == F.col(doc_col), "left").drop(doc_col)

    def make():
        def reassemble(texts, dropped):
            kept, before, gone = [], [], []
            for text, drop in zip(texts, dropped):
                text = text or ""
                n = text.count("\n") + 1
                if drop:
                    raw = np.array([(d["h1"], d["h2"]) for d in drop], np.int64).tobytes()
                    out = {raw[i : i + 16] for i in range(0, len(raw), 16)}
                    lines = [x for x in text.encode().split(b"\n") if line_hash(x, min_chars) not in out]
                    text = b"\n".join(lines).decode()
                    gone.append(n - len(lines))
                else:
                    gone.append(0)
                kept.append(text)
                before.append(n)
            return kept, before, gone

        return reassemble

    return add_columns(
        joined, [text_col, drop_col], make, f"`{text_col}` string, `{n_lines}` bigint, `{n_dropped}` bigint", [drop_col]
    ).select(*[f"`{c}`" for c in others(docs, (n_lines, n_dropped))], f"`{n_lines}`", f"`{n_dropped}`")


def sha256(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()
