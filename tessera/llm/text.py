"""Text helpers that several operators share: all work on bytes and whole texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A-Z to a-z, all other bytes as they are.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: A-Z to a-z; ASCII bytes other than letters and digits to a space; bytes from 0x80 on stay.
ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def space_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of anything but space and U+0009 to U+000D."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def space_words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``space_words`` of many texts by Arrow's kernels: their words (binary) in a row, and how many each text has."""
    bare = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    lists = pc.ascii_split_whitespace(pc.if_else(pc.equal(bare, ""), None, bare))
    return lists.flatten().cast(pa.binary()), pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM).split() if text else []


def crc_mod(column: str, mod: int) -> Column:
    """crc32 of the column as text, modulo ``mod``; null for null."""
    return F.crc32(F.col(column).cast("string")) % F.lit(mod)


def hash_share(key: Column, rows: int, bound: int, seed: int = 11) -> Column:
    """Whether a row is in the sample of about ``bound`` of ``rows`` rows that the hash of its key draws (all, if they are no more)."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, bound / max(1, rows)) * (1 << 30))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_documents(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")
