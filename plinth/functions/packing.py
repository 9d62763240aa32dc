"""Long texts packed for the way through a shuffle, and read again where they are put together."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACK_LEVEL = 9
_LENGTH = 8


@F.arrow_udf(T.BinaryType())
def packed_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Each text compressed on its own (zstd), behind its length in bytes; NULL stays NULL."""
    codec = pa.Codec("zstd", PACK_LEVEL)

    def pack(text: pa.Scalar) -> bytes | None:
        if not text.is_valid:
            return None
        raw = text.as_buffer()
        return raw.size.to_bytes(_LENGTH, "big") + codec.compress(raw, asbytes=True)

    for texts in batches:
        yield pa.array((pack(t) for t in texts), pa.binary())


def unpacked(packed: bytes) -> bytes:
    """The UTF-8 bytes of a packed text."""
    size = int.from_bytes(packed[:_LENGTH], "big")
    return pa.Codec("zstd").decompress(packed[_LENGTH:], decompressed_size=size, asbytes=True)


@F.arrow_udf(T.StringType())
def listed_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Packed texts of an array of (place, packed), by place and text, joined by "; "."""
    for lists in batches:
        out = []
        for items in lists.to_pylist():
            texts = sorted((i["place"], unpacked(i["packed"])) for i in items)
            out.append(b"; ".join(text for _, text in texts))
        yield pa.array(out, pa.binary()).cast(pa.string())
