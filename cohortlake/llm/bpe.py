"""1. Byte-level BPE: texts to ids and ids to bytes, by tiktoken with a rank file given as a path.

Every text is encoded whole. Texts longer than ``PIECE`` characters are first cut where the pattern can never
match across, so that the ids are those of the uncut text while the library works on short strings.

Cases: a null or empty text has no ids; ids null decode to null, no ids to no bytes; an unknown id raises. Rows are
independent: repeated rows and ids give repeated results, an empty table an empty one. An input column with the
name of a result column is replaced by the result, all others stay.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from cohortlake.llm.common import slices

RANKS = "byte_bpe_multi_50k.tiktoken"
PIECE = 1 << 15
#: No match of the pattern goes from a character that is no white space to a blank or a line feed; \s of the regex
#: library has every white space that the library's pattern knows, and a few more, which only makes cuts rarer.
AT_SPACE = regex.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \n])")
#: Nor from a letter to what is neither letter nor white space (a contraction starts with its apostrophe).
AT_CLASS = regex.compile(r"(?<=\p{L})(?=[^\s\p{L}\p{M}\p{Cn}])|(?<=[0-9])(?=[^\s\p{N}\p{Cn}])")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """The text in order, cut only where no token can cross. A run without such a place stays whole."""
    at = 0
    while len(text) - at > most:
        cut = AT_SPACE.search(text, at + most, at + 2 * most) or AT_CLASS.search(text, at + most) or AT_SPACE.search(text, at + most)
        if not cut:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def _ids(column: pa.Array, enc: tiktoken.Encoding, most: int) -> pa.Array:
    out = []
    for part in slices(pa.RecordBatch.from_arrays([column], ["text"]), "text", 1 << 20):
        sizes, got = [], []
        for text in part.column("text").to_pylist():
            own = [enc.encode_to_numpy(p) for p in pieces(text, most)] if text else []
            sizes.append(sum(map(len, own)))
            got += own
        values = np.concatenate(got).astype(np.int32) if got else np.zeros(0, np.int32)
        out.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(values)))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))


def encode(docs: DataFrame, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN, text: str = "text",
           ids: str = "ids", piece: int = PIECE) -> DataFrame:
    """The documents with an array of token ids. ``ranks`` is the path of the rank file on every executor."""
    path = ranks or public_tokenizers.path(RANKS)

    @F.arrow_udf(ArrayType(IntegerType(), False))
    def run(column: pa.Array) -> pa.Array:
        return _ids(column, encoding(path, pattern), piece)
    # marked so that a later step on the ids reads this column instead of encoding again
    return docs.withColumn(ids, run.asNondeterministic()(text))


def decode(docs: DataFrame, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN, ids: str = "ids",
           data: str = "bytes") -> DataFrame:
    """The rows with the raw bytes of their ids; they need not be whole characters, so they stay binary."""
    path = ranks or public_tokenizers.path(RANKS)

    @F.arrow_udf(BinaryType())
    def run(column: pa.Array) -> pa.Array:
        enc = encoding(path, pattern)
        values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        return pa.array([enc.decode_bytes(values[a:b].tolist()) if ok else None for a, b, ok in zip(at, at[1:], valid)], pa.binary())
    return docs.withColumn(data, run(ids))


def digests(docs: DataFrame, **options) -> DataFrame:
    """Per document: number of ids, hash of the ids as decimal text, hash of the decoded bytes."""
    coded = decode(encode(docs.select("doc_id", "text"), **options), **{k: v for k, v in options.items() if k in ("ranks", "pattern")})
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                        F.sha2("bytes", 256).alias("decoded_sha256"))
