"""Byte-level byte-pair encoding with the tiktoken library and a local rank file, and decoding to raw bytes.

The library splits a text by a pattern and encodes each match by itself, so a text may be cut wherever no match can
reach across. Texts longer than ``LIMIT`` characters are cut there, which keeps what the library holds at once small:

* before a blank that follows another character: no match has a blank after anything else;
* before the last blank of a run that goes on with another character: the run's other blanks are one match;
* where letters, digits and signs (but for the apostrophe, which starts a contraction) follow each other.

A run of ``LIMIT`` or more blanks is one match by the same rule and is encoded as one piece, since the library's
matcher runs out of stack on a million of them. Blanks are the 25 characters of Unicode's White_Space, as the library has them.
A match of any other kind is never cut, however long.

Defined cases: null and empty texts have no ids and decode to no bytes; special tokens do not exist, their strings are ordinary
text; repeated rows are encoded alike; other columns pass through unchanged, and one with the name of an added column is replaced.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revsieve.llm.common import documents, pieces, schema_with, share, ship

ship(__name__)

LIMIT = 1 << 16
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters of scripts written without blanks, and the signs that end their clauses.
LETTER, SIGN = r"\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3", r"\u3001\u3002\uff0c\uff01\uff1f\uff1a\uff1b"
CUT = regex.compile(
    rf"(?<=[^{BLANK}])(?=[{BLANK}])|(?<=[{BLANK}])(?=[{BLANK}][^{BLANK}])"
    r"|(?<=[A-Za-z])(?=[!-@[-`{-~])|(?<=[0-9])(?=[!-/:-~])|(?<=[!-&(-/:-@[-`{-~])(?=[A-Za-z0-9])"
    rf"|(?<=[{LETTER}])(?=[{SIGN}])|(?<=[{SIGN}])(?=[{LETTER}])"
)

RUN = regex.compile(rf"[{BLANK}]+")


def parts(text: str, limit: int = LIMIT):
    """The text in parts of about ``limit`` characters; no match of the pattern lies in two of them."""
    start = 0
    while len(text) - start > limit:
        cut = CUT.search(text, start + limit)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class Codec:
    """Encodes and decodes in one task."""

    def __init__(self, ranks: bytes, pattern: str, limit: int = LIMIT):
        import tiktoken

        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self.library = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.limit = limit

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        if len(text) <= self.limit:
            return np.array(self.library.encode_ordinary(text), np.int32)
        found = []
        for part in parts(text, self.limit):
            at = 0
            for run in RUN.finditer(part) if len(part) > 2 * self.limit else ():
                if run.end() - run.start() < self.limit:
                    continue
                end = run.end() - (run.end() < len(part))  # the last blank goes with what follows
                found.append(self.library.encode_ordinary(part[at : run.start()]))
                found.append(self.library._encode_single_piece(part[run.start() : end]))
                at = end
            found.append(self.library.encode_ordinary(part[at:]))
        return np.concatenate([np.array(f, np.int32) for f in found])

    def decode(self, ids) -> bytes:
        return self.library.decode_bytes(ids)


def _codec(df: DataFrame, path: str, pattern: str | None, limit: int):
    """A function that makes the codec in a task; the rank file is read once, here."""
    import public_tokenizers

    with open(path, "rb") as f:
        shared = share(df.sparkSession, (f.read(), pattern or public_tokenizers.PATTERN, limit))
    return lambda: Codec(*shared())


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", pattern: str | None = None, limit: int = LIMIT) -> DataFrame:
    """The table with the token ids of each text. No shuffle."""
    make, kept = _codec(df, path, pattern, limit), df.drop(ids)

    def run(batches):
        codec = make()
        for batch in pieces(batches):
            found = [codec.encode(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, ids])

    return kept.mapInArrow(run, schema_with(kept, f"`{ids}` array<int>"))


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded", pattern: str | None = None) -> DataFrame:
    """The table with the raw bytes that each row's ids stand for; a null list has none. An unknown id is an error."""
    make, kept = _codec(df, path, pattern, LIMIT), df.drop(decoded)

    def run(batches):
        codec = make()
        for batch in pieces(batches):
            found = [codec.decode(i or []) for i in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, decoded])

    return kept.mapInArrow(run, schema_with(kept, f"`{decoded}` binary"))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op11_tiktoken_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_path()
    out = decode(encode(documents(spark, sf_dir).select("doc_id", "text"), path).drop("text"), path)
    return out.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
