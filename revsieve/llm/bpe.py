"""Exact byte-pair encoding by one pass over the prefixes of a word, and decoding.

The encoding of a word's prefix ends in one token only. For each prefix, an automaton over the vocabulary
names the tokens that are its suffixes; the longest one that may follow the last token of what is left of it
is stored. A token may follow another if byte-pair encoding of the two strings together would keep them
apart, which depends on the pair alone: it fails if some merge joins a right part of the first and a left
part of the second before either has grown on. Back-pointers from the last prefix give the ids.

Normalisation and splitting into words are those of the tokenizer file: for characters up to U+024F by the
patterns below, beyond by the file's own normaliser and splitter, since classes of rarer characters differ
between Unicode versions. Text between ASCII blanks is independent of its surroundings, and so is kept in a
bounded table of finished results.

Defined cases: null and empty texts have no ids and decode to an empty text; the special tokens' strings in
a text become their ids; repeated rows are encoded alike; other columns pass through unchanged (a column that
has the name of an added one is replaced).
"""

from __future__ import annotations

import json
import unicodedata
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revsieve.llm.common import documents, pieces, schema_with, share, ship

ship(__name__)

END = "\x00"
KEPT = 400_000
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = [""] * 256, 0
    for b in range(256):
        if b in shown:
            letters[b] = chr(b)
        else:
            letters[b], extra = chr(256 + extra), extra + 1
    return letters


class Vocabulary:
    """Tokens, merges and the automaton of one tokenizer file; its size is that of the file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.source = f.read()
        spec = json.loads(self.source)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (ids | self.special).items()}
        self.parts: dict[int, tuple[int, int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pair = (ids[a], ids[b])
            self.rank[pair] = rank
            self.parts[ids[a + b]] = (rank, *pair)
        reachable = self._reachable()
        self.automaton = ahocorasick.Automaton()
        for text, i in ids.items():
            if i in reachable:
                written = text.removesuffix(self.suffix) + END if text.endswith(self.suffix) else text
                self.automaton.add_word(written, (i, len(written)))
        self.automaton.make_automaton()

    def _reachable(self) -> set[int]:
        """Tokens that encoding their own string gives: no merge across the last joint comes before the last one."""
        found = set(self.token) - set(self.parts)
        for t, (rank, a, b) in sorted(self.parts.items(), key=lambda x: x[1][0]):
            if a in found and b in found and self.first_join(a, b, rank) is None:
                found.add(t)
        return found

    def _edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """A token's parts along one edge: each with the ranks at which it comes and goes."""
        known = self.edges[side].get(token)
        if known is None:
            made, *halves = self.parts.get(token, (-1,))
            known = [(token, made, 1 << 60)]
            if halves:
                (part, since, _), *rest = self._edge(halves[side], side)
                known += [(part, since, made), *rest]
            self.edges[side][token] = known
        return known

    def first_join(self, left: int, right: int, before: int = 1 << 60) -> int | None:
        """Rank of a merge under ``before`` that joins the two tokens' parts across their border, if there is one.

        At equal rank the merge further left comes first: a part of the left token that its own merge takes at
        that rank is gone, a part of the right one is still there.
        """
        rights = self._edge(right, 0)
        for a, made_a, gone_a in self._edge(left, 1):
            for b, made_b, gone_b in rights:
                rank = self.rank.get((a, b))
                if rank is not None and rank < before and made_a <= rank < gone_a and made_b < rank <= gone_b:
                    return rank
        return None


class Encoder:
    """Encodes and decodes in one task; what it keeps of earlier words is bounded."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.letters = byte_letters()
        self.start = max(vocabulary.token) + 1  # stands before the first token
        self.fits: dict[int, bool] = {}
        self.done: dict[bytes, tuple[int, ...]] = {}
        names = "|".join(map(regex.escape, sorted(self.v.special, key=len, reverse=True)))
        self.specials = regex.compile(f"({names})") if names else None
        self.library = None

    def word(self, word: str) -> list[int]:
        """Ids of one word, given in byte letters."""
        text = word + END
        token = [-1] * (len(text) + 1)
        size = token[:]
        token[0], fits, scale = self.start, self.fits, self.start + 1
        for end, (t, n) in self.v.automaton.iter(text):  # at each end, longer tokens first
            end += 1
            before = token[end - n]
            if before < 0 or token[end] >= 0:
                continue
            pair = before * scale + t
            ok = fits.get(pair)
            if ok is None:
                ok = fits[pair] = before == self.start or self.v.first_join(before, t) is None
            if ok:
                token[end], size[end] = t, n
        if len(fits) > KEPT:
            fits.clear()
        ids, at = [], len(text)
        while at:
            ids.append(token[at])
            at -= size[at]
        return ids[::-1]

    def words(self, text: str) -> list[str]:
        """Words of a text without blanks, in byte letters."""
        if text.isascii():  # such characters stand for themselves, but for control characters
            if text.isprintable():
                return WORD.findall(text.lower())
        if max(text) <= "ɏ":
            found = WORD.findall(unicodedata.normalize("NFC", text).lower())
            return ["".join([self.letters[b] for b in w.encode()]) for w in found]
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.v.source)
        normal = self.library.normalizer.normalize_str(text)
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def chunk(self, chunk: bytes) -> tuple[int, ...]:
        text = chunk.decode()
        if text.isascii() and text.isalpha():
            return tuple(self.word(text.lower()))
        if b"<|" not in chunk or self.specials is None:
            return tuple(i for w in self.words(text) for i in self.word(w))
        ids: list[int] = []
        for part in self.specials.split(text):
            if part in self.v.special:
                ids.append(self.v.special[part])
            elif part:
                ids.extend(i for w in self.words(part) for i in self.word(w))
        return tuple(ids)

    def encode(self, text: str | None) -> np.ndarray:
        chunks = (text or "").encode().split()
        if len(self.done) > KEPT:
            self.done.clear()
        done = self.done
        for c in set(chunks).difference(done):
            done[c] = self.chunk(c)
        return np.fromiter(chain.from_iterable(map(done.__getitem__, chunks)), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Token strings joined by a blank, as the file, which names no decoder, asks for."""
        return " ".join(map(self.v.token.__getitem__, ids.tolist()))


def encode_decode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The table with the token ids of each text and the text they decode to. No shuffle."""
    shared = share(df.sparkSession, Vocabulary(path))
    kept = df.drop(ids, decoded)

    def run(batches):
        encoder = Encoder(shared())
        for batch in pieces(batches):
            found = [encoder.encode(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
            texts = pa.array([encoder.decode(f) for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, texts], [*batch.schema.names, ids, decoded])

    return kept.mapInArrow(run, schema_with(kept, f"`{ids}` array<int>", f"`{decoded}` string"))


def digests(df: DataFrame) -> DataFrame:
    """One row a document: how many tokens, and digests of ids and of the decoded text."""
    written = F.array_join(F.col("ids").cast("array<string>"), " ")
    return df.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(written.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(documents(spark, sf_dir).select("doc_id", "text"), default_path()))
