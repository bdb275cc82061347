"""Byte-level BPE over Arrow batches: ids, offsets in characters and bytes back, from a file of ranks."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from pagewatch.llm.common import slices, text_batches
from pagewatch.llm.word_ids import ENDS, KINDS, SYMBOL, WHITE, Parts, cut_contractions, in_order, runs, spelled

#: White space that isn't ASCII, and controls that regular-expression libraries don't agree on.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: Fixed value: the pattern that CUT and cut_chunks follow. With any other, texts go to the tokenizer whole.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A run of white space and what follows it. No match of the pattern crosses such a cut.
CUT = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: What isn't printable ASCII, a Latin-1 letter or ASCII white space: all regular-expression libraries sort the other characters alike.
ODD = re.compile(r"[^!-~À-ÖØ-öø-ÿ \t-\r]")


def cut_chunks(raw: np.ndarray) -> np.ndarray:
    """Where matches of the pattern begin in the bytes of text without odd characters.

    Of white space before something else the last character is apart from the rest, and a space goes with what follows.
    """
    kind = KINDS[raw]
    before, after = np.r_[np.uint8(ENDS), kind[:-1]], np.r_[kind[1:], np.uint8(ENDS)]
    white, spaced = kind == WHITE, np.r_[False, raw[:-1] == ord(" ")]
    begins = np.where(white, (before != WHITE) | (after != WHITE) & (after != ENDS), (kind != before) & ~spaced) | (kind == ENDS)
    begins[:1] = True
    cut_contractions(raw, begins, (before != SYMBOL) & ~spaced)
    return begins


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ranks, which run from 0 without a gap."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("the ranks have gaps")
    return tokens


def tokenizer_of(tokens: list[bytes], pattern: str) -> Tokenizer:
    """A tokenizer of the ranks: any two neighbours join whose bytes together are a token, the lowest rank first."""
    vocab = {spelled(t): k for k, t in enumerate(tokens)}
    merges = []
    for t in map(spelled, tokens):
        merges += [(t[:i], t[i:]) for i in range(1, len(t)) if t[:i] in vocab and t[i:] in vocab]
    out = Tokenizer(models.BPE(vocab, merges, ignore_merges=True))
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


class ByteBpe:
    """Encodes and decodes; each distinct part of plain text is encoded once a worker, up to a bounded memory."""

    _own: ClassVar[dict[tuple[str, str], ByteBpe]] = {}

    def __init__(self, path: str, pattern: str):
        self.tokens = read_ranks(path)
        self.tokenizer = tokenizer_of(self.tokens, pattern)
        self.parts = Parts(self.tokenizer.model, cut_chunks, len(self.tokens), white=True) if pattern == PATTERN else None

    @classmethod
    def get(cls, path: str, pattern: str) -> ByteBpe:
        key = (path, pattern)
        if key not in cls._own:
            cls._own[key] = cls(path, pattern)
        return cls._own[key]

    def clear(self) -> None:
        if self.parts:
            self.parts.clear()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        if self.parts is None:
            return [np.frombuffer(self._whole(x) if x else b"", "<u4") for x in texts]
        odd = ODD.search
        layout = [
            [] if not x else [(True, x)] if not odd(x) else [(False, x)] if ODD_SPACE.search(x) else runs(CUT.findall(x), lambda c: not odd(c), "")
            for x in texts
        ]
        return [np.frombuffer(x, "<u4") for x in in_order(layout, self.parts, self._whole)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one character of each id; a character whose bytes are split belongs to each id that has some."""
        raw = np.frombuffer(self.decode(ids), np.uint8)
        sizes = np.fromiter((len(self.tokens[i]) for i in ids.tolist()), np.int64, len(ids))
        end = np.cumsum(sizes)
        char = np.cumsum((raw & 0xC0) != 0x80)  # character, from 1, that each byte is of
        return char[end - sizes] - 1 if len(ids) else sizes, char[end - 1] if len(ids) else sizes


#: Ids as decimal text.
_TEXT: list[str] = []


def _decimal(ids: np.ndarray, size: int) -> str:
    if len(_TEXT) < size:
        _TEXT[:] = map(str, range(size))
    return ",".join(map(_TEXT.__getitem__, ids.tolist()))


def encode_documents(docs: DataFrame, ranks: str, pattern: str, text: str = "text", id: str = "doc_id", lists: bool = False) -> DataFrame:
    """A row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; with lists also ids, starts, ends (characters).

    The whole text is encoded without special tokens, and the ids are decoded again through the byte table. A null or empty
    text has no tokens, and the digests of nothing. Text that the decoder gives back is the text itself, byte by byte, also
    where an id ends inside a character. Null ids and repeated rows each give their row; other columns aren't read; an
    empty table gives none. ranks is a path on each executor, or a name given to SparkContext.addFile.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.get(ranks if "/" in ranks else SparkFiles.get(ranks), pattern)
        size = len(bpe.tokens)
        for batch in batches:
            n, own, back, more = [], [], [], [[], [], []]
            for ids in (x for _, texts in slices(batch["text"]) for x in bpe.encode_all(texts)):
                n.append(len(ids))
                own.append(hashlib.sha256(_decimal(ids, size).encode()).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if lists:
                    for to, x in zip(more, (ids, *bpe.offsets(ids)), strict=True):
                        to.append(x.tolist())
            out = {"doc_id": batch["doc_id"], "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(own, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
            if lists:
                out |= {k: pa.array(x, pa.list_(pa.int32())) for k, x in zip(("ids", "starts", "ends"), more, strict=True)}
            yield pa.RecordBatch.from_pydict(out)
        bpe.clear()

    text_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, starts array<int>, ends array<int>" * lists
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(stream, schema)


def decode_ids(df: DataFrame, ranks: str, pattern: str, ids: str = "ids") -> DataFrame:
    """df with decoded: the ids' bytes as text, where bytes that end inside a character give U+FFFD. Null ids give null."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.get(ranks if "/" in ranks else SparkFiles.get(ranks), pattern)
        for batch in batches:
            texts = [None if x is None else b"".join(bpe.tokens[i] for i in x).decode("utf-8", "replace") for x in batch[ids].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    from pyspark.sql.types import StringType, StructField, StructType

    return df.mapInArrow(stream, StructType([*df.schema.fields, StructField("decoded", StringType())]))
