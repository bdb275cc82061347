"""Ids of texts by BPE tokenizers: each distinct part of plain text is encoded once and remembered."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from itertools import groupby
from typing import ClassVar

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer
from tokenizers.models import Model

#: Parts of texts whose ids a worker remembers; then it keeps those of the latest texts.
MEMORY = 200_000
#: Parts of more bytes aren't remembered.
LONG = 100
#: Ends a stretch of text.
STOP = "\x00"
WORD = re.compile(r"[^ \t-\r]+")
#: What isn't printable ASCII, a Latin-1 letter or ASCII white space, and the beginning of special tokens. Lower-casing and
#: normalisation leave each of the other characters one of them.
ODD = re.compile(r"[^!-~À-ÖØ-öø-ÿ \t-\r]|<\|")
#: Fixed value: how the tokenizers that WordIds knows split text; cut_words does the same for plain text in lower case.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Kinds of bytes in plain text: all bytes beyond ASCII are of letters.
WHITE, LETTER, DIGIT, SYMBOL, ENDS = range(5)
KINDS = np.array([ENDS if b == 0 else WHITE if chr(b) in " \t\n\v\f\r" else DIGIT if chr(b).isdigit() and b < 128 else LETTER if b >= 128 or chr(b).isalpha() else SYMBOL for b in range(256)], np.uint8)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE vocabularies."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(own))
    return [chr(c) for _, c in sorted([*((b, b) for b in own), *((b, 256 + k) for k, b in enumerate(rest))])]


CHARACTERS = dict(enumerate(byte_characters()))


def spelled(raw: bytes) -> str:
    """Bytes as the characters that stand for them."""
    return raw.decode("latin-1").translate(CHARACTERS)


def cut_contractions(raw: np.ndarray, begins: np.ndarray, allowed: np.ndarray) -> None:
    """Marks where 's 't 're 've 'm 'll 'd begin and end, at apostrophes where a part may begin with one."""
    here = np.flatnonzero((raw == ord("'")) & allowed)
    after = np.r_[raw, np.zeros(3, np.uint8)]
    one, two = after[here + 1], after[here + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for found, size in ((here[short], 2), (here[long], 3)):
        begins[found] = True
        for k in range(1, size):
            begins[found + k] = False
        begins[(found + size)[found + size < len(raw)]] = True


def cut_words(raw: np.ndarray) -> np.ndarray:
    """Where parts of plain lower-case text begin by PATTERN; what lies between them are parts of white space."""
    kind = KINDS[raw]
    before = np.r_[np.uint8(WHITE), kind[:-1]]
    begins = (kind != before) | (kind == DIGIT) | (kind == ENDS)
    begins[:1] = True
    cut_contractions(raw, begins, before != SYMBOL)
    return begins


class Parts:
    """Ids by a tokenizer's model of the parts that it takes whole. cut tells where those begin in the bytes of plain text.

    Equal parts of some text become one entry of a dictionary, so that each is looked up once, and tokenized only if it isn't remembered.
    white: whether white space has ids.
    """

    def __init__(self, model: Model, cut: Callable[[np.ndarray], np.ndarray], size: int, white: bool):
        self.model, self.cut, self.white = model, cut, white
        self.numbers = [k.to_bytes(4, "little") for k in range(size)]
        self.clear()

    def clear(self) -> None:
        """Forget the parts: a worker that goes on to other work keeps only the tokenizer."""
        self.known: dict[bytes, bytes] = {}

    def _ids(self, part: bytes) -> bytes:
        numbers = self.numbers
        if part.isalnum():
            return b"".join([numbers[t.id] for t in self.model.tokenize(part.decode())])
        if part == b"\x00" or not self.white and part.isspace():
            return b""
        return b"".join([numbers[t.id] for t in self.model.tokenize(spelled(part))])

    def encode(self, stretches: list[str]) -> list[bytes]:
        """The ids of each stretch of plain text as little-endian unsigned 32-bit numbers, all in one go."""
        raw = np.frombuffer(STOP.join(stretches).encode(), np.uint8)
        if not len(raw):
            return [b""] * len(stretches)
        at = np.flatnonzero(self.cut(raw))
        parts = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.r_[at, len(raw)].astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode()
        own, known = parts.dictionary.to_pylist(), self.known
        for part in own:
            if part not in known:
                known[part] = self._ids(part)
        values = [known[part] for part in own]
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        number = parts.indices.to_numpy()
        n = sizes[number]
        ends = np.cumsum(n)
        place = np.repeat((np.cumsum(sizes) - sizes)[number] - (ends - n), n) + np.arange(ends[-1])
        ids = np.frombuffer(b"".join(values), "<u4")[place]
        cuts = [0, *ends[raw[at] == 0].tolist(), len(ids)]
        if len(known) > MEMORY:
            self.known = dict(zip(own, values, strict=True)) if len(own) < MEMORY // 2 else {}
            known = self.known
        for part in [x for x in own if len(x) > LONG]:
            known.pop(part, None)
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def runs(pieces: list[str], plain: Callable[[str], object], joint: str) -> list[tuple[bool, str]]:
    """Neighbouring pieces that are plain come together; the others stay alone."""
    out = []
    for key, own in groupby(pieces, lambda x: bool(plain(x))):
        out += [(True, joint.join(own))] if key else [(False, x) for x in own]
    return out


def in_order(layout: list[list[tuple[bool, str]]], parts: Parts, whole: Callable[[str], bytes]) -> list[bytes]:
    """Ids of texts given as runs: plain ones through parts, all in one go, the others through whole."""
    ids = iter(parts.encode([x for text in layout for plain, x in text if plain]))
    return [b"".join([next(ids) if plain else whole(x) for plain, x in text]) for text in layout]


def takes_words(spec: dict) -> bool:
    """Whether a tokenizer's file describes the kind that the quick way is made for: lower case, white space dropped, PATTERN, bytes."""
    normal = spec.get("normalizer") or {}
    pre = spec.get("pre_tokenizer") or {}
    steps = [x.get("type") for x in normal.get("normalizers", [])]
    cuts = pre.get("pretokenizers", [])
    return (
        steps == ["NFC", "Replace", "Lowercase"] and normal["normalizers"][1].get("pattern") == {"Regex": "\\s+"} and normal["normalizers"][1].get("content") == " "
        and [x.get("type") for x in cuts] == ["Split", "ByteLevel"] and cuts[0].get("pattern") == {"Regex": PATTERN} and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") is True
        and cuts[1].get("add_prefix_space") is False and cuts[1].get("use_regex") is False and not spec.get("truncation") and not spec.get("padding")
        and all(re.fullmatch(r"<\|[^\s]*", x.get("content", "")) and not x.get("lstrip") and not x.get("rstrip") for x in spec.get("added_tokens", []))
    )


class WordIds:
    """Ids of whole texts without special tokens around them, as the tokenizer gives them.

    If the tokenizer's splits never cross ASCII white space (takes_words), a text's ids are its words' ids in a row:
    plain words are split here and their parts given to the tokenizer's model, other words go to the tokenizer. Any other tokenizer gets each text whole.
    """

    _own: ClassVar[dict[str, WordIds]] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.parts = Parts(self.tokenizer.model, cut_words, self.tokenizer.get_vocab_size(), white=False) if takes_words(spec) else None

    @classmethod
    def get(cls, path: str) -> WordIds:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def clear(self) -> None:
        if self.parts:
            self.parts.clear()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        if self.parts is None:
            return [self._whole(x) if x else b"" for x in texts]
        odd = ODD.search
        layout = [[] if not x else runs(WORD.findall(x), lambda w: not odd(w), " ") if odd(x) else [(True, x)] for x in texts]
        return in_order([[(plain, x.lower() if plain else x) for plain, x in text] for text in layout], self.parts, self._whole)
