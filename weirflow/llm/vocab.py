"""Tokenizers on the executors, with each distinct fragment of text encoded once per worker."""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain, product
from pathlib import Path

import numpy as np
from pyspark import Broadcast
from pyspark.sql import SparkSession

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct fragments that a worker remembers; then it starts anew.
REMEMBERED = 1_200_000
#: Longer fragments are encoded but not remembered.
LONGEST = 48
#: White space for Python's patterns, but not for the tokenizers'.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: White space that fragments may begin with.
_SPACES = " \t\n\r\x0b\x0c"
#: A character of each kind that splitting patterns tell apart: fixed values.
_KINDS = ("a", "s", "Z", "é", "à", "漢", "1", "²", "'", ".", "-", "_", " ", "\n", "\t", "\u00a0", "\u3000", "😀")
_LETTER = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"


def spread(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file, read by the driver and sent to the workers: a few MB, whatever the corpus."""
    text = Path(path).read_text(encoding="utf-8")
    if len(text) > 64 << 20:
        raise ValueError(f"{path} is too large for a vocabulary")
    return spark.sparkContext.broadcast(text)


class Fragments:
    """Encodes texts by independent fragments.

    ``certain[a, b]`` says that bytes a, b stand next to each other inside no token, so no
    merge ever crosses that place. Every cut is made at such a pair: between a character other
    than white space and one of the ASCII white space, where the pair of the one's last byte
    and the other is certain, and between an ASCII letter and those ASCII signs that are
    certain after every letter. Where the pair isn't certain the text goes on in one fragment.

    A cut must also be one for the tokenizer's own splitting into words, which the table can't
    tell. ``check`` therefore compares fragments with whole texts, when a vocabulary is loaded,
    on all short texts over a character of each kind, and refuses a vocabulary that differs.

    Fragments are encoded alone, each distinct one once, and their ids put together. A tokenizer
    that drops white space gets the words between it, no further cuts; where it lower-cases, A-Z
    are lower-cased first.
    """

    def __init__(self, text: str, keep_spaces: bool):
        from tokenizers import Tokenizer

        told = json.loads(text)
        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t["content"] for t in told["added_tokens"]]
        self.tokens = self.bytes_of(told["model"]["vocab"], told["added_tokens"])
        self.certain = self.pairs(self.tokens, {t["id"] for t in told["added_tokens"]})
        self.keep_spaces = keep_spaces
        self.lower = "Lowercase" in json.dumps(told["normalizer"])
        self.pattern = self.cuts()
        self.known: dict[str, bytes] = {}
        self.blob = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.sizes = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.check()

    def cuts(self) -> re.Pattern:
        """A pattern whose matches are the fragments of a text."""
        letters = np.array([c for c in range(128) if chr(c).isalpha()])
        signs = [c for c in range(33, 127) if not chr(c).isalnum() and self.certain[letters, c].all()]
        # characters that end a fragment before white space, by their last byte
        ends = self.certain[:, [ord(c) for c in _SPACES]].all(axis=1)
        ascii_ends = [c for c in range(33, 127) if ends[c]]
        wide = "".join(f"{chr(c)}-{chr(c + n - 1)}" for c, n in self._runs(ends))
        end = "[" + re.escape("".join(map(chr, ascii_ends))) + wide + "]"
        space, word = f"[{_SPACES}]", f"[^{_SPACES}]+"
        goes_on = rf"(?:(?<!{end}){space}+{word})*" if ascii_ends or wide else rf"(?:{space}+{word})*"
        body = word + goes_on
        if signs:
            sign = "[" + re.escape("".join(map(chr, signs))) + "]"
            # signs up to the next white space go together: no cut is needed inside them
            alone = rf"{sign}+(?:(?<={end})(?={space})|\Z)" if ascii_ends else rf"{sign}+\Z"
            body = rf"{_LETTER}*[A-Za-z](?={sign})|{alone}|{body}"
        return re.compile(rf"{space}*(?:{body})|{space}+")

    @staticmethod
    def _runs(ends: np.ndarray) -> list[tuple[int, int]]:
        """Runs of two-byte and three-byte characters, surrogates aside, whose last byte is an end."""
        out: list[tuple[int, int]] = []
        for low in [b for b in range(0x80, 0xC0) if ends[b]]:
            if out and out[-1][0] + out[-1][1] == low:
                out[-1] = (out[-1][0], out[-1][1] + 1)
            else:
                out.append((low, 1))
        return [(at + first - 0x80, n) for at in range(0x80, 0x10000, 64) if not 0xD800 <= at < 0xE000 for first, n in out]

    def check(self) -> None:
        """Raises if fragments and whole texts give different ids on any short text over ``_KINDS``."""
        short = ["".join(t) for n in (2, 3) for t in product(_KINDS, repeat=n)]
        short += [a + b + c + d for a in ("a", "é", ".", " ") for b in _KINDS for c in _KINDS for d in ("a", "1", "s", " ")]
        whole = self.tokenizer.encode_batch_fast(short, add_special_tokens=False)
        for text, ids, mine in zip(short, whole, self.encode(short), strict=True):
            if ids.ids != mine.tolist():
                raise ValueError(f"cuts in {text!r} change its ids: the vocabulary splits texts in another way")
        self.known.clear()

    @staticmethod
    def bytes_of(vocab: dict[str, int], added: list[dict]) -> list[bytes]:
        """The bytes of each id. Byte-level vocabularies write a byte as a printable character."""
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        out = [b""] * (max([*vocab.values(), *(t["id"] for t in added)]) + 1)
        for token, i in vocab.items():
            out[i] = bytes(letter[c] for c in token)
        for t in added:
            out[t["id"]] = t["content"].encode()
        return out

    @staticmethod
    def pairs(tokens: list[bytes], special: set[int]) -> np.ndarray:
        certain = np.ones((256, 256), dtype=bool)
        for i, t in enumerate(tokens):
            if i not in special and len(t) > 1:
                b = np.frombuffer(t, dtype=np.uint8)
                certain[b[:-1], b[1:]] = False
        return certain

    def cut(self, text: str) -> list[str]:
        """Fragments of a text; a text with special tokens or odd separators stays whole."""
        low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass") if self.lower else text
        if _SEPARATORS.search(low) or any(s in low for s in self.special):
            return [text] if text else []
        return self.pattern.findall(low) if self.keep_spaces else low.split()

    def learn(self, new: list[str]) -> None:
        """Ids of new fragments, as bytes, into ``known``."""
        for at in range(0, len(new), 5000):
            part = new[at : at + 5000]
            for f, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[f] = array("I", e.ids).tobytes()

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text. Texts are taken in groups of about a million characters."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            group.append(self.cut(text))
            size += len(text)
            if size > 1 << 20:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, group: list[list[str]]) -> Iterator[np.ndarray]:
        flat = list(chain.from_iterable(group))
        found = list(map(self.known.get, flat))
        gaps = [i for i, x in enumerate(found) if x is None]
        new = list({flat[i] for i in gaps})
        self.learn(new)
        for i in gaps:
            found[i] = self.known[flat[i]]
        at = 0
        for fragments in group:
            yield np.frombuffer(b"".join(found[at : at + len(fragments)]), dtype="<u4")
            at += len(fragments)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        else:
            for f in new:
                if len(f) > LONGEST:
                    del self.known[f]

    def decode(self, ids: np.ndarray) -> str:
        return gather(self.blob, self.sizes, ids).decode("utf-8", "replace")


def gather(blob: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> bytes:
    """The strings numbered ``which``, put together; string i has sizes[i] bytes in ``blob``, in order."""
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    out = []
    for at in range(0, len(which), 1 << 18):
        part = which[at : at + (1 << 18)]
        n = sizes[part]
        ends = np.cumsum(n)
        out.append(blob[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[part] - (ends - n), n)].tobytes())
    return b"".join(out)


_HERE: dict[str, Fragments] = {}


def fragments(text: str, keep_spaces: bool) -> Fragments:
    """This worker's encoder for a vocabulary; workers outlive tasks."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _HERE:
        _HERE[key] = Fragments(text, keep_spaces)
    return _HERE[key]
