"""Token ids of a public tokenizer file, as the file's own library gives them."""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
from pyspark.sql import SparkSession

#: The splitting pattern of byte-level BPE files that set use_regex.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level BPE files use for each byte, reversed."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """``ids(texts)`` gives a uint32 array for each text.

    A plain byte-level BPE .json is run by tiktoken on the ranks of that same
    file, which gives equal ids about four times as fast; texts that hold an
    added token's string, or that tiktoken refuses, go to tokenizers.
    """

    def __init__(self, name: str, raw: bytes):
        self.version = hashlib.sha256(name.encode() + b"\0" + raw).hexdigest()
        self.quick, self.added, self.pieces = None, [], None
        if name.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_proto=raw)
            return
        self.raw = raw
        spec = json.loads(raw)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        if self._plain(spec):
            import tiktoken

            letters = _byte_letters()
            ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
            self.quick = tiktoken.Encoding("own", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def full(self):
        """The library's own tokenizer, made where the quick one doesn't do."""
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(self.raw.decode())
        t.no_truncation()
        t.no_padding()
        return t

    @staticmethod
    def _plain(spec: dict) -> bool:
        """Whether merge order is id order and nothing but byte-level splitting happens before it."""
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space"):
            return False
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            return False
        vocab = model["vocab"]
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        return all(a < b for a, b in zip(made, made[1:], strict=False))

    def _slow(self, text: str) -> np.ndarray:
        return np.asarray(self.full.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if self.pieces:
            return [np.asarray(x, dtype=np.uint32) for x in self.pieces.encode(texts, num_threads=1)]
        if not self.quick:
            return [np.asarray(x.ids, dtype=np.uint32) for x in self.full.encode_batch(texts, add_special_tokens=False)]
        out = []
        for t in texts:
            if any(a in t for a in self.added):
                out.append(self._slow(t))
                continue
            try:
                out.append(np.asarray(self.quick.encode_ordinary(t), dtype=np.uint32))
            except (KeyboardInterrupt, SystemExit, MemoryError):
                raise
            except BaseException:  # the pattern engine gives up on very long runs
                out.append(self._slow(t))
        return out

    def normal(self, text: str) -> str:
        """The text after the tokenizer's own normaliser: equal results have equal ids."""
        if self.pieces or self.quick or self.full.normalizer is None:
            return text
        return self.full.normalizer.normalize_str(text)


_known: dict[str, Encoder] = {}


class Source:
    """A tokenizer file's bytes, read by the driver and broadcast: executors need no path of the driver's."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.name = path.rsplit("/", 1)[-1]
        self.digest = hashlib.sha256(self.name.encode() + b"\0" + raw).hexdigest()
        self.raw = spark.sparkContext.broadcast(raw)

    def encoder(self) -> Encoder:
        if self.digest not in _known:
            if len(_known) > 3:
                _known.clear()
            _known[self.digest] = Encoder(self.name, self.raw.value)
        return _known[self.digest]


def encoder(path: str) -> Encoder:
    with open(path, "rb") as f:
        return Encoder(path.rsplit("/", 1)[-1], f.read())


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
