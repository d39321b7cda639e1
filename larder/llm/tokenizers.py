"""Public tokenizer files on the executors: loading, versions, and word-wise encoding.

A tokenizer file is read once on the driver and travels as a broadcast of its bytes (a vocabulary file: a few megabytes,
whatever the corpus), so executors need no file of their own. Three kinds are known by their suffix: ``.json``
(tokenizers), ``.model`` (sentencepiece) and ``.tiktoken`` (rank files).
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import os
import unicodedata
from dataclasses import dataclass

#: Fixed value: the split pattern of word vocabularies. None of its alternatives can match white space, and what it does
#: not match is removed, so the tokens of a text are the tokens of its blank-separated words, one after the other.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Remembered words per Python worker; beyond that the memory is emptied and filled anew.
MEMORY_WORDS = 250_000
#: Longer words (lines of a script without blanks, encoded data) are encoded whenever they occur and not remembered.
MEMORY_WORD_CHARS = 64


@functools.cache
def stays_a_letter(c: str) -> bool:
    """True for a letter that is one letter after composition and lower-casing, in every version of the Unicode tables.

    Others may end in a mark (I with a dot above becomes i and a mark), which the split pattern joins with a stop behind it.
    """
    return c < "\u0530" and c.isalpha() and unicodedata.normalize("NFC", c) == c and len(c.lower()) == 1 and c.lower().isalpha()


@dataclass(frozen=True)
class TokenizerFile:
    """The bytes of a tokenizer file, its kind and the digest that names its version."""

    kind: str
    data: bytes
    digest: str

    @classmethod
    def read(cls, path: str) -> TokenizerFile:
        with open(path, "rb") as f:
            data = f.read()
        kind = path.rsplit(".", 1)[-1]
        if kind not in ("json", "model", "tiktoken"):
            raise ValueError(f"unknown kind of tokenizer file: {path}")
        return cls(kind, data, hashlib.sha256(data).hexdigest())

    def spec(self) -> dict:
        return json.loads(self.data) if self.kind == "json" else {}

    def splits_words(self) -> bool:
        """True if blank-separated words are encoded independently of each other."""
        parts = (self.spec().get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        first = parts[0]
        return (
            first.get("type") == "Split"
            and first.get("behavior") == "Removed"
            and first.get("invert") is True
            and first.get("pattern") == {"Regex": WORD_PATTERN}
        )

    def folds(self) -> tuple[bool, bool]:
        """Whether the normaliser makes (ASCII case, runs of white space) irrelevant."""
        steps = (self.spec().get("normalizer") or {}).get("normalizers") or []
        lower = any(s.get("type") == "Lowercase" for s in steps)
        space = any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": r"\s+"} and s.get("content") == " " for s in steps)
        return lower and self.splits_words(), space and self.splits_words()

    def special_tokens(self) -> list[str]:
        return [t["content"] for t in self.spec().get("added_tokens") or []]

    def load(self):
        """The library's own tokenizer: a function from texts to lists of ids, without added special tokens."""
        if self.kind == "json":
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
            from tokenizers import Tokenizer

            t = Tokenizer.from_str(self.data.decode("utf-8"))
            t.no_truncation()
            t.no_padding()
            return lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        if self.kind == "model":
            import sentencepiece

            p = sentencepiece.SentencePieceProcessor(model_proto=self.data)
            return lambda texts: p.encode(texts, num_threads=1)
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in self.data.splitlines() if x)}
        e = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return e.encode_ordinary_batch if hasattr(e, "encode_ordinary_batch") else lambda texts: [e.encode_ordinary(t) for t in texts]


class WordMemory:
    """Encodes texts word by word and remembers what ``value`` makes of the ids of each word.

    Only for files with ``splits_words()``. Words are cut at blanks and line feeds, both of which such a tokenizer drops;
    other white space inside a word is left to the library. ``value`` must turn concatenation of ids into ``+``. The memory
    has two generations: when the young one is full it becomes the old one, and words met again move back.
    """

    def __init__(self, file: TokenizerFile, value, limit: int = MEMORY_WORDS):
        self.encode, self.value, self.limit = file.load(), value, limit
        self.folds_case, self.special = file.folds()[0], [t[:2] for t in file.special_tokens()]
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def __call__(self, text: str) -> list:
        if self.folds_case and not any(t in text for t in self.special):
            text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # ASCII letters only
        words = text.replace("\n", " ").split(" ")
        young = self.young
        new = [w for w in dict.fromkeys(words) if w not in young]
        if new:
            if len(young) + len(new) > self.limit:
                self.old, self.young = young, {}
                young, new = self.young, list(dict.fromkeys(words))
            self._learn(new)
        out = [young[w] for w in words]
        for w in new:
            if len(w) > MEMORY_WORD_CHARS:
                young.pop(w, None)
                young.pop(w[:-1], None)
        return out

    def _learn(self, new: list[str]) -> None:
        young, old = self.young, self.old
        ended, unknown = [], {}
        for w in new:
            if w in old:
                young[w] = old[w]
            elif len(w) > 1 and w[-1] in ".," and stays_a_letter(w[-2]):  # a letter and a stop are never one token
                ended.append(w)
                for part in (w[:-1], w[-1]):
                    if part not in young:
                        unknown[part] = None
            else:
                unknown[w] = None
        fresh = []
        for w in unknown:
            if w in old:
                young[w] = old[w]
            else:
                fresh.append(w)
        for i in range(0, len(fresh), 4096):
            part = fresh[i : i + 4096]
            young.update(zip(part, map(self.value, self.encode(part)), strict=True))
        for w in ended:
            young[w] = young[w[:-1]] + young[w[-1]]


#: One memory per worker process, tokenizer version and purpose; Spark reuses its workers between tasks.
_MEMORIES: dict[tuple[str, str], WordMemory] = {}


def word_memory(file: TokenizerFile, purpose: str, value, limit: int = MEMORY_WORDS) -> WordMemory:
    key = (file.digest, purpose)
    if key not in _MEMORIES:
        _MEMORIES[key] = WordMemory(file, value, limit)
    return _MEMORIES[key]
