"""Token ids and counts through a cache of words that a worker process keeps.

A byte-pair tokenizer works within the pieces that its pre-tokenizer cuts, and
the two kinds of pre-tokenizer known here never join what a space parts. A text
is therefore cut at spaces in C, and only words that the process has not met are
encoded. Texts for which that does not hold (runs of white space, special
tokens, U+0000) are encoded whole by the library.

New words are encoded many at a time. Where the vocabulary lists byte pairs in
the order of their merges, which is checked on loading, a faster library for such
vocabularies does it, built from the same file; ids are the same.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Words that a process keeps; with more only those stay that the texts at hand have too, so memory is bounded and common words stay.
CACHE_WORDS = 600_000
#: The same for words of which only the number of tokens is kept.
CACHE_COUNTS = 600_000
#: Longer words are not kept.
CACHE_CHARS = 64

#: New words that are encoded as one text.
JOINED = 2000

# Fixed value: how the byte-level pre-tokenizer cuts a text.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: U+0000 marks the first word of a text, so texts that hold it go whole as well.
_WHITE_RUN = re.compile(r"\s\s|<\||\x00")
_loaded: dict[str, "Encoder"] = {}


class Encoder:
    """The tokenizer of one .json file, with ids as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        before, normal = made.get("pre_tokenizer") or {}, json.dumps(made.get("normalizer"))
        plain = made["model"]["type"] == "BPE" and all("|" in x["content"] and x["content"].startswith("<|") for x in made["added_tokens"])
        #: a leading space belongs to the word
        self.spaced = plain and made.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        #: white space parts words and is dropped
        self.parted = plain and '"\\\\s+"' in normal and before.get("type") == "Sequence" and before["pretokenizers"][0].get("behavior") == "Removed"
        self._pairs = _byte_pairs(made["model"]) if self.spaced else None
        #: words whose ids are kept
        self.most = CACHE_WORDS
        self._ids: dict[str, bytes] = {}
        self._counts: dict[str, int] = {}

    def _whole(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []

    @staticmethod
    def _bytes(encoding) -> bytes:
        return np.array(encoding.ids, "<u4").tobytes()

    def _unknown(self, known: dict, words: set[str], most: int) -> list[str]:
        if len(known) > most:
            kept = {w: known[w] for w in words if w in known}
            known.clear()
            known.update(kept)
        return list(words.difference(known))

    def _forget(self, known: dict, words: list[str]) -> None:
        for w in words:
            if len(w) > CACHE_CHARS:
                del known[w]

    def _learn(self, words: list[str]) -> None:
        """Add words, each with its lead: none after ``\\0``, a newline, else a space."""
        plain: dict[str, list[str]] = {" ": [], "\n": []}
        rest = []
        for w in words:
            lead = w[:1]
            bare = w[1:] if lead in ("\0", "\n") else w
            if self._pairs and bare.split() == [bare]:
                plain["\n" if lead in ("\0", "\n") else " "].append(w)
            else:
                rest.append(w)
        self._ids.update(zip(rest, map(self._bytes, self._whole([w[1:] if w[:1] == "\0" else w if w[:1] == "\n" else " " + w for w in rest]))))
        for lead, own in plain.items():
            for at in range(0, len(own), JOINED):
                self._ids.update(self._joined(own[at : at + JOINED], lead))

    def _joined(self, words: list[str], lead: str) -> dict[str, bytes]:
        """Words as one text, each after its lead; its ids are cut where the bytes of a word end."""
        bare = [w[1:] for w in words] if lead == "\n" else words
        ids = np.array(self._pairs[0].encode_ordinary(lead + lead.join(bare)), "<u4")
        ends = np.cumsum([len(w.encode()) + 1 for w in bare])
        to = (4 * (np.searchsorted(np.cumsum(self._pairs[1][ids]), ends) + 1)).tolist()
        raw, out, at = ids.tobytes(), {}, 0
        for w, end in zip(words, to):
            out[w] = raw[at + 4 if w[:1] == "\0" else at : end]  # a text's first word has no newline before it
            at = end
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without special tokens added."""
        if not self.spaced:
            return [self._bytes(x) for x in self._whole(texts)]
        # a word comes with the space or newline before it, the first one with neither
        parts = [None if _WHITE_RUN.search(t) else t.replace("\n", " \n").split(" ") for t in texts]
        for p in parts:
            if p:
                p[0] = "\0" + p[0]
        fresh = self._unknown(self._ids, set().union(*(p for p in parts if p)), self.most)
        self._learn(fresh)
        look = self._ids.__getitem__
        out = [b"".join(map(look, p)) if p else self._bytes(self._whole([t])[0]) for t, p in zip(texts, parts)]
        self._forget(self._ids, fresh)
        return out

    def count(self, texts: list[str]) -> list[int]:
        """How many tokens each text gives, without special tokens added."""
        if not self.parted:
            return [len(x) // 4 for x in self.encode(texts)]
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        fresh = self._unknown(self._counts, set().union(*parts), CACHE_COUNTS)
        self._counts.update(zip(fresh, map(len, self._whole(fresh))))
        look = self._counts.__getitem__
        out = [sum(map(look, p)) for p in parts]
        self._forget(self._counts, fresh)
        return out


def _byte_pairs(model: dict):
    """(encoding, bytes of each id) if ids follow the order of merges, else None."""
    try:
        import tiktoken
    except ImportError:
        return None
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    vocab = model["vocab"]
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    # printable bytes stand for themselves, the others for characters from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
    ranks = {bytes(byte[c] for c in word): i for word, i in vocab.items() if i < 256 + len(merges)}
    if sorted(len(w) for w in ranks)[:257] != [1] * 256 + [2] or len(ranks) != 256 + len(merges):
        return None
    size = np.ones(max(vocab.values()) + 1, np.int64)
    for word, i in ranks.items():
        size[i] = len(word)
    return tiktoken.Encoding("byte-pairs", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}), size


def largest_id(path: str) -> int:
    """The largest id of a tokenizer's file, added tokens included."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    vocab = made["model"]["vocab"]
    ids = vocab.values() if isinstance(vocab, dict) else range(len(vocab))
    return max([*ids, *(x["id"] for x in made.get("added_tokens") or ())], default=0)


def encoder(path: str, words: int = CACHE_WORDS) -> Encoder:
    """The process's encoder of a file, which keeps the ids of ``words`` words from now on."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    _loaded[path].most = words
    return _loaded[path]
