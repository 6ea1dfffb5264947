"""Encoding with tokenizer files of the ``tokenizers`` library, one word of text at a time.

Both kinds of tokenizer used here never merge ids across certain places of a text, so a text's ids are the ids of
its units joined, and a worker encodes each distinct unit once:

* ``"word"``: tokenizers that drop white space; a unit is what stands between spaces.
* ``"space"``: byte-level tokenizers that put one space before a word; a unit is a space and its word.
* ``"text"``: any other tokenizer; the whole text is the unit.

A unit of letters alone is one piece for the tokenizer's model, which is then asked directly; all other units go
through the tokenizer.  Texts where the cut could change ids (``WHOLE``) are encoded whole.  A file whose rules for
cutting and changing text aren't those that a unit assumes (``RULES``) is used with ``"text"``.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

LINES = re.compile(r"\S+(?:\n\S+)+")
# White space of any kind, for regular expressions of Arrow.
SPACE = r"[\s\x0b\x1c-\x1f\p{Z}\x{85}]"
#: Texts that are encoded whole: white space on both sides of a space belongs to one run, which must not be cut; some
#: controls are white space to one library only; and special tokens hold "<|".
WHOLE = {"word": r"[\x1c-\x1f]|<\|", "space": rf"{SPACE} {SPACE}|<\|"}

# How files that "word" and "space" are right for change a text and cut it.
RULES = {
    "word": (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    ),
    "space": (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}),
}
#: Letters below are such to every library's Unicode tables, old or new.
OLD = "\u0530"
#: Characters below are composed already, and each has its lower case by itself; but capital I with dot becomes two.
LATIN, DOTTED = "\u0250", "\u0130"
#: Pieces of a lower-case ASCII word, as a "word" file cuts it.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: itself if it prints, else one from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


def ends_in_letter(word: str) -> bool:
    """Whether a word, composed and lower-cased, surely ends in a letter: a capital I with dot leaves a combining mark."""
    return word[-1] < OLD and unicodedata.normalize("NFC", word[-1]).lower()[-1].isalpha()


class UnitEncoder(dict):
    """Maps a word to its unit's ids (little-endian unsigned 32-bit).

    ``limit`` words are held at most; then those that came up since the last such moment stay and the rest go.
    Texts are encoded in steps of about as many bytes as those words take.
    """

    def __init__(self, content: bytes, unit: str = "text", limit: int = 700_000):
        from tokenizers import Tokenizer

        super().__init__()
        if unit not in ("word", "space", "text"):
            raise ValueError(f"unknown unit {unit!r}")
        self.tokenizer, self.limit, self.step_bytes = Tokenizer.from_buffer(content), limit, 12 * limit
        # The parts alone: the whole file's text has its vocabulary.
        rules = tuple(part and json.loads(part.__getstate__()) for part in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer))
        self.unit = unit if unit == "text" or rules == RULES[unit] and type(self.tokenizer.model).__name__ == "BPE" else "text"
        self.model, self.lead, self.letters, self.older = self.tokenizer.model, " " * (self.unit == "space"), byte_letters(), {}
        self.letter_lead = self.lead.translate(self.letters)
        self.marks, self.line_end, self.starts = {x: self.whole(x) for x in ".,"}, self.whole("\n"), {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def unit_ids(self, word: str) -> bytes:
        # A "word" file composes and lower-cases, which leaves lower-case Latin as it is; a "space" file changes nothing.
        if word.isalpha() and (max(word) < OLD if self.lead else max(word) < LATIN and word == word.lower()):
            return self.piece_ids(word.encode().decode("latin-1").translate(self.letters))
        return self.whole(self.lead + word)

    def piece_ids(self, letters: str) -> bytes:
        """Ids of a word of letters alone, in the letters that byte-level tokenizers write for its bytes (for ASCII, itself)."""
        return array("I", [x.id for x in self.model.tokenize(self.letter_lead + letters)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(word) > 64:
            return self.whole(self.lead + word)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            if word.isascii() and word.isalpha():
                ids = self.piece_ids(word) if self.lead or word.islower() else self[word.lower()]
            elif not self.lead and (parts := word.split()) != [word]:
                ids = b"".join(map(self.__getitem__, parts))
            elif self.lead and LINES.fullmatch(word):
                parts = word.split("\n")
                ids = self[parts[0]] + b"".join(self.line_end + self.first_ids(x) for x in parts[1:])
            elif not self.lead and (low := word.lower()) != word and max(word) < LATIN and DOTTED not in word:
                ids = self[low]
            elif len(word) > 1 and word[-1] in ".," and word[-2].isalpha() and ends_in_letter(word[:-1]):
                ids = self[word[:-1]] + self.marks[word[-1]]
            elif not self.lead and word.isascii() and len(parts := PIECES.findall(word)) > 1:
                ids = b"".join(map(self.__getitem__, parts))
            else:
                ids = self.unit_ids(word)
        self[word] = ids
        return ids

    def first_ids(self, word: str) -> bytes:
        """Ids of a word that no space stands before; kept for words that begin a line."""
        ids = self.starts.get(word)
        if ids is None:
            if len(self.starts) >= self.limit // 4:
                self.starts.clear()
            ids = self.starts[word] = self.whole(word)
        return ids

    def encode(self, texts: pa.StringArray) -> list[np.ndarray]:
        """Ids of each text; nulls aren't allowed.

        Texts are split at spaces and words numbered by Arrow, so that only a batch's distinct words are looked up.
        """
        out: list[np.ndarray] = []
        sizes = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            base = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, base + self.step_bytes)))
            out += self._step(texts.slice(at, to - at))
            at = to
        return out

    def _step(self, texts: pa.StringArray) -> list[np.ndarray]:
        if self.unit == "text":
            return [np.frombuffer(self.whole(t), "<u4") for t in texts.to_pylist()]
        odd = pc.match_substring_regex(texts, WHOLE[self.unit]).to_numpy(zero_copy_only=False)
        # Where white space is dropped, line ends separate words as spaces do.
        cut = pc.split_pattern(texts if self.lead else pc.replace_substring(texts, "\n", " "), " ")
        numbered = cut.flatten().dictionary_encode()
        first = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        codes, words = numbered.indices.to_numpy(), numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        pieces = [self[w] for w in words]
        if self.lead:
            begin, codes = first[:-1], codes.astype(np.int64)
            pieces += [self.whole(words[c]) for c in codes[begin].tolist()]
            codes[begin] = len(words) + np.arange(len(begin))
        # Arrow copies the words' ids behind each other; the places are 64 bits, as four bytes an id can pass two gigabytes.
        joined = pa.array(pieces, pa.large_binary()).take(pa.array(codes))
        _, places, content = joined.buffers()
        bounds = np.frombuffer(places, np.int64, len(codes) + 1)[first] // 4
        ids = np.frombuffer(content or b"", "<u4", bounds[-1])
        out = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        for i in np.flatnonzero(odd).tolist():
            out[i] = np.frombuffer(self.whole(texts[i].as_py()), "<u4")
        return out


class TokenizerFile:
    """A tokenizer file that the driver reads and tasks get by broadcast; its size (a few MB) is the file's."""

    def __init__(self, spark: SparkSession, path: str):
        content = Path(path).read_bytes()
        self.key, self.shared = hashlib.sha256(content).hexdigest(), spark.sparkContext.broadcast(content)

    def encoder(self, unit: str, words: int = 700_000, keep: bool = True) -> UnitEncoder:
        """In a task: the encoder of this worker, kept from task to task, or a fresh one."""
        key = (self.key, unit, words)
        if not keep:
            return UnitEncoder(self.shared.value, unit, words)
        if key not in _LOADED:
            _LOADED[key] = UnitEncoder(self.shared.value, unit, words)
        return _LOADED[key]


_LOADED: dict[tuple[str, str, int], UnitEncoder] = {}
