"""Tokenizer files applied inside tasks, with the ids of recurring words remembered per worker.

Both vocabularies split a text before their merges, and no merge crosses such a split, so ids of
parts between two safe places are exactly the text's ids there:

* a word vocabulary drops white space: every run of ASCII white space is a safe place;
* a byte vocabulary keeps it: the place before white space that follows a non-space is safe.

Both rest on how the file's normaliser and splits work, so a file with others is refused.

White space here is Unicode's White_Space, as in the tokenizers' patterns (Python's ``\\s`` also
takes U+001C to U+001F, which the patterns take as symbols).
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE, _OTHER = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
SEGMENT = re.compile(f"{_SPACE}*{_OTHER}+|{_SPACE}+")

MEMO_PARTS = 500_000   # parts remembered by one worker; the older half goes when it is full
LONG_PART = 200        # characters above which a part is not remembered

# Parts that the vocabulary's patterns split into one word and one run of marks, whatever is around
# them; their letters are in Latin-1, which NFC leaves alone and which lower-case one by one.
_PLAIN = re.compile(r"( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:*$%&#]*)\Z")



def _four(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    made = array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


def _runs(values: pa.Array, bounds: np.ndarray) -> list[bytes]:
    """The bytes of an array of octets, joined from bound to bound."""
    offsets = np.frombuffer(values.buffers()[1], dtype="<i8")[bounds].tolist()
    data = memoryview(values.buffers()[2] or b"")
    return [bytes(data[lo:hi]) for lo, hi in zip(offsets, offsets[1:])]


# The place between such a letter and such a mark is a split in the word vocabulary's patterns, whatever is around it.
_LETTER_MARK = r"([A-Za-zÀ-ÖØ-öø-ÿ])([.,!?;:*$%&#])"

# Normaliser and splits of the word vocabulary and of the byte vocabulary.
_WORD_FORM = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]})
_BYTE_FORM = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})

_LOADED: dict[str, "Vocabulary"] = {}


class _Parts(dict):
    """Ids by part; a part that is looked up for the first time is encoded.  The older half goes when it is full."""

    def __init__(self, vocab: "Vocabulary", most: int):
        self.vocab, self.most, self.older = vocab, most, {}

    def __missing__(self, part):
        ids = self.older.get(part)
        if ids is None:
            ids = self.vocab.encode_part(part.decode() if isinstance(part, bytes) else part)
            if len(part) > LONG_PART:
                return ids
        if len(self) >= self.most // 2:
            self.older = dict(self)
            self.clear()
        self[part] = ids
        return ids


class Vocabulary:
    def __init__(self, path: str, memo_parts: int = MEMO_PARTS):
        self.memo_parts = memo_parts
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        form = tuple(part and json.loads(part.__getstate__()) for part in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer))
        if form not in (_WORD_FORM, _BYTE_FORM):
            raise ValueError(f"{path}: texts cannot be taken apart under this normaliser and these splits: {form}")
        self.lowers = form == _WORD_FORM  # it drops white space too
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self._letters = {b: chr(b) for b in letters}
        self._letters |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in self._letters)}
        self.memo = _Parts(self, memo_parts)
        self._words: dict[str, bytes] = {}
        self._octets = None

    def _word(self, word: str) -> bytes:
        """The ids of one piece between splits, by the model alone."""
        ids = self._words.get(word)
        if ids is None:
            if len(self._words) >= self.memo_parts // 2:
                self._words.clear()
            letters = word if word.isascii() and word[0] != " " else "".join(map(self._letters.__getitem__, word.encode()))
            ids = self._words[word] = _four([t.id for t in self.model.tokenize(letters)])
        return ids

    def _plain(self, part: str) -> bytes | None:
        if part.isascii() and part.isalpha():
            return self._word(part.lower() if self.lowers else part)
        found = _PLAIN.match(part)
        if not found:
            return None
        space, word, marks = found.groups()
        if self.lowers:
            space, word = "", word.lower()
        return self._word(space + word) + (self._word(marks) if marks else b"")

    def encode_part(self, text: str) -> bytes:
        """The ids of one part between safe places."""
        ids = self._plain(text)
        if ids is None:
            ids = _four(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return ids

    def join(self, many: list[list]) -> list[bytes]:
        """The ids (little-endian, 4 bytes each) of texts given as lists of parts."""
        return [b"".join(map(self.memo.__getitem__, one)) for one in many]

    def octets(self) -> pa.Array:
        """The bytes of each id of a byte vocabulary."""
        if self._octets is None:
            back = {c: b for b, c in self._letters.items()}
            count = self.tokenizer.get_vocab_size(with_added_tokens=True)
            tokens = [self.tokenizer.id_to_token(i) or "" for i in range(count)]
            self._octets = pa.array([bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in tokens],
                                    type=pa.large_binary())
        return self._octets

    def decode(self, many: list[bytes]) -> list[str]:
        """The texts of ids of a byte vocabulary, special tokens included."""
        bounds = np.cumsum([0, *(len(ids) // 4 for ids in many)])
        found = self.octets().take(pa.array(np.frombuffer(b"".join(many), dtype="<u4")))
        return [b.decode("utf-8", "replace") for b in _runs(found, bounds)]


def vocabulary(path: str, memo_parts: int = MEMO_PARTS) -> Vocabulary:
    """The vocabulary of a file, once per worker; its first user states how much it remembers."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path, memo_parts)
    return _LOADED[path]


def word_ids(vocab: Vocabulary, texts: pa.Array) -> list[bytes]:
    """Ids of whole texts under a vocabulary that drops white space.  A part is looked up once for all of them."""
    apart = pc.replace_substring_regex(texts, pattern=_LETTER_MARK, replacement=r"\1 \2")
    parts = pc.ascii_split_whitespace(apart)  # a text that begins or ends with white space has empty parts there
    known = parts.flatten().dictionary_encode()
    ids = pa.array([vocab.memo[p] if p else b"" for p in known.dictionary.to_numpy(zero_copy_only=False).tolist()], type=pa.large_binary())
    return _runs(ids.take(known.indices), parts.offsets.to_numpy())


def byte_ids(vocab: Vocabulary, texts: list[str]) -> list[bytes]:
    """Ids of whole texts under a vocabulary of bytes."""
    return vocab.join([SEGMENT.findall(t) for t in texts])
