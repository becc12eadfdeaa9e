"""Token ids of whole texts by a public tokenizer, with a bounded memory of chunks already seen.

For tokenizers whose normaliser and splitter never join text across white space, a text's ids are those of its
white-space-separated chunks in order, so each distinct chunk is encoded once while it is remembered.
"""

from __future__ import annotations

import base64
import json
import os
import string
import unicodedata
from array import array
from itertools import pairwise

import numpy as np
import pyarrow as pa

#: Marks that end a chunk apart: after a letter the splitter starts a new piece at them.
_MARKS = ".,!?;:#$%&*|"
#: Texts with any of these are not lower-cased before they are encoded: a special token's text has capitals or not, and a
#: capital may compose with marks of U+0300 to U+037F otherwise than the small letter does.
_CASED = b"<|", b"\xcc", b"\xcd"
#: Kinds of bytes.
_SPACE, _LETTER, _MARK, _OTHER = range(4)
#: Chunks that one worker remembers, about 200 bytes each.
REMEMBERED = 1_500_000


class ChunkEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, for lower-casing tokenizers."""

    _made: dict[str, ChunkEncoder] = {}

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ids: dict[bytes, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        #: Whether an id ends a word; empty where the vocabulary does not say.
        self.ends = np.zeros(max(vocab.values()) + 1 if suffix else 0, bool)
        #: The same model for lower-case words that are composed already: without normaliser and pattern.
        light = json.loads(self.tokenizer.to_str())
        light |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
        self.light = Tokenizer.from_str(json.dumps(light))
        #: The kind of each byte. A mark in a special token's text does not end a chunk, as it would cut the token.
        special = b"".join(x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values())
        self.kinds = np.full(256, _OTHER, np.uint8)
        self.kinds[list(b" \t\n\v\f\r")] = _SPACE
        self.kinds[list(string.ascii_letters.encode())] = _LETTER
        self.kinds[[x for x in _MARKS.encode() if x not in special]] = _MARK
        if suffix:
            self.ends[[i for x, i in vocab.items() if x.endswith(suffix)]] = True

    @classmethod
    def at(cls, path: str, remembered: int = REMEMBERED) -> ChunkEncoder:
        """The worker's encoder for a tokenizer, with room for that many chunks from now on."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        cls._made[path].remembered = remembered
        return cls._made[path]

    def _learn_words(self, words: list[bytes]) -> list[bytes]:
        """Learn words of letters only, many in one call, told apart by the ids that end a word; return what is left."""
        left = []
        for start in range(0, len(words), 1000) if len(self.ends) else ():
            part = words[start : start + 1000]
            text = b" ".join(part).decode()
            plain = text == text.lower() and unicodedata.is_normalized("NFC", text)
            ids = np.array((self.light if plain else self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) != len(part):
                left += part
                continue
            ids, at = ids.tobytes(), ends.tolist()
            self.ids.update(zip(part, [ids[a:b] for a, b in zip([0, *at[:-1]], at, strict=True)], strict=True))
        return left if len(self.ends) else words

    def _learn(self, chunks: list[bytes]) -> None:
        for start in range(0, len(chunks), 10_000):
            part = chunks[start : start + 10_000]
            encoded = self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in part], add_special_tokens=False)
            self.ids.update((x, array("I", e.ids).tobytes()) for x, e in zip(part, encoded, strict=True))

    def _learn_all(self, new: list[bytes]) -> None:
        """Learn chunks, of which none is known."""
        words, ended = {x for x in new if x.isalpha()}, []
        left = [x for x in new if x not in words]
        rest = []
        for x, text in zip(left, b" ".join(left).decode("utf-8", "replace").split(" ") if left else (), strict=True):
            word = text.rstrip(_MARKS)
            # Lower case can end in a mark that joins what follows (U+0130): such words are read whole.
            if not word.isalpha() or not (word.isascii() or word.lower().isalpha()):
                rest.append(x)
            elif (k := len(word) - len(text)) < 0:
                ended.append((x, x[:k], x[k:]))
                words.add(x[:k])
            else:
                words.add(x)
        rest += {x[2] for x in ended}.difference(self.ids)
        self._learn(rest + self._learn_words(list(words.difference(self.ids))))
        known = self.ids
        known.update([(x, known[word] + known[mark]) for x, word, mark in ended])

    def _chunks(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """All chunks of the texts in order, and for each text the number of chunks up to its end."""
        data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        kinds = self.kinds[data]
        # A chunk begins after white space, and at a mark after a letter.
        begins = kinds != _SPACE
        begins[1:] &= (kinds[:-1] == _SPACE) | ((kinds[:-1] == _LETTER) & (kinds[1:] == _MARK))
        solid = kinds != _SPACE
        chars = data[solid]
        starts = np.append(np.flatnonzero(begins[solid]), len(chars))
        ends = np.searchsorted(np.flatnonzero(begins), np.cumsum([len(x) + 1 for x in texts], dtype=np.int64))
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(chars)]), ends

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not texts:
            return []
        chunks, ends = self._chunks([x if any(b in x for b in _CASED) else x.lower() for x in texts])
        coded = chunks.dictionary_encode()
        del chunks
        seen = coded.dictionary.to_pylist()
        if len(self.ids) > self.remembered:
            # What these texts have again is likely to come again.
            self.ids = {x: self.ids[x] for x in seen if x in self.ids}
        found = list(map(self.ids.get, seen))
        new = [i for i, ids in enumerate(found) if ids is None]
        if new:
            self._learn_all([seen[i] for i in new])
            for i in new:
                found[i] = self.ids[seen[i]]
        joined = pa.array(found, pa.large_binary()).take(coded.indices)
        _, starts, ids = joined.buffers()
        at = [0, *np.frombuffer(starts, np.int64)[ends].tolist()]
        return [bytes(ids[a:b]) for a, b in pairwise(at)]


class ByteEncoder:
    """Counts the ids of whole texts by a byte vocabulary's ranks; strings of special tokens are ordinary text."""

    _made: dict[tuple[str, str], ByteEncoder] = {}

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def at(cls, path: str, pattern: str) -> ByteEncoder:
        """The worker's encoder of a vocabulary."""
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def count(self, text: bytes) -> int:
        """Ids of a text."""
        return len(self.encoding.encode_ordinary(text.decode("utf-8", "replace")))


def ids_of(encoded: bytes) -> np.ndarray:
    return np.frombuffer(encoded, "<u4")
