"""Token ids of whole texts, each distinct word encoded once per worker.

Texts are cut at single spaces, where the pre-tokenizers of both vocabularies cut as well, so the ids of a text are those of
its words in a row. Words are looked up in a bounded cache and encoded by the tokenizers library if new. Texts with white
space that does not split this way (three or more in a row, tabs, other Unicode spaces) are encoded as they are.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from editlore.llm.common import release

CACHE_WORDS = 700_000  # words kept by one Python worker, and with their bytes:
CACHE_BYTES = {"bytes": 60_000_000, "words": 180_000_000}  # words with their signs are many more than those of the byte-level vocabulary
SLICE_BYTES = 32_000_000  # of texts encoded in one call, after which freed memory goes back
BATCH_CHARS = 4_000_000  # characters looked up together; distinct words are found once in them
JOINED = 200  # new words encoded as one text; the library's time for a word grows with its text

#: Strings before which a text is encoded as it is: white space that splits in another way, special tokens, our own marks.
_RUNS = [a + b + c for a in " \n" for b in " \n" for c in " \n"]
_MARKS = ["<|", "\0", "\1", "\2", "\3"]
_OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"
_LETTER, _SIGN = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-;=?@\[-`{}~"  # between them both vocabularies cut; not before an apostrophe, which may be one piece with letters
_PLAIN_WORD = re.compile(f"([{_LETTER}]+)([{_SIGN}]*)")  # letters, then signs that form one piece

_encoders: dict[tuple[str, str], "Encoder"] = {}


def encoder(path: str, kind: str) -> "Encoder":
    """The worker's encoder for a vocabulary file; ``kind`` is "bytes" (spaces belong to words) or "words" (spaces are dropped)."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = {"bytes": ByteEncoder, "words": WordEncoder}[kind](path)
    return _encoders[path, kind]


def _bytes_of(words: list[str]) -> int:
    """About what the words and their ids take in a dictionary: entries and headers, characters, four bytes per four characters."""
    return 200 * len(words) + 2 * sum(map(len, words))


class Encoder:
    kind: str

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.size, self.most = 0, CACHE_BYTES[self.kind]
        self.names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text."""
        out: list[np.ndarray] = []
        start = size = 0
        for i, text in enumerate(batch):
            if size and size + len(text) > BATCH_CHARS:
                out += self._encode(batch[start:i])
                start, size = i, 0
            size += len(text)
        out += self._encode(batch[start:]) if start < len(batch) else []
        release()
        return out

    def _encode(self, batch: list[str]) -> list[np.ndarray]:
        marked = [self.marked(text) for text in batch]
        lists = self.split(pa.array([m for m in marked if m is not None], pa.large_string()))
        codes = lists.flatten().dictionary_encode()
        found = self.lookup(codes.dictionary.to_numpy(zero_copy_only=False).tolist())
        taken = pa.array(found, pa.large_binary()).take(codes.indices)
        _, offsets, data = taken.buffers()
        flat = np.frombuffer(data, "<u4") if data is not None else np.zeros(0, "<u4")
        ends = np.frombuffer(offsets, np.int64)[taken.offset:] // 4 if len(taken) else np.zeros(1, np.int64)
        bounds = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        pieces = iter(zip(bounds, bounds[1:]))
        out = []
        for text, m in zip(batch, marked):
            if m is None:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4"))
            else:
                a, b = next(pieces)
                out.append(flat[a:b])
        return out

    def lookup(self, keys: list[str]) -> list[bytes]:
        words = self.words
        missing = [key for key in keys if key not in words]
        if missing:
            more = _bytes_of(missing)
            if (self.size + more > self.most or len(words) + len(missing) > CACHE_WORDS) and words:
                # Of the old words only those asked for now stay.
                kept = [key for key in keys if key in words]
                words = self.words = {key: words[key] for key in kept}
                self.size = _bytes_of(kept)
            self.size += more
            plain, counts, other = self.sorted_out(missing)
            self.together(plain, counts)
            for key, found in zip(other, self.tokenizer.encode_batch_fast([self.text(k) for k in other], add_special_tokens=False)):
                words[key] = np.array(found.ids, "<u4").tobytes()
        return list(map(words.__getitem__, keys))

    def together(self, keys: list[str], counts: np.ndarray) -> None:
        """Encode words, ``JOINED`` of them as one text. Marked ids begin or end each of the ``counts`` pieces of a word."""
        if not keys:
            return
        texts = [self.text(k) for k in keys]
        joined = ["".join(texts[a:a + JOINED]) for a in range(0, len(texts), JOINED)]
        ids = np.concatenate([np.array(found.ids, "<u4") for found in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        bounds = self.bounds(ids)
        if len(bounds) != counts.sum() + 1:
            raise ValueError("this vocabulary does not mark words")
        raw, at = ids.tobytes(), (bounds[np.concatenate([[0], np.cumsum(counts)])] * 4).tolist()
        self.words.update(zip(keys, [raw[a:b] for a, b in zip(at, at[1:])]))


class ByteEncoder(Encoder):
    """Byte-level BPE whose words carry the space before them. Signs that end a word are looked up by themselves, marked by "\\3"."""

    kind = "bytes"

    def __init__(self, path: str):
        super().__init__(path)
        self.starts = np.array([name.startswith("Ġ") for name in self.names])

    @staticmethod
    def sorted_out(keys: list[str]) -> tuple[list[str], np.ndarray, list[str]]:
        plain = [key for key in keys if key and key[0] not in "\0\3\n"]
        return plain, np.ones(len(plain), np.int64), [key for key in keys if not key or key[0] in "\0\3\n"]

    @staticmethod
    def text(key: str) -> str:
        if key[:1] == "\0":
            return key[1:].replace("\1", " ").replace("\2", "\n")
        if key[:1] == "\3":
            return key[1:]
        return key if key[:1] == "\n" else " " + key

    def bounds(self, ids: np.ndarray) -> np.ndarray:
        return np.append(np.flatnonzero(self.starts[ids]), len(ids))

    def marked(self, text: str) -> str | None:
        """The text with "\\0" before the first word and before the white space at the end, which becomes "\\1" and "\\2"."""
        body = text.rstrip(" \n")
        if any(run in body for run in _RUNS) or any(c in text for c in _OTHER_SPACE) or any(m in text for m in _MARKS):
            return None
        end = text[len(body):]
        return f"\0{body}" + (" \0" + end.replace(" ", "\1").replace("\n", "\2") if end else "")

    @staticmethod
    def split(marked: pa.Array) -> pa.Array:
        words = pc.replace_substring(marked, "\n", " \n")
        return pc.split_pattern(pc.replace_substring_regex(words, f"([{_LETTER}])([{_SIGN}]+)( |$)", r"\1 " + "\3" + r"\2\3"), " ")


class WordEncoder(Encoder):
    """Lower-casing BPE with marked word ends; white space is dropped.

    Words are looked up without the signs after them, and in lower case where the text is Latin-1: there the case of a letter decides on no
    composed character.
    """

    kind = "words"

    def __init__(self, path: str):
        super().__init__(path)
        self.ends = np.array([name.endswith("</w>") for name in self.names])

    @staticmethod
    def sorted_out(keys: list[str]) -> tuple[list[str], np.ndarray, list[str]]:
        found = [_PLAIN_WORD.fullmatch(key) for key in keys]
        counts = np.array([1 + (m.end(1) < m.end()) for m in found if m], np.int64)
        return [m[0] for m in found if m], counts, [key for key, m in zip(keys, found) if not m]

    @staticmethod
    def text(key: str) -> str:
        return key + " "

    def bounds(self, ids: np.ndarray) -> np.ndarray:
        return np.insert(np.flatnonzero(self.ends[ids]) + 1, 0, 0)

    @staticmethod
    def marked(text: str) -> str | None:
        if "<|" in text or not text.isascii() and any(c in text for c in _OTHER_SPACE[8:]):
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return text.lower()

    @staticmethod
    def split(marked: pa.Array) -> pa.Array:
        return pc.ascii_split_whitespace(pc.replace_substring_regex(marked, f"([{_LETTER}])([{_SIGN}])", r"\1 \2"))
