"""Token ids of whole texts through the ``tokenizers`` library, each distinct word once a batch.

The library spends most of its time on words that it has met before and on one result
object per text.  Both vocabularies used here cut a text at white space before any merge, so the
ids of a text are the ids of its words, one after the other.  ``WordEncoder`` splits the
texts of a batch with Arrow, hands each distinct word to the library once, many words a
call, and puts the ids together with numpy.  Texts with uneven or rare white space go to the
library whole, and so do texts that hold one of its added tokens (it cuts there before it looks at
white space) and words with digits, inner punctuation or letters beyond Latin-1.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

# White space on which the splits here and the library's patterns might differ.
_RARE = "\\x1c-\\x1f" + "".join(f"\\x{{{c:x}}}" for c in (
    0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF))
#: Texts that go to the library whole, by mode.
_WHOLE = {"word": f"[{_RARE}]", "byte": f"  | \\n|\\n |^ | $|\\n\\n(\\n|$)|[\\x00\\t\\r\\x0b\\x0c{_RARE}]"}
# Letters whose lower-casing and normal form are plain, and ends of words that form one piece of their own.
_LETTERS = "^\\n?[A-Za-z\\x{aa}\\x{b5}\\x{ba}\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{ff}]+$"
_TAIL = ".,!?;:%$&*#"
BATCH_BYTES = 8 << 20
_WORDS_A_CALL = 2000


def _byte_letters() -> dict[int, str]:
    """Byte -> the printable character that stands for it in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Ragged:
    """Lists of ids, one after the other in ``flat``; list i has ``size[i]`` of them."""

    def __init__(self, flat: np.ndarray, size: np.ndarray):
        self.flat, self.size = flat, size

    @classmethod
    def of(cls, lists: list[list[int]]) -> Ragged:
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        return cls(np.fromiter((x for ids in lists for x in ids), np.uint32, int(size.sum())), size)

    def __add__(self, other: Ragged) -> Ragged:
        return Ragged(np.concatenate((self.flat, other.flat)), np.concatenate((self.size, other.size)))

    def take(self, index: np.ndarray) -> Ragged:
        size = self.size[index]
        first = (np.cumsum(self.size) - self.size)[index]
        at = np.repeat(first - (np.cumsum(size) - size), size)
        at += np.arange(len(at))
        return Ragged(self.flat[at], size)


class WordEncoder:
    """``mode`` "word": white space is dropped and letters are lower-cased by the vocabulary;
    "byte": a single space belongs to the word after it, a line end parts words; "whole": every text goes to the library."""

    def __init__(self, path: str, mode: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task for each core already
        self.tok = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tok.model)
        self.merges.pre_tokenizer = pre_tokenizers.Split("\0", "removed")
        self.mode = mode
        added = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.odd = "|".join([_WHOLE.get(mode, ""), *added])
        vocabulary = self.tok.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.letters = _byte_letters()
        marks = self.letters[32], self.letters[10]
        self.edge[[i for w, i in vocabulary.items() if (w.endswith("</w>") if mode == "word" else w[0] in marks)]] = True
        self.letters.pop(0)

    def whole(self, texts: list[str]) -> Ragged:
        return Ragged.of([e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)])

    def _led(self, words: pa.Array) -> pa.Array:
        """Words as they stand in a text: in mode "byte" a space comes before all that have no line end there."""
        return pc.replace_substring_regex(words, "^([^\\n])", " \\1") if self.mode == "byte" else words

    def _bases(self, words: list[str]) -> Ragged:
        """Words of plain letters, straight through the merges."""
        groups = [words[k: k + _WORDS_A_CALL] for k in range(0, len(words), _WORDS_A_CALL)]
        # Zero bytes have no stand-in here: they only part the words.
        spelled = ["\0".join(g).encode().decode("latin-1").translate(self.letters) for g in groups]
        found = self.merges.encode_batch_fast(spelled, add_special_tokens=False)
        flat = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in found)])
        at = np.flatnonzero(self.edge[flat])
        if self.mode == "word":  # the last id of each word is marked, else the first
            size = np.diff(at, prepend=-1)
        else:
            size = np.diff(at, append=len(flat))
        if len(size) != len(words):
            raise ValueError("the vocabulary does not mark the edge of every word")
        return Ragged(flat, size)

    def _words(self, words: pa.Array) -> Ragged:
        """Ids of distinct words, each with what stands before it."""
        base = pc.ascii_rtrim(words, characters=_TAIL)
        plain = pc.match_substring_regex(base, _LETTERS).to_numpy(zero_copy_only=False)
        rest = self.whole(self._led(words.filter(pa.array(~plain))).to_pylist())
        base = base.filter(pa.array(plain))
        names = (pc.utf8_lower(base) if self.mode == "word" else base).dictionary_encode()
        tails = pc.replace_substring_regex(words.filter(pa.array(plain)), _LETTERS[:-1], "").dictionary_encode()
        # A table of bases, tails and other words; a plain word is a base and its tail.
        bases, ends = self._bases(self._led(names.dictionary).to_pylist()), self.whole(tails.dictionary.to_pylist())
        pieces = bases + ends + rest + Ragged(np.zeros(0, np.uint32), np.zeros(1, np.int64))
        two = np.full((len(words), 2), len(pieces.size) - 1)
        two[plain, 0] = names.indices.to_numpy()
        two[plain, 1] = len(bases.size) + tails.indices.to_numpy()
        two[~plain, 0] = len(bases.size) + len(ends.size) + np.arange(len(rest.size))
        joined = pieces.take(two.ravel())
        return Ragged(joined.flat, joined.size.reshape(-1, 2).sum(axis=1))

    def _batch(self, texts: pa.Array) -> Ragged:
        if self.mode == "whole" or not len(texts):
            return self.whole(texts.to_pylist())
        odd = pc.match_substring_regex(texts, self.odd)
        odd = pc.or_(odd, pc.equal(texts, "")).to_numpy(zero_copy_only=False)
        whole = self.whole(texts.filter(pa.array(odd)).to_pylist())
        even = texts.filter(pa.array(~odd))
        if self.mode == "byte":  # a line end goes with the word after it
            parts = pc.split_pattern(pc.replace_substring(even, "\n", " \n"), " ")
        else:
            parts = pc.ascii_split_whitespace(even)
        n_parts = np.diff(parts.offsets.to_numpy())
        words = parts.flatten().dictionary_encode()
        table, index = self._words(words.dictionary), words.indices.to_numpy().astype(np.int64)
        if self.mode == "byte":  # nothing stands before the first word of a text
            at = np.cumsum(n_parts) - n_parts
            index[at] = len(table.size) + np.arange(len(at))
            table = table + self.whole(parts.flatten().take(pa.array(at)).to_pylist())
        ids = table.take(index)
        ends = np.concatenate(([0], np.cumsum(ids.size)))[np.cumsum(n_parts)] if len(n_parts) else np.zeros(0, np.int64)
        found = Ragged(ids.flat, np.diff(ends, prepend=0))
        if not odd.any():
            return found
        order = np.empty(len(texts), np.int64)
        order[~odd], order[odd] = np.arange(len(found.size)), len(found.size) + np.arange(len(whole.size))
        return (found + whole).take(order)

    def encode(self, texts: pa.Array) -> Ragged:
        """The ids of each text; null is empty.  Callers hand in ``slices`` to bound memory."""
        return self._batch(pc.fill_null(texts, ""))


def slices(batch: pa.RecordBatch, text: int) -> list[pa.RecordBatch]:
    """``batch`` cut by rows so that each cut holds about BATCH_BYTES of its column ``text``, or one row."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(size) // BATCH_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    return [batch.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
