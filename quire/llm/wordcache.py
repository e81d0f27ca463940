"""A tokenizer's ids, with each distinct word of a batch encoded once.

Byte-level BPE never merges across a single space or line end between two characters
that are not white space, so a text is its pieces there, encoded one by one: a space
goes with the piece after it, a line end stands alone before it. Arrow splits a batch
and finds its distinct pieces; only those reach the tokenizer, and a worker keeps the
ids of the words it has seen.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402

#: Words kept; beyond them a worker starts anew. About 50 bytes a word.
KEPT = 700_000
#: Longer pieces (texts without spaces) are not kept.
LONGEST = 64
#: Pieces whose ids are gathered at once, and bytes of text split at once; both bound a worker's memory.
GATHERED = 1 << 18
SLICE_BYTES = 8 << 20
#: A single space between two characters that are not white space.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space other than the space and the line end.
OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
#: Letters followed by marks, both from the Latin blocks; digits, spaces and underscores in neither.
LETTERS_MARKS = re.compile(r"([^\W\d_]+)([^\s\w]*)")
LATIN_END = "ɐ"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on, in order."""
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    rest = iter(range(256, 512))
    return {b: chr(b if b in shown else next(rest)) for b in range(256)}


class WordEncoder:
    """``encode(texts)``: for each text the ids the tokenizer gives without adding special tokens."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        state = self.tokenizer.to_str()
        self.by_word = (self.tokenizer.normalizer is None and type(self.tokenizer.model).__name__ == "BPE"
                        and re.search(r'"pre_tokenizer":\{"type":"ByteLevel","add_prefix_space":false,"trim_offsets":\w+,"use_regex":true\}', state) is not None)
        self.letters = _byte_letters()
        self.space = self.letters[32]
        self.tokenize = self.tokenizer.model.tokenize
        self.marks: dict[str, bytes] = {"": b""}
        self.line_end = self.plain("\n")
        # the words seen so far, as Arrow and numpy arrays: word i has ids pool[start[i]:start[i] + size[i]]
        self.known = pa.array([], pa.string())
        self.start = self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def plain(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _new(self, word: str) -> bytes:
        """Ids of a piece: after a line end if it begins with one, else after a space."""
        return self.line_end + self._piece(word[1:], "") if word[:1] == "\n" else self._piece(word, " ")

    def _piece(self, word: str, space: str) -> bytes:
        """Ids of ``space`` and a piece; letters and the marks after them are split by the pattern there, so the model reads them apart."""
        m = LETTERS_MARKS.fullmatch(word)
        if not m:
            return self.plain(space + word)
        core, end = m.groups()
        if not core.isascii():
            if max(core) >= LATIN_END:
                return self.plain(space + word)
            core = core.encode().decode("latin-1").translate(self.letters)
        tail = self.marks.get(end)
        if tail is None:
            tail = self.plain(end)
            if len(self.marks) < 10_000:
                self.marks[end] = tail
        return array("I", [t.id for t in self.tokenize((self.space if space else "") + core)]).tobytes() + tail

    def _ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, pool) of distinct words; the new ones are encoded and kept."""
        at = pc.index_in(words, value_set=self.known)
        new = words.filter(at.is_null())
        found = list(map(self._new, new.to_pylist()))
        new_size = np.array([len(x) // 4 for x in found], np.int64)
        new_start = len(self.pool) + np.cumsum(new_size) - new_size
        pool = np.concatenate([self.pool, np.frombuffer(b"".join(found), "<u4")])
        hit = at.is_valid().to_numpy(zero_copy_only=False)
        place = at.fill_null(0).to_numpy()
        start, size = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        start[hit], size[hit] = self.start[place[hit]], self.size[place[hit]]
        start[~hit], size[~hit] = new_start, new_size
        short = pc.less_equal(pc.binary_length(new), LONGEST)
        if len(self.known) + len(new) <= KEPT:
            keep = short.to_numpy(zero_copy_only=False)
            self.known = pa.concat_arrays([self.known, new.filter(short)])
            self.start, self.size = np.concatenate([self.start, new_start[keep]]), np.concatenate([self.size, new_size[keep]])
            self.pool = pool
        else:
            self.known = pa.array([], pa.string())
            self.start = self.size = np.zeros(0, np.int64)
            self.pool = np.zeros(0, np.uint32)
        return start, size, pool

    def _odd(self, text: str) -> bool:
        """Whether a space or line end has white space beside it, or white space begins or ends the text."""
        return (text[:1].isspace() or text[-1:].isspace() or "  " in text or "\n\n" in text or " \n" in text or "\n " in text
                or any(c in text and any(x in text for x in (c + " ", " " + c, c + "\n", "\n" + c)) for c in OTHER_SPACE))

    def _slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        values = texts.to_pylist()
        odd = [i for i, t in enumerate(values) if self._odd(t)]
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        if odd:
            for i in odd:
                values[i] = CUT.split(values[i])
            others = set(odd)
            lists = pieces.to_pylist()
            pieces = pa.array([values[i] if i in others else p for i, p in enumerate(lists)], pa.list_(pa.string()))
        offsets = pieces.offsets.to_numpy()
        offsets = offsets - offsets[0]
        flat = pieces.flatten()
        coded = flat.dictionary_encode()
        start, size, pool = self._ids_of(coded.dictionary)
        # a text's first piece has no space before it
        firsts = offsets[:-1]
        head = [self._piece(w, "") for w in flat.take(pa.array(firsts)).to_pylist()]
        head_size = np.array([len(x) // 4 for x in head], np.int64)
        start = np.concatenate([start, len(pool) + np.cumsum(head_size) - head_size])
        size = np.concatenate([size, head_size])
        pool = np.concatenate([pool, np.frombuffer(b"".join(head), "<u4")])
        at = coded.indices.to_numpy().copy()
        at[firsts] = len(coded.dictionary) + np.arange(len(firsts))
        del flat, coded, pieces
        text = 0
        while text < len(firsts):  # texts in runs of about GATHERED pieces
            last = max(text + 1, int(np.searchsorted(offsets, offsets[text] + GATHERED)))
            last = min(last, len(firsts))
            run = at[offsets[text]:offsets[last]]
            sizes = size[run]
            ends = np.cumsum(sizes)
            ids = pool[np.repeat(start[run] - (ends - sizes), sizes) + np.arange(ends[-1])]
            bounds = np.concatenate([[0], ends])[offsets[text:last + 1] - offsets[text]].tolist()
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                yield ids[lo:hi]
            text = last

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        if not self.by_word:
            yield from (np.frombuffer(self.plain(t), "<u4") for t in texts.to_pylist())
            return
        lo = used = 0
        for hi, n in enumerate(pc.binary_length(texts).to_pylist()):
            if used and used + n > SLICE_BYTES:
                yield from self._slice(texts.slice(lo, hi - lo))
                lo = hi
                used = 0
            used += n
        if len(texts) > lo:
            yield from self._slice(texts.slice(lo))


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One per worker process and tokenizer."""
    return WordEncoder(path)
