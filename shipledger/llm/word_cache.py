"""Encode many texts with a tokenizer, each distinct word once.

Texts are cut at white space where the tokenizer always cuts, words are dictionary-encoded by Arrow, and
only words that a worker has not met go to the tokenizer, many joined in one text. The ids of a
batch are then gathered from the ids of its words. What is remembered only saves time: beyond ``limit``
words it is forgotten.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from shipledger.llm.pieces import byte_letters

#: Bytes of text that are cut and gathered at a time, so that the gathered ids stay small.
PART_BYTES = 1 << 23
#: Letters whose lower case is one letter, for which no normalization changes anything (fixed values).
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


class WordStore:
    """Ids of words: ``learn(words)`` gives the ids of unknown ones, each as the bytes of ``dtype``."""

    def __init__(self, learn: Callable[[list[str]], list[bytes]], dtype: str, limit: int):
        self.learn, self.dtype, self.limit = learn, dtype, limit
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ends = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype=self.dtype)

    def places(self, words: list[str]) -> np.ndarray:
        """The place of every word (all distinct) in ``ends`` and ``ids``."""
        if len(self.place) > self.limit:
            self._forget()
        place = self.place
        found = list(map(place.get, words))
        if None in found:
            new = [w for w, at in zip(words, found) if at is None]
            learnt = self.learn(new)
            place.update(zip(new, range(len(place), len(place) + len(new))))
            sizes = np.fromiter(map(len, learnt), dtype=np.int64, count=len(learnt)) // self.ids.itemsize
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(learnt), dtype=self.dtype)])
            found = map(place.__getitem__, words)
        return np.fromiter(found, dtype=np.int64, count=len(words))

    def gather(self, lists: pa.ListArray) -> list[np.ndarray]:
        """The ids of every text, given as its list of words."""
        coded = lists.flatten().dictionary_encode()
        at = self.places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        word = at[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, dtype=np.int64)
        starts, sizes = self.ends[word], np.diff(self.ends)[word]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])]
        offsets = lists.offsets.to_numpy()
        bounds = ends[offsets - offsets[0]]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def parts(texts: pa.Array, size: int = PART_BYTES) -> Iterator[pa.Array]:
    """Slices of about ``size`` bytes; nulls become empty texts."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def cut_bytes(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The bytes of ``ids`` up to each of ``ends``, from the end before."""
    data, places = ids.tobytes(), (ends * ids.itemsize).tolist()
    return [data[a:b] for a, b in zip([0, *places[:-1]], places)]


class FoldedWordEncoder:
    """A tokenizer that drops white space and lower-cases, with a mark at the end of each word.

    White space only ends words there, so every run between ASCII white space has its ids by itself.
    A run of Latin letters, perhaps with punctuation behind it, is put together from the ids of the lower-case letters and
    those of the punctuation; new runs of letters are encoded many at a time, and their ends found by the mark
    in the vocabulary. All other runs, those with special tokens in them included, are encoded by themselves.
    """

    _PLAIN = re.compile(f"([{LETTERS}]+)([!-&(-/:;=?@^_~]*)")

    def __init__(self, tokenizer, mark: str = "</w>", limit: int = 1_500_000):
        self.tokenizer = tokenizer
        size = tokenizer.get_vocab_size()
        self.dtype = "<u2" if size <= 1 << 16 else "<u4"
        self.is_end = np.zeros(size, dtype=bool)
        for token, number in tokenizer.get_vocab().items():
            self.is_end[number] = token.endswith(mark)
        self.limit = limit
        self.runs: dict[str, bytes] = {}
        self.words = WordStore(self._learn, self.dtype, limit)

    def _each(self, texts: list[str]) -> list[bytes]:
        return [
            np.asarray(found.ids, dtype=self.dtype).tobytes()
            for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ]

    def _learn_runs(self, new: list[str]) -> None:
        for start in range(0, len(new), 2048):
            part = new[start : start + 2048]
            ids = np.frombuffer(self._each([" ".join(part)])[0], dtype=self.dtype)
            ends = np.flatnonzero(self.is_end[ids]) + 1
            self.runs.update(zip(part, cut_bytes(ids, ends) if len(ends) == len(part) else self._each(part)))

    def _learn(self, new: list[str]) -> list[bytes]:
        if len(self.runs) > self.limit:
            self.runs.clear()
        runs, plain = self.runs, self._PLAIN.fullmatch
        split = [(m[1].lower(), m[2]) if (m := plain(w)) else ("", w) for w in new]
        self._learn_runs(list({run for run, _ in split if run not in runs} - {""}))
        other = list({rest for _, rest in split})
        known = dict(zip(other, self._each(other)))
        runs[""] = b""
        return [runs[run] + known[rest] for run, rest in split]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of every text."""
        found: list[np.ndarray] = []
        for part in parts(texts):
            found += self.words.gather(pc.ascii_split_whitespace(part))
        return found


#: Bytes of ASCII white space.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: First bytes of two-byte characters, but for 0xC2, with which two characters of white space begin.
_TWO = np.zeros(256, dtype=bool)
_TWO[0xC3:0xE0] = True


def spaced_pieces(texts: pa.Array) -> pa.ListArray:
    """Every text cut before ASCII white space that follows an ASCII character or a two-byte one, which are not white space.

    Pre-tokenizers of the kind of :class:`SpacedWordEncoder` always cut there (see ``pieces``).
    """
    texts = pc.cast(pc.fill_null(texts, ""), pa.string())
    size = len(texts)
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + size + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    white = _SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    if len(data) > 1:
        before = (data[:-1] < 0x80) & ~white[:-1]
        before[1:] |= (data[1:-1] >= 0x80) & _TWO[data[:-2]]
        cut[1:-1] = white[1:] & before
    cut[ends] = True
    places = np.flatnonzero(cut).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(data))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(places, ends).astype(np.int32)), pieces)


class SpacedWordEncoder:
    """A byte-level BPE tokenizer whose pre-tokenizer is the pattern in ``pieces``, without normalizer.

    A piece of letters after one space, perhaps with punctuation behind, is put together from the ids of its letters and those
    of the punctuation, which never share a match of the pattern. New runs of letters are encoded many at a time, and their
    beginnings found by the space that starts a token. Other pieces, those with special tokens in them included,
    are encoded many at a time as lines, where a line feed stays a match of its own, else by themselves.
    """

    _PLAIN = re.compile(f"( [{LETTERS}]+)([!-&(-/:;=?@^_~]*)")
    _LINE = re.compile(r" ?[^\s<|>]+")

    def __init__(self, tokenizer, limit: int = 1_500_000):
        self.tokenizer = tokenizer
        size = tokenizer.get_vocab_size()
        self.dtype = "<u2" if size <= 1 << 16 else "<u4"
        self.is_start = np.zeros(size, dtype=bool)
        space = byte_letters()[0x20]
        for token, number in tokenizer.get_vocab().items():
            self.is_start[number] = token.startswith(space)
        feed = tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None
        self.limit = limit
        self.runs: dict[str, bytes] = {}
        self.words = WordStore(self._learn, self.dtype, limit)

    def _each(self, texts: list[str]) -> list[bytes]:
        return [
            np.asarray(found.ids, dtype=self.dtype).tobytes()
            for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ]

    def _joined(self, texts: list[str], by: str, known: dict[str, bytes]) -> None:
        for start in range(0, len(texts), 2048):
            part = texts[start : start + 2048]
            ids = np.frombuffer(self._each([by.join(part)])[0], dtype=self.dtype)
            if by:
                ends = np.append(np.flatnonzero(ids == self.feed), len(ids))
                width = ids.itemsize
                found = [d[width:] if i else d for i, d in enumerate(cut_bytes(ids, ends))]
            else:
                ends = np.append(np.flatnonzero(self.is_start[ids])[1:], len(ids))
                found = cut_bytes(ids, ends)
            known.update(zip(part, found if len(found) == len(part) else self._each(part)))

    def _learn(self, new: list[str]) -> list[bytes]:
        if len(self.runs) > self.limit:
            self.runs.clear()
        runs, plain = self.runs, self._PLAIN.fullmatch
        split = [(m[1], m[2]) if (m := plain(w)) else ("", w) for w in new]
        self._joined(list({run for run, _ in split if run not in runs} - {""}), "", runs)
        runs[""] = b""
        other = {rest for _, rest in split}
        known = {"": b""}
        lines = [w for w in other if self._LINE.fullmatch(w)] if self.feed is not None else []
        self._joined(lines, "\n", known)
        alone = list(other - known.keys())
        known.update(zip(alone, self._each(alone)))
        return [runs[run] + known[rest] for run, rest in split]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of every text."""
        found: list[np.ndarray] = []
        for part in parts(texts):
            found += self.words.gather(spaced_pieces(part))
        return found


class WholeTextEncoder:
    """Any tokenizer: every text by itself."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.dtype = "<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4"

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)
        return [np.asarray(f.ids, dtype=self.dtype) for f in found]


def encoder_for(tokenizer):
    """The fastest encoder with the ids of ``tokenizer``."""
    kind = json.loads(tokenizer.to_str())
    normalizers = [n["type"] for n in (kind["normalizer"] or {}).get("normalizers", [])]
    cutters = (kind["pre_tokenizer"] or {}).get("pretokenizers", [])
    drops_space = bool(cutters) and cutters[0].get("type") == "Split" and cutters[0].get("behavior") == "Removed" and cutters[0].get("invert")
    if (
        kind["model"]["type"] == "BPE"
        and kind["model"].get("end_of_word_suffix")
        and normalizers == ["NFC", "Replace", "Lowercase"]
        and drops_space
        and r"\s" in cutters[0]["pattern"].get("Regex", "")
    ):
        return FoldedWordEncoder(tokenizer, kind["model"]["end_of_word_suffix"])
    cutter = kind["pre_tokenizer"] or {}
    if (
        kind["model"]["type"] == "BPE"
        and kind["normalizer"] is None
        and cutter.get("type") == "ByteLevel"
        and cutter.get("use_regex", True)
        and not cutter.get("add_prefix_space")
    ):
        return SpacedWordEncoder(tokenizer)
    return WholeTextEncoder(tokenizer)
