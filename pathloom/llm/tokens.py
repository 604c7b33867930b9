"""Tokenizing whole texts with the tokenizers library, each distinct word once."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A space before anything but white space; the tokenizers' patterns end a
#: piece there whatever stands around it, so text may be cut before it.
_CUT = re.compile(" (?=[^\\s\\u180e])")
#: Spaces at which a text is not cut, for the matcher of Arrow.
_ODD = r" ([\s\v\x{1c}-\x{1f}\x{85}\x{180e}\p{Z}]|$)"
#: Runs that word BPE takes as pre-tokens: letters that lower-casing and composing leave alone or
#: map one to one, a digit, signs without the apostrophe. Line ends between them are dropped.
_RUN = r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+"


class TextEncoder:
    """``tokenizers`` ids of whole texts, equal to encoding each text at once.

    A text is cut before each space that a non-space follows. The tokenizers
    that this serves (byte-level BPE, and word BPE that drops white space) end
    a pre-token at every such place, so the ids of the parts, one after the
    other, are the ids of the text. Parts repeat, so each is encoded once and
    kept. New parts are encoded many in a line where the ids show each part's
    end: with byte-level BPE a part's first token alone starts with the space;
    with word BPE each pre-token's last token is marked, and parts of common
    letters, digits, signs and line ends have pre-tokens that can be told
    beforehand. Other parts are encoded one by one. Beyond ``max_words`` parts or ``max_bytes`` of them
    those met once are forgotten. Added tokens' strings are ordinary text; with
    ``special`` they are what the library makes of them by default, and texts
    that hold one are encoded whole by the library as it comes.
    """

    def __init__(self, path: str, max_words: int = 2_000_000, max_bytes: int = 40_000_000, special: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.tokenizer.encode_special_tokens = True
        self.whole, self.added = None, ""
        if special:
            self.whole = Tokenizer.from_file(path)
            self.whole.no_padding()
            self.whole.no_truncation()
            self.added = "|".join(re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values())
        vocab = self.tokenizer.get_vocab()
        self.n_ids = max(vocab.values()) + 1
        self.starts, self.ends = np.zeros(self.n_ids, bool), np.zeros(self.n_ids, bool)
        for piece, i in vocab.items():
            self.starts[i], self.ends[i] = piece.startswith("Ġ"), piece.endswith("</w>")
        self.quick = None
        if self.ends.any():  # lower-cased letters need no pattern and no normalizer
            self.quick = Tokenizer.from_file(path)
            self.quick.normalizer = None
            self.quick.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)])
        self.max_words, self.max_bytes = max_words, max_bytes
        self.words = pa.array([], pa.string())
        self.start, self.length, self.met = (np.zeros(0, np.int32) for _ in range(3))
        self.table, self.used = np.zeros(1 << 16, np.uint32), 0

    def _forget(self) -> None:
        """Keeps the parts met more than once, half of the most at most."""
        keep = self.met > 1
        if keep.sum() > self.max_words // 2:
            keep &= self.met > np.partition(self.met, -self.max_words // 2)[-self.max_words // 2]
        keep &= pc.binary_length(self.words).to_numpy() <= 64
        self.words = self.words.filter(pa.array(keep))
        ids = self._gather(self.table, self.start[keep], self.length[keep])
        self.table[: len(ids)] = ids
        self.used, self.length, self.met = len(ids), self.length[keep], np.zeros(int(keep.sum()), np.int32)
        self.start = (np.cumsum(self.length) - self.length).astype(np.int32)

    @staticmethod
    def _gather(table: np.ndarray, start: np.ndarray, length: np.ndarray, step: int = 1 << 17) -> np.ndarray:
        """The table's stretches in a row; some parts at a time, as their places take more room than they do."""
        out = np.empty(int(length.sum(dtype=np.int64)), table.dtype)
        done = 0
        for i in range(0, len(start), step):
            own = length[i : i + step]
            ends = np.cumsum(own, dtype=np.int64)
            total = int(ends[-1])
            out[done : done + total] = table[np.repeat(start[i : i + step] - (ends - own), own) + np.arange(total)]
            done += total
        return out

    def _put(self, ids: np.ndarray) -> int:
        """Room for ids at the table's end; returns the place."""
        at = self.used
        while at + len(ids) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def _some(self, texts: list[str], by, step: int) -> Iterator[list[np.ndarray]]:
        """Ids of the texts, few at a time: the library's results are large."""
        for i in range(0, len(texts), step):
            yield [np.array(e.ids, np.uint32) for e in by.encode_batch_fast(texts[i : i + step], add_special_tokens=False)]

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in a row, each encoded by itself, and their numbers."""
        got = [(np.concatenate(x), [len(y) for y in x]) for x in self._some(texts, self.tokenizer, 2000)]
        return np.concatenate([x for x, _ in got]) if got else np.zeros(0, np.uint32), np.array([n for _, x in got for n in x], np.int64)

    def _lines(self, words: list[str], by) -> np.ndarray:
        lines = ["".join(words[i : i + 500]) for i in range(0, len(words), 500)]
        if by is self.quick:
            lines = [x.lower() for x in lines]
        got = [y for x in self._some(lines, by, 8) for y in x]
        return np.concatenate(got) if got else np.zeros(0, np.uint32)

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Encodes new parts, each as after a space, keeps them, and returns their numbers."""
        stops = None
        if self.quick:
            plain = pc.match_substring_regex(words, f"^(?:{_RUN}|\n)+$")
            runs = pc.replace_substring(pc.replace_substring_regex(words.filter(plain), f"({_RUN})", r" \1"), "\n", "")
            ids = self._lines(runs.to_pylist(), self.quick)
            last = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
            count = np.cumsum(pc.count_substring(runs, " ").to_numpy())
            if len(count) and count[-1] == len(last) - 1:
                stops = last[count]
        else:
            plain = pc.and_(pc.invert(pc.match_substring(words, " ")), pc.greater(pc.binary_length(words), 0))
            runs = words.filter(plain)
            ids = self._lines([" " + w for w in runs.to_pylist()], self.tokenizer)
            first = np.flatnonzero(self.starts[ids])
            if len(runs) and len(first) == len(runs):
                stops = np.append(first[1:], len(ids))
        if stops is None:
            plain = pa.array(np.zeros(len(words), bool))
        number = np.zeros(len(words), np.int32)
        for mask, one_by_one in ((plain, False), (pc.invert(plain), True)):
            rows = np.flatnonzero(mask.to_numpy(zero_copy_only=False))
            if not len(rows):
                continue
            names = words.take(pa.array(rows))
            if one_by_one:
                ids, length = self._each([" " + w for w in names.to_pylist()])
            else:
                length = np.diff(stops, prepend=0)
            at = self._put(ids)
            number[rows] = np.arange(len(self.words), len(self.words) + len(rows))
            self.start = np.concatenate([self.start, (at + np.cumsum(length) - length).astype(np.int32)])
            self.length = np.concatenate([self.length, length.astype(np.int32)])
            self.met = np.concatenate([self.met, np.zeros(len(length), np.int32)])
            self.words = pa.concat_arrays([self.words, names])
        return number

    def _find(self, words: pa.Array) -> np.ndarray:
        at = pc.index_in(words, value_set=self.words)
        if not at.null_count:
            return at.to_numpy()
        new = at.is_null().to_numpy(zero_copy_only=False)
        out = pc.fill_null(at, 0).to_numpy().copy()
        out[new] = self._learn(words.filter(pa.array(new)))
        return out

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        odd = pc.match_substring_regex(texts, _ODD)
        if not pc.any(odd, min_count=0).as_py():
            return pc.split_pattern(texts, " ")
        plain = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        other = pa.array([_CUT.split(x) for x in texts.filter(odd).to_pylist()], plain.type)
        mask = odd.to_numpy(zero_copy_only=False)
        order = np.where(mask, len(plain) + np.cumsum(mask) - 1, np.cumsum(~mask) - 1)
        return pa.concat_arrays([plain, other]).take(pa.array(order))

    def _parts(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each part's place in the table and length, and the number of parts by text."""
        if len(self.words) > self.max_words or self.words.nbytes > self.max_bytes:
            self._forget()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        marked = np.zeros(len(texts), bool)
        if self.added and len(texts):
            marked = pc.match_substring_regex(texts, self.added, ignore_case=True).to_numpy(zero_copy_only=False)
        held = texts.filter(pa.array(marked)).to_pylist() if marked.any() else []
        if held:  # one empty part each, which gets the whole text's ids below
            texts = pc.if_else(pa.array(marked), "", texts)
        lists = self._cut(texts)
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        coded = lists.flatten().dictionary_encode()
        slot = self._find(coded.dictionary)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int32)
        # A text's first part stands after no space; it is encoded anew.
        heads = coded.take(pa.array(bounds[:-1])).dictionary_decode().dictionary_encode() if len(coded) else None
        start, length = self.start[slot], self.length[slot]
        used = self.used
        if heads is not None:
            ids, n = self._each(heads.dictionary.to_pylist())
            at = self._put(ids) + np.cumsum(n) - n
            start[bounds[:-1]], length[bounds[:-1]] = at[heads.indices.to_numpy()], n[heads.indices.to_numpy()]
        for i, text in zip(bounds[:-1][marked].tolist(), held, strict=True):
            ids = np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
            start[i], length[i] = self._put(ids), len(ids)
        sizes = np.diff(bounds)
        if end_id is not None:
            at = self._put(np.array([end_id], np.uint32))
            start, length = np.insert(start, bounds[1:], at), np.insert(length, bounds[1:], 1)
            sizes = sizes + 1
        self.used = used  # what came after is read before more is put there
        self.met += np.bincount(slot, minlength=len(self.met)).astype(np.int32)
        return start, length, sizes

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of them by text; null counts as empty.

        ``end_id`` is put after each text's ids if given.
        """
        start, length, sizes = self._parts(texts, end_id)
        marks = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])[np.concatenate([[0], np.cumsum(sizes)])]
        return self._gather(self.table, start, length), np.diff(marks)

    def count(self, texts: pa.Array, end_id: int | None = None) -> np.ndarray:
        """How often each id occurs in the texts, by id."""
        start, length, _ = self._parts(texts, end_id)
        start, length = start[length > 0], length[length > 0]
        times = np.bincount(start, minlength=1)
        met = np.flatnonzero(times)
        own = np.zeros(len(times), np.int64)
        own[start] = length
        return np.bincount(self._gather(self.table, met, own[met]), np.repeat(times[met], own[met]), self.n_ids).astype(np.int64)
