"""Byte-level BPE ids of whole texts with the ``tokenizers`` library, word by word.

Byte-level pre-tokenisation never joins characters across a space that a non-space follows, so a
text may be cut before each such space and the pieces encoded alone. Arrow splits and
dictionary-encodes the pieces. Distinct pieces are cut once more where a mark follows a letter,
which ends a pre-token too, and the library encodes each distinct part once. Texts with any other
space, such as doubled or trailing ones, are cut only at the safe spaces, and no cut falls into a
string that the tokenizer takes as one added token.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from cadenza.llm.arrowtext import held, ragged_take

#: Distinct parts remembered between slices; a bound on memory only, results do not depend on it.
MEMO = 300_000
#: Text encoded at once: more means fewer look-ups of the same piece and more memory.
SLICE_BYTES = 8 << 20
_SAFE = re.compile(r"(?= \S)")
_ODD = r" \s| $"
_MARKS = ".,;:!?\n*%$#&"
#: A space in the names of byte-level tokens.
_SPACE = "\u0120"


def load(path: str) -> Encoder:
    """This process's encoder for a tokenizer file."""
    return held(path, lambda: Encoder(path))


class _Table:
    """Strings with their ids; looked up in Arrow, so that Python sees new strings only."""

    def __init__(self, encoder: Encoder, prefix: str) -> None:
        self.encoder, self.prefix = encoder, prefix
        self.keys = pa.array([], pa.large_string())
        self.ids = np.zeros(0, np.uint32)
        self.begins = self.lengths = np.zeros(0, np.int64)
        self.kept = 0

    def rows(self, strings: pa.Array) -> np.ndarray:
        """Rows of distinct strings, -1 for those the table lacks."""
        if len(self.keys) > MEMO:  # forget what the last slice added beyond the bound
            self.keys, self.ids = self.keys[: self.kept], self.ids[: self.begins[self.kept]]
            self.begins, self.lengths = self.begins[: self.kept], self.lengths[: self.kept]
        self.kept = len(self.keys)
        return pc.fill_null(pc.index_in(strings, value_set=self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, strings: pa.Array) -> int:
        """Encode new strings; the row of the first."""
        first = len(self.keys)
        if len(strings):
            ids, lengths = self.encoder.words(strings) if self.prefix else self.encoder.strings(strings.to_pylist())
            self.begins = np.concatenate([self.begins, len(self.ids) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.ids = np.concatenate([self.ids, ids])
            self.keys = pa.concat_arrays([self.keys, strings])
        return first

    def find(self, strings: pa.Array) -> np.ndarray:
        """Rows of any strings, repeats included; new ones are added. Nothing is dropped."""
        coded = strings.dictionary_encode()
        distinct = coded.dictionary
        at = pc.fill_null(pc.index_in(distinct, value_set=self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        at[new] = self.add(distinct.take(pa.array(new))) + np.arange(len(new))
        return at[coded.indices.to_numpy(zero_copy_only=False)]


class Encoder:
    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        added = "".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        if " " in added:
            raise ValueError("added tokens with spaces are not supported")
        marks = re.escape("".join(c for c in _MARKS if c not in added))
        self.marks = re.compile(f"(?<=[^\\W\\d_])(?=[{marks}])")
        # letters and one tail, by far the most frequent of such words: cut in Arrow
        self.tailed = f"(?s)^(?P<head>\\p{{L}}+)(?P<tail>[{marks}][^\\p{{L}}\\p{{N}}]*)$"
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.opens[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(_SPACE)]] = True
        self.spaced, self.bare = _Table(self, " "), _Table(self, "")

    def whole(self, texts: list[str]) -> list[list[int]]:
        """Ids straight from the library, for comparison."""
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def strings(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each has) of strings encoded apart."""
        coded = self.tokenizer.encode(strings, is_pretokenized=True, add_special_tokens=False)
        return np.array(coded.ids, np.uint32), np.bincount(np.array(coded.word_ids, np.int64), minlength=len(strings))

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of words without spaces, each after one: all in one text, as only a word's first id opens with a space."""
        text = pc.binary_join(pa.LargeListArray.from_arrays([0, len(words)], words), pa.scalar(" ", pa.large_string()))[0].as_py()
        ids = np.array(self.tokenizer.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, np.uint32)
        heads = np.flatnonzero(self.opens[ids])
        if len(heads) != len(words) or heads[0]:  # an added token took a space
            return self.strings([" " + w for w in words.to_pylist()])
        return ids, np.diff(np.concatenate([heads, [len(ids)]]))

    def _pieces(self, words: pa.Array, others: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in order, how many each has) of distinct words after a space, then of other pieces."""
        at = self.spaced.rows(words)
        self.bare.rows(words[:0])  # the tables drop strings here only, so all of one slice's rows hold together
        lacking = np.flatnonzero(at < 0)
        new = words.take(pa.array(lacking))
        cut = pc.extract_regex(new, self.tailed)
        two = pc.is_valid(cut).to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(~(two | pc.utf8_is_alpha(new).to_numpy(zero_copy_only=False)))
        heads = pc.if_else(pa.array(two), pc.struct_field(cut, "head"), new)
        tails, owners = [], []
        if len(rest):
            firsts = []
            for n, word in zip(rest.tolist(), new.take(pa.array(rest)).to_pylist(), strict=True):
                head, *more = self.marks.split(" " + word)
                firsts.append(head[1:])
                tails += more
                owners += [n] * len(more)
            mask = np.zeros(len(new), bool)
            mask[rest] = True
            heads = pc.replace_with_mask(heads, pa.array(mask), pa.array(firsts, pa.large_string()))
        at[lacking] = self.spaced.find(heads)
        single = np.flatnonzero(two)
        more = self.bare.find(pa.concat_arrays([pc.struct_field(cut, "tail").take(pa.array(single)), pa.array(tails + others, pa.large_string())]))
        owners = np.concatenate([single, np.array(owners, np.int64)])
        # one table behind the other; a piece is a run of parts
        begins = np.concatenate([self.spaced.begins, len(self.spaced.ids) + self.bare.begins])
        lengths = np.concatenate([self.spaced.lengths, self.bare.lengths])
        ids = np.concatenate([self.spaced.ids, self.bare.ids])
        more = more + len(self.spaced.lengths)
        tail_owner = lacking[owners]
        parts = np.concatenate([at, more])
        owner = np.concatenate([np.arange(len(at)), tail_owner, len(at) + np.arange(len(others))])
        parts = parts[np.argsort(owner, kind="stable")]
        total = np.bincount(owner, weights=lengths[np.concatenate([at, more])], minlength=len(at) + len(others)).astype(np.int64)
        return ids[ragged_take(begins[parts], lengths[parts])], total

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets by text) of a large-string array without nulls."""
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts)
        pieces = pc.split_pattern(plain, " ")
        offsets = pieces.offsets.to_numpy().astype(np.int64)
        flat = pieces.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        codes, offsets, words = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets - offsets[0], flat.dictionary
        # a text's first piece has no space before it
        heads = offsets[:-1]
        first = words.take(pa.array(codes[heads])).to_pylist()
        rows, extra = np.flatnonzero(odd), []
        for i in rows.tolist():
            extra.append(_SAFE.split(texts[i].as_py()))
        others = first + [p for parts in extra for p in parts]
        codes[heads] = len(words) + np.arange(len(heads))
        if len(rows):
            # a text that is cut its own way has one placeholder piece in codes; put its pieces there
            runs, starts = np.diff(offsets), offsets[:-1].copy()
            parts = np.array([len(p) for p in extra])
            runs[rows] = parts
            starts[rows] = len(codes) + np.cumsum(parts) - parts
            pool = np.concatenate([codes, len(words) + len(first) + np.arange(parts.sum())])
            codes = pool[ragged_take(starts, runs)]
            offsets = np.concatenate([[0], np.cumsum(runs)])
        flat_ids, lengths = self._pieces(words, others)
        taken = lengths[codes]
        ids = flat_ids[ragged_take((np.cumsum(lengths) - lengths)[codes], taken)]
        ends = np.concatenate([[0], np.cumsum(taken)])
        return ids, ends[offsets]
