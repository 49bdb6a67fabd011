import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cadenza.llm import bpe, packing, tokenfile
from tests.llm.helpers import AWKWARD, awkward, empty, rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


def slow_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_pieces_equal_the_whole_text():
    import pyarrow as pa

    rng = random.Random(3)
    parts = ["a", " ", "  ", "\n", " b", "'s", "12", " 3", "é", "\t", "<|endoftext|>", ".", "日本", "\x1c", "\x85", "　", "word"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(3000)]
    ids, offsets = bpe.Encoder(PATH).encode(pa.array(texts, pa.large_string()))
    whole = bpe.load(PATH).whole(texts)
    assert [ids[s:e].tolist() for s, e in zip(offsets, offsets[1:])] == whole


def test_memory_of_pieces_is_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "MEMO", 5)
    encoder = bpe.Encoder(PATH)
    for i in range(5):
        texts = [f"w{i} x{j} again" for j in range(20)]
        ids, offsets = encoder.encode(pa.array(texts, pa.large_string()))
        assert [ids[s:e].tolist() for s, e in zip(offsets, offsets[1:])] == encoder.whole(texts)


def test_token_file_round_trip(spark):
    for extra in (False, True):
        found = rows(tokenfile.round_trip(awkward(spark, extra), PATH, with_ids=True))
        assert len(found) == len(AWKWARD)
        by_id = {}
        for r in AWKWARD:
            by_id.setdefault(r[0], slow_ids(r[1]) + [2])
        ordered = sorted(found, key=lambda r: r[1])
        at = 0
        assert [r[0] for r in ordered] == sorted((r[0] for r in AWKWARD), key=lambda x: -1 if x is None else x)
        for doc_id, start, n, crc, raw in ordered:
            ids = np.frombuffer(raw, "<u4")
            assert start == at and ids.tolist() == by_id[doc_id] and n == len(ids) and crc == zlib.crc32(raw)
            at += n


def test_token_file_empty(spark):
    assert rows(tokenfile.round_trip(empty(spark), PATH)) == []


@pytest.mark.parametrize("limit", [4, 6, 20])
def test_code_lengths_are_limited_and_optimal_when_free(limit):
    import heapq

    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 0, 55])
    lengths = tokenfile.code_lengths(counts, limit)
    assert lengths.max() <= limit and lengths[9] == 0
    assert sum(2.0 ** -int(n) for n in lengths if n) == 1
    if limit == 20:
        heap, cost = sorted(int(c) for c in counts if c), 0
        while len(heap) > 1:
            pair = heapq.heappop(heap) + heapq.heappop(heap)
            cost += pair
            heapq.heappush(heap, pair)
        assert int((counts * lengths).sum()) == cost


def test_stretches_decode_alone():
    rng = np.random.default_rng(0)
    ids = rng.geometric(0.01, 5000).astype(np.int64)
    book = tokenfile.Codebook(tokenfile.code_lengths(np.bincount(ids)))
    data, at, inner = book.encode(ids, np.array([0, 3000, 3000, 5000]))
    assert at[1] == at[2]
    for start, n in ((0, 1), (17, 300), (2999, 1)):
        assert book.decode(data, inner[start : start + 1], np.array([n])).tolist() == ids[start : start + n].tolist()
    assert book.decode(data, at[2:3] * 8, np.array([2000])).tolist() == ids[3000:].tolist()


def check_packing(found, docs, capacity):
    by_sequence, by_doc = {}, {}
    for doc_id, piece, start, length, crc, raw, sequence, offset in found:
        by_sequence.setdefault(sequence, []).append((offset, length))
        by_doc.setdefault(doc_id, []).append((piece, start, length, raw))
        assert crc == zlib.crc32(raw) and 1 <= length <= capacity
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return by_sequence


def test_packing_places_everything(spark):
    found = rows(packing.pack(awkward(spark, True), PATH))
    check_packing(found, AWKWARD, 2048)
    whole = {}
    for r in sorted(found, key=lambda r: (repr(r[0]), r[1])):
        if r[0] != 4:
            whole.setdefault(r[0], []).extend(np.frombuffer(r[5], "<u4").tolist())
    for doc_id, text, *_ in AWKWARD:
        if doc_id != 4:
            assert whole[doc_id] == slow_ids(text) + [0]
    assert sum(r[0] == 4 for r in found) == 2
    assert rows(packing.pack(empty(spark), PATH)) == []


def test_plan_places_each_rank_once_and_pairs_large_pieces():
    rng = random.Random(5)
    for trial in range(60):
        capacity = rng.choice([1, 2, 10, 64, 100])
        counts = {n: rng.randrange(1, 40) for n in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
        slots, sequences = packing.plan(counts, capacity)
        fill, large, seen = {}, {}, {}
        for s in slots:
            for rank in range(s.first, s.last):
                assert (s.length, rank) not in seen
                seen[s.length, rank] = 1
                bin_no = s.sequence + (rank - s.first) // s.per_bin
                fill.setdefault(bin_no, []).append((s.offset + (rank - s.first) % s.per_bin * s.length, s.length))
                large[bin_no] = large.get(bin_no, 0) + (s.length > capacity // 3)
        assert len(seen) == sum(counts.values()) and set(fill) == set(range(sequences))
        for places in fill.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= capacity
        assert max(large.values()) <= 2
        assert sequences <= 1.01 * plain_best_fit(counts, capacity) + 1


def plain_best_fit(counts, capacity):
    gaps = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fitting = [g for g in gaps if g >= n]
        if fitting:
            gaps.remove(min(fitting))
        gaps.append((min(fitting) if fitting else capacity) - n)
    return len(gaps)


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)]
    assert packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]
