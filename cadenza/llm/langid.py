"""Language identification by a linear-chain conditional random field over words.

Each word's emission score sums learned weights of its character n-grams (those that touch either
end are its affixes) and of the lexicons it belongs to; learned transition weights join the words.
Forward-backward gives every word's language probabilities, so that code-switched stretches get
their own; a document's scores are the means over its words.

Training: at most ``SAMPLE_ROWS`` rows of each language, chosen by a hash of their id. Its sequences
switch between rows of different languages, as rows carry one label each and would otherwise teach
the field that languages never change.
"""

from __future__ import annotations

import pickle
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.arrowtext import encode_words, held, segment_sum, slices, texts_of
from cadenza.llm.sampling import fold, texts_of_ids

SAMPLE_ROWS = 300
LEXICON_WORDS = 2000
BUCKETS = 1 << 16
SEQUENCES = 3000
SEQUENCE_WORDS = 64
SWITCH = 1 / 16
STEPS = 60
UNKNOWN = "und"
#: Distinct words whose scores a worker remembers; a bound on memory only.
MEMO = 200_000
_BLOCK = 32


def clean(word: str) -> str:
    """The letters of a token in lower case."""
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, number of the word it belongs to), n from 1 to 4, ends marked."""
    text = "".join(f"\x02{w}\x03" for w in words)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.cumsum(chars == 2) - 1
    edge = (chars == 2) | (chars == 3)
    found, owner = [], []
    for n in range(1, 5):
        m = len(chars) - n + 1
        if m <= 0:
            break
        hashed = np.full(m, n, np.uint64)
        touches = np.zeros(m, bool)
        for k in range(n):
            hashed = (hashed * np.uint64(0x9E3779B97F4A7C15)) ^ (chars[k : k + m] * np.uint64(0xC2B2AE3D27D4EB4F))
            touches |= edge[k : k + m]
        ok = word[:m] == word[n - 1 :]
        ok &= ~touches if n == 1 else (touches if n == 4 else True)
        hashed = (hashed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
        found.append(hashed[ok].astype(np.int64))
        owner.append(word[:m][ok])
    return np.concatenate(found), np.concatenate(owner)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (BUCKETS, L)
    lexicon: dict[str, int]  # bit l: common in language l
    lexicon_weights: np.ndarray  # (L, L)
    transitions: np.ndarray  # (L, L) scores
    start: np.ndarray  # (L,)
    memo: dict[str, int] = field(default_factory=dict)
    rows: list[np.ndarray] = field(default_factory=list)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of distinct cleaned words, shape (n, L)."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        at = np.fromiter((self.memo.get(w, -1) for w in words), np.int64, len(words))
        table = np.concatenate(self.rows) if len(self.rows) > 1 else (self.rows[0] if self.rows else np.zeros((0, len(self.langs)), np.float32))
        self.rows = [table]
        known = at >= 0
        out[known] = table[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            fresh = self._score([words[i] for i in new.tolist()])
            out[new] = fresh
            if len(self.memo) < MEMO:
                self.memo.update((words[i], len(table) + k) for k, i in enumerate(new.tolist()))
                self.rows.append(fresh)
        return out

    def _score(self, words: list[str]) -> np.ndarray:
        bucket, owner = grams(words)
        order = np.argsort(owner, kind="stable")
        bounds = np.searchsorted(owner[order], np.arange(len(words) + 1))
        sums = np.stack([segment_sum(self.weights[bucket[order], c], bounds) for c in range(len(self.langs))], axis=1)
        bits = np.fromiter((self.lexicon.get(w, 0) for w in words), np.int64, len(words))
        member = (bits[:, None] >> np.arange(len(self.langs))) & 1
        return (sums + member @ self.lexicon_weights).astype(np.float32)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        codes, offsets, raw = encode_words(pc.utf8_split_whitespace(pc.utf8_lower(texts)))
        words = [clean(w) for w in raw]
        has = np.fromiter(map(bool, words), bool, len(words))
        names = list(dict.fromkeys(w for w in words if w))
        place = {w: i for i, w in enumerate(names)}
        ids = np.fromiter((place.get(w, -1) for w in words), np.int64, len(words))
        keep = has[codes] if len(codes) else np.zeros(0, bool)
        ids, offsets = (ids[codes] if len(codes) else codes)[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]
        n = np.diff(offsets)
        if not len(ids) or not self.langs:
            return [UNKNOWN] * len(n), np.zeros(len(n))
        posterior = marginals(self.emissions(names)[ids], offsets, self.transitions, self.start)
        means = np.stack([segment_sum(posterior[:, c], offsets) for c in range(len(self.langs))], axis=1) / np.maximum(n, 1)[:, None]
        best = means.argmax(axis=1)
        langs = [self.langs[b] if m else UNKNOWN for b, m in zip(best.tolist(), n.tolist(), strict=True)]
        return langs, np.where(n > 0, np.clip(means.max(axis=1), 0, 1), 0.0)


def marginals(scores: np.ndarray, offsets: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Posterior state probabilities of each position of each sequence.

    Forward-backward in blocks: each block's transfer matrix first, then messages from block to
    block, then positions within all blocks side by side. A sequence of any length costs as many
    steps as it has blocks.
    """
    n, size = np.diff(offsets), scores.shape[1]
    blocks = -(-n // _BLOCK)
    base = np.cumsum(blocks) - blocks
    position = np.arange(len(scores)) - np.repeat(offsets[:-1], n)
    block, inner = np.repeat(base, n) + position // _BLOCK, position % _BLOCK
    total = int(blocks.sum())
    emit = np.ones((_BLOCK, total, size))
    emit[inner, block] = np.exp(scores - scores.max(axis=1, keepdims=True))
    real = np.zeros((_BLOCK, total), bool)
    real[inner, block] = True
    move = np.exp(transitions - transitions.max())
    # transfer[b]: row i to column j over the block, entering from state i before it
    transfer = np.tile(np.eye(size), (total, 1, 1))
    for t in range(_BLOCK):
        live = real[t]
        step = (transfer[live] @ move) * emit[t][live][:, None, :]
        transfer[live] = step / step.max(axis=(1, 2), keepdims=True)
    first = np.exp(start - start.max())
    first = np.linalg.lstsq(move.T, first, rcond=None)[0] if size > 1 else first / move[0, 0]
    into = np.zeros((total, size))
    after = np.ones((total, size))
    longest = int(blocks.max())
    order = np.argsort(-blocks, kind="stable")
    counts = np.searchsorted(-blocks[order], -np.arange(longest + 1), side="left")  # sequences with more than k blocks
    message = np.tile(first, (len(n), 1))
    for k in range(longest):
        live = order[: counts[k]]
        at = base[live] + k
        into[at] = message[live]
        forward = np.einsum("bi,bij->bj", message[live], transfer[at])
        message[live] = forward / np.abs(forward).max(axis=1, keepdims=True)
    back = np.ones((len(n), size))
    for k in range(longest - 1, -1, -1):
        live = order[: counts[k]]
        at = base[live] + k
        after[at] = back[live]
        backward = np.einsum("bij,bj->bi", transfer[at], back[live])
        back[live] = backward / np.abs(backward).max(axis=1, keepdims=True)
    alpha = np.zeros((_BLOCK, total, size))
    state = into
    for t in range(_BLOCK):
        step = (state @ move) * emit[t]
        step = step / np.maximum(np.abs(step).max(axis=1, keepdims=True), 1e-300)
        state = np.where(real[t][:, None], step, state)
        alpha[t] = state
    beta = after
    out = np.zeros((_BLOCK, total, size))
    for t in range(_BLOCK - 1, -1, -1):
        out[t] = alpha[t] * beta
        step = (emit[t] * beta) @ move.T
        step = step / np.maximum(step.max(axis=1, keepdims=True), 1e-300)
        beta = np.where(real[t][:, None], step, beta)
    found = np.maximum(out[inner, block], 0)
    return found / np.maximum(found.sum(axis=1, keepdims=True), 1e-300)


def fit(texts: list[str], labels: list[str], seed: int = 0) -> Model:
    """Learn from texts and their languages; deterministic for equal inputs."""
    langs = sorted(set(labels))
    size, rng = len(langs), np.random.default_rng(seed)
    words_of: list[list[list[str]]] = [[] for _ in langs]
    for text, label in zip(texts, labels, strict=True):
        words = [w for w in map(clean, (text or "").lower().split()) if w]
        if words:
            words_of[langs.index(label)].append(words)
    lexicon: dict[str, int] = {}
    for c, rows in enumerate(words_of):
        spread = Counter(w for row in rows for w in set(row))
        for w, k in sorted(spread.items(), key=lambda x: (-x[1], x[0]))[:LEXICON_WORDS]:
            if k > 1:
                lexicon[w] = lexicon.get(w, 0) | 1 << c
    usable = [c for c in range(size) if words_of[c]]
    model = Model(langs, np.zeros((BUCKETS, size)), lexicon, np.zeros((size, size)), np.zeros((size, size)), np.zeros(size))
    if len(usable) < 2:
        return model
    sequences, states = [], []
    for _ in range(SEQUENCES):
        words, tags = [], []
        while len(words) < SEQUENCE_WORDS:
            c = usable[rng.integers(len(usable))]
            row = words_of[c][rng.integers(len(words_of[c]))]
            take = min(int(rng.geometric(SWITCH)), SEQUENCE_WORDS - len(words), len(row))
            at = int(rng.integers(len(row) - take + 1))
            words += row[at : at + take]
            tags += [c] * take
        sequences.append(words)
        states.append(tags)
    names = {w: i for i, w in enumerate(dict.fromkeys(w for s in sequences for w in s))}
    ids = np.array([[names[w] for w in s] for s in sequences])
    truth = np.array(states)
    bucket, owner = grams(list(names))
    member = (np.array([lexicon.get(w, 0) for w in names])[:, None] >> np.arange(size)) & 1
    # in training a lexicon knows its own words too well; hide it from half of the sequences
    shown = (np.arange(len(ids)) % 2 == 0)[:, None]
    params = [model.weights, model.lexicon_weights, model.transitions, model.start]
    squares = [np.full_like(p, 1e-8) for p in params]
    at = np.arange(size)
    offsets = np.arange(0, ids.size + 1, ids.shape[1])
    for _ in range(STEPS):
        by_word = np.stack([np.bincount(owner, model.weights[bucket, c], minlength=len(names)) for c in range(size)], axis=1)
        emit = by_word[ids] + np.where(shown[..., None], (member @ model.lexicon_weights)[ids], 0.0)
        alpha, beta, norm = _forward_backward(emit, model.transitions, model.start)
        posterior = alpha * beta
        posterior /= posterior.sum(axis=2, keepdims=True)
        error = (truth[..., None] == at) - posterior  # (S, T, L)
        pair = alpha[:, :-1, :, None] * np.exp(model.transitions) * (np.exp(emit[:, 1:] - norm[:, 1:, None]) * beta[:, 1:])[:, :, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        observed = np.zeros((size, size))
        np.add.at(observed, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
        flat = error.reshape(-1, size)
        to_word = np.stack([np.bincount(ids.ravel(), flat[:, c], minlength=len(names)) for c in range(size)], axis=1)
        of_lexicon = np.stack([np.bincount(ids[shown[:, 0]].ravel(), error[shown[:, 0]].reshape(-1, size)[:, c], minlength=len(names)) for c in range(size)], axis=1)
        scale = 1 / len(offsets)
        gradients = [
            np.stack([np.bincount(bucket, to_word[owner, c], minlength=BUCKETS) for c in range(size)], axis=1) * scale - 1e-4 * model.weights,
            member.T @ of_lexicon * scale - 1e-4 * model.lexicon_weights,
            (observed - pair.sum(axis=(0, 1))) * scale - 1e-4 * model.transitions,
            error[:, 0].sum(axis=0) * scale - 1e-4 * model.start,
        ]
        for p, g, s in zip(params, gradients, squares, strict=True):
            s += g * g
            p += 0.3 * g / np.sqrt(s)
    model.weights = model.weights.astype(np.float32)
    return model


def _forward_backward(emit: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled messages of equally long sequences, and each position's largest score."""
    norm = emit.max(axis=2)
    e, move = np.exp(emit - norm[..., None]), np.exp(transitions)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = np.exp(start) * e[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, e.shape[1]):
        a = (alpha[:, t - 1] @ move) * e[:, t]
        alpha[:, t] = a / a.sum(axis=1, keepdims=True)
    for t in range(e.shape[1] - 2, -1, -1):
        b = (e[:, t + 1] * beta[:, t + 1]) @ move.T
        beta[:, t] = b / b.sum(axis=1, keepdims=True)
    return alpha, beta, norm


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", hold_out: int | None = 0) -> Model:
    """Fit on at most ``sample_rows`` rows of each language whose fold is not ``hold_out``; rows without language or id are left out."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    if hold_out is not None:
        known = known.where(fold(id_col) != hold_out)
    spark = docs.sparkSession
    counts = known.groupBy(F.col(lang_col).alias("known_lang")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per language
    shares = F.broadcast(spark.createDataFrame([(r["known_lang"], min(1.0, 3.0 * sample_rows / r["n"])) for r in counts], "known_lang string, share double"))
    # rows whose hash lies in a share that holds about three times the sample: no task sees a whole language
    place = (F.shiftrightunsigned(F.xxhash64(id_col), 11) / F.lit(2.0**53)).alias("place")
    near = known.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("known_lang"), place).join(shares, "known_lang").where("place < share")
    found: dict[str, dict[int, float]] = {}
    for r in near.select("known_lang", "id", "place").collect():  # some sample_rows a language
        found.setdefault(r["known_lang"], {})[r["id"]] = r["place"]
    chosen = {i: lang for lang, places in sorted(found.items()) for i in sorted(places, key=lambda i: (places[i], i))[:sample_rows]}
    ids = spark.createDataFrame(list(chosen.items()), f"`{id_col}` long, known_lang string")
    rows = texts_of_ids(docs, ids, id_col, text_col, "known_lang").collect()
    rows = sorted({r[0]: r for r in rows}.values(), key=lambda r: r[0])
    return fit([r[1] or "" for r in rows], [r[2] for r in rows])


def identify_rows(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``lang_pred`` and ``lang_score`` (columns of those names are replaced).

    Whole texts. Null texts and texts without a letter get ``und`` and score zero. Repeated rows
    stay; an empty table gives an empty result; ties go to the first language in order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    key = uuid.uuid4().hex
    source = docs.drop("lang_pred", "lang_score")
    names = source.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(key, lambda: pickle.loads(shared.value))
        for batch in slices(batches, text_col, 1 << 20):
            langs, score = model.predict(texts_of(batch, text_col))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "lang_score"])

    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]))
