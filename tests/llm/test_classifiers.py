import random

import numpy as np
import pyarrow as pa
import pytest

from cadenza.llm import langid, licenses, toxicity
from cadenza.llm.sampling import fold
from tests.llm.helpers import AWKWARD, awkward, empty


def corpus(n, seed=0):
    rng = random.Random(seed)
    syllables = {"en": "th er on an re he in ed nd ha".split(), "fr": "eau ou ai ez que les ent une ion ré".split(), "de": "sch ung ich ein der ver zu ge keit ä".split()}
    rows = []
    for i in range(n):
        lang = rng.choice(list(syllables))
        toxic = rng.random() < 0.3
        words = ["".join(rng.choices(syllables[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(20, 80))]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zorp", "blarg", "fnord"]))
        rows.append((i, " ".join(words), lang, "s", 0, int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus(900)
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], 1, r[5]) for r in rows], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_languages_of_held_out_rows(spark, tables):
    rows, docs, _ = tables
    model = langid.train(docs, sample_rows=100)
    found = {r["doc_id"]: r for r in langid.identify_rows(docs, model).where(fold("doc_id") == 0).collect()}
    truth = {r[0]: r[2] for r in rows}
    assert np.mean([found[i]["lang_pred"] == truth[i] for i in found]) > 0.97
    assert all(0 <= r["lang_score"] <= 1 for r in found.values())


def test_code_switched_words_get_their_own_language(spark, tables):
    rows, _, _ = tables
    model = langid.fit([r[1] for r in rows[:300]], [r[2] for r in rows[:300]])
    french = next(r[1] for r in rows[300:] if r[2] == "fr").split()[:20]
    german = next(r[1] for r in rows[300:] if r[2] == "de").split()[:20]
    p = langid.marginals(model.emissions(french + german), np.array([0, 40]), model.transitions, model.start)
    best = [model.langs[i] for i in p.argmax(axis=1)]
    assert best[:17].count("fr") >= 16 and best[23:].count("de") >= 16


def test_marginals_match_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    scores, move, start = rng.normal(size=(6, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    offsets = np.array([0, 0, 2, 6])
    found = langid.marginals(scores, offsets, move, start)
    for s, e in ((0, 2), (2, 6)):
        weight = np.zeros((e - s, 3))
        for path in product(range(3), repeat=e - s):
            total = start[path[0]] + sum(scores[s + t, c] for t, c in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:]))
            for t, c in enumerate(path):
                weight[t, c] += np.exp(total)
        assert np.allclose(found[s:e], weight / weight.sum(axis=1, keepdims=True))


def test_marginals_of_long_sequences_match_the_plain_recursion():
    rng = np.random.default_rng(1)
    scores, move, start = rng.normal(size=(500, 4)) * 5, rng.normal(size=(4, 4)), rng.normal(size=4)
    offsets = np.array([0, 1, 33, 65, 500])
    found = langid.marginals(scores, offsets, move, start)
    for s, e in zip(offsets, offsets[1:]):
        alpha, beta, _ = langid._forward_backward(scores[None, s:e], move, start)
        plain = (alpha * beta)[0]
        assert np.allclose(found[s:e], plain / plain.sum(axis=1, keepdims=True), atol=1e-9)


def test_language_of_awkward_rows(spark, tables):
    _, docs, _ = tables
    model = langid.train(docs, sample_rows=50)
    found = langid.identify_rows(awkward(spark, True), model).collect()
    assert len(found) == len(AWKWARD)
    for r in found:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["lang_score"] <= 1
    assert langid.identify_rows(empty(spark), model).count() == 0
    nothing = langid.train(empty(spark))
    assert {r["lang_pred"] for r in langid.identify_rows(awkward(spark), nothing).collect()} == {"und"}


def test_toxic_rows_of_the_held_out_fold(spark, tables):
    rows, docs, labels = tables
    model = toxicity.train(docs, labels, sample_rows=400)
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).where(fold("doc_id") == 0).collect()}
    truth = {r[0]: r[5] for r in rows}
    assert np.mean([(found[i] >= 0.5) == bool(truth[i]) for i in found]) > 0.95


def test_toxicity_of_awkward_rows(spark, tables):
    _, docs, labels = tables
    model = toxicity.train(docs, labels, sample_rows=200)
    found = toxicity.score_rows(awkward(spark, True), model).collect()
    assert len(found) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in found)
    assert {r["score"] for r in found if not (r["text"] or "").strip()} == {model.base_rate}
    assert toxicity.score_rows(empty(spark), model).count() == 0
    alone = toxicity.train(docs, labels.where("toxic = 0"))
    assert max(r["score"] for r in toxicity.score(docs, alone).collect()) < 0.5
    none = toxicity.train(empty(spark), labels)
    assert toxicity.score(docs, none).count() == docs.count()


@pytest.mark.parametrize("sigmas", [0.0, 2.0])
def test_class_probabilities_match_slow_ones_and_sum_to_one(sigmas):
    rows = corpus(60, 4)
    texts, y = [r[1] for r in rows], [r[5] for r in rows]
    families = np.arange(len(texts)) // 2  # pairs of texts count as copies
    model = toxicity._count(texts, np.array(y), families).model(sigmas)
    vocabulary = ["?", *model.vocabulary]
    told = [[w if w in model.vocabulary else "?" for w in t.split()] for t in texts]
    words, pairs = [{}, {}], [{}, {}]
    for t, c, f in zip(told, y, families, strict=True):
        for h, w in zip(["?", *t], t):
            words[c].setdefault(w, set()).add(f)
            pairs[c].setdefault((h, w), set()).add(f)
    n = [{w: len(words[c].get(w, ())) for w in vocabulary} for c in (0, 1)]
    m = [{p: len(pairs[c].get(p, ())) for p in {*pairs[0], *pairs[1]}} for c in (0, 1)]

    def lift(count, expected):
        apart = count - expected
        less = max(abs(apart) - sigmas * (expected + 0.5) ** 0.5, 0) * (1 if apart > 0 else -1)
        return (max(expected + less, 0) + 0.5) / (expected + 0.5)

    everything = sum(sum(x.values()) for x in n)
    own = [{w: 1.0 if w == "?" else lift(n[c][w], sum(n[c].values()) * (n[0][w] + n[1][w]) / everything) for w in vocabulary} for c in (0, 1)]
    heads = {w: sum(1 for _, v in m[0] if v == w) + 0.5 for w in vocabulary}
    shared = {w: x / sum(heads.values()) for w, x in heads.items()}

    def after(c, h):
        follow = {w: m[0][g, w] + m[1][g, w] for g, w in m[0] if g == h and h != "?"}
        total = sum(follow.values())
        weight = {w: shared[w] * own[c][w] * (toxicity.DISCOUNT * len(follow) / total if follow else 1) for w in vocabulary}
        for w, k in follow.items():
            at = [sum(m[d][h, v] for v in follow) * own[d][w] for d in (0, 1)]
            expected = at[c] * k / sum(at)
            weight[w] += (k - toxicity.DISCOUNT) / total * lift(m[c][h, w], expected) * own[c][w]
        return {w: x / sum(weight.values()) for w, x in weight.items()}

    for h in ["?", "zorp", told[0][0], told[1][1]]:
        found = np.exp([model.log_likelihoods(pa.array([f"{h} {w}" if h != "?" else w]))[0][:, -1] for w in vocabulary[1:]] + [model.log_likelihoods(pa.array([f"{h} unheardof" if h != "?" else "unheardof"]))[0][:, -1]])
        for c in (0, 1):
            slow = after(c, h)
            assert np.allclose(found[:, c], [slow[w] for w in [*vocabulary[1:], "?"]]) and found[:, c].sum() == pytest.approx(1)


def test_what_executors_hold_gives_the_same_scores():
    rows = corpus(300, 6)
    model = toxicity.fit([r[1] for r in rows], np.array([r[5] for r in rows]), 0.3)
    texts = pa.array([r[1] for r in corpus(200, 7)] + [""], pa.large_string())
    assert len(model.slim().pairs) < len(model.pairs) and np.allclose(model.slim().score(texts), model.score(texts), rtol=1e-9)


def test_equal_texts_tie_and_repeats_stay(spark, tables):
    _, docs, labels = tables
    model = toxicity.train(docs, labels, sample_rows=200)
    model.slope = model.shift = 0.0  # everything scores one half
    twice = docs.limit(20).unionAll(docs.limit(20))
    found = toxicity.score(twice, model).collect()
    assert len(found) == 40 and {r["score"] for r in found} == {0.5}


def test_near_copies_share_a_family():
    base = " ".join(f"w{i}" for i in range(200))
    other = " ".join(f"v{i}" for i in range(200))
    a, b, c = toxicity._families([base, base.replace("w50 ", "x "), other])
    assert a == b != c


@pytest.fixture(scope="module")
def scanner():
    return licenses.fit([r[1] for r in corpus(200, 2)])


def test_templates_and_damaged_templates_are_recognised(scanner):
    hits = total = 0
    for family, templates in licenses.TEMPLATES.items():
        for template in templates:
            words = template.split()
            for text in (template, template.upper(), " ".join(words[: len(words) // 2] + words[len(words) // 2 + 1 :]) if len(words) > 8 else template):
                total += 1
                hits += family in [f[1] for f in scanner.scan(pa.array(["plain words here\n" + text + "\nmore"], pa.large_string()))[0]]
    assert hits / total > 0.9


def test_prose_and_shuffled_licence_words_are_unknown(scanner):
    rng = random.Random(1)
    pool = [w for ts in licenses.TEMPLATES.values() for t in ts for w in t.split()]
    texts = [" ".join(rng.choices(pool, k=25)) for _ in range(100)] + [r[1] for r in corpus(100, 9)] + ["the license of the driver was lost", ""]
    assert sum(bool(f) for f in scanner.scan(pa.array(texts, pa.large_string()))) <= 3


def test_a_licence_inside_a_long_line_is_found(scanner):
    prose = " ".join(r[1] for r in corpus(20, 5))
    for at in (0, 37, 200):
        words = prose.split()
        text = " ".join(words[:at] + licenses.TEMPLATES["mit"][2].split() + words[at:])
        assert "mit" in [f[1] for f in scanner.scan(pa.array([text], pa.large_string()))[0]]


def test_wrapped_notices_are_seen_whole(scanner):
    rng = random.Random(3)
    prose = [r[1].split() for r in corpus(60, 8)]
    hits = total = 0
    for family, templates in licenses.TEMPLATES.items():
        for template in templates:
            words = [w for k, w in enumerate(template.split()) if k % 12 != 5]  # one word in twelve is lost
            width = rng.choice([3, 6, 10])
            wrapped = "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))
            text = "\n".join(" ".join(p[:30]) for p in rng.sample(prose, 3)) + "\n\n" + wrapped + "\n\n" + " ".join(rng.choice(prose))
            found = scanner.scan(pa.array([text], pa.large_string()))[0]
            total += 1
            hits += family in [f[1] for f in found]
            assert len({f[1] for f in found}) == len(found)  # one report of a notice, not one for each window
    assert hits / total > 0.9


def test_licences_of_awkward_rows(spark, scanner):
    found = licenses.scan_rows(awkward(spark, True), scanner).collect()
    assert len(found) == len(AWKWARD) and all(r["licenses"] == [] for r in found)
    assert licenses.scan_rows(empty(spark), scanner).count() == 0
    assert licenses.train(empty(spark)).families[-1] == licenses.UNKNOWN
