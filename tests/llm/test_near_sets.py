"""Near-duplicate groups of the pipeline against brute force on sets of shingles."""

import random

import numpy as np
import pytest

import corpus_pipeline as cp
from lattica.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, r):
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def groups(texts):
    """Each text's group, named by its smallest number: linked are all pairs at 0.8 or more."""
    sets, group = [shingles(t) for t in texts], list(range(len(texts)))
    for a in range(len(sets)):
        for b in range(a):
            if group[a] != group[b] and jaccard(sets[a], sets[b]) >= 0.8:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    return group


def near(spark, texts):
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    kept = sorted(r["doc_id"] for r in cp.near_dedup(spark, df, "").collect())
    return kept, df


@pytest.fixture(scope="module")
def varied():
    """Texts of 4 to 300 words, and for each some with a few of its words changed: similarities of 0.6 to 1."""
    r, out = random.Random(11), []
    for k in range(70):
        base = prose(r.choice([4, 8, 9, 30, 100, 300]) if k % 2 else 100, r)
        out.append(" ".join(base))
        for _ in range(3):
            w, n = list(base), len(base)
            for i in r.sample(range(n), max(1, round(n * r.uniform(0.012, 0.04)))):
                w[i] = f"x{r.randrange(10**6)}"
            out.append(" ".join(w))
        out.append(" ".join(base[:-1]))
    return out


def test_links_are_exact(spark, varied):
    sets = [shingles(t) for t in varied]
    close = [jaccard(a, b) for i, a in enumerate(sets) for b in sets[:i]]
    assert sum(0.8 <= x < 0.86 for x in close) > 20 and sum(0.7 < x < 0.8 for x in close) > 20
    assert near(spark, varied)[0] == sorted(set(groups(varied)))


def test_tiles_link_the_same(spark, varied, monkeypatch):
    monkeypatch.setattr(simhash, "SETS", 2)
    assert near(spark, varied)[0] == sorted(set(groups(varied)))


def test_repeated_shingles_count_once(spark):
    """A text pasted twice, a line said many times over, and texts that share only such a line."""
    r = random.Random(3)
    texts = [" ".join(prose(100, r)) for _ in range(4)]
    line = " ".join(prose(6, r))
    texts += [f"{texts[0]} {texts[0]}", " ".join([texts[1], *[line] * 3]), " ".join([texts[1], *[line] * 60])]
    texts += [" ".join([t, *["same"] * 300]) for t in (texts[2], " ".join(prose(90, r)))]
    want = sorted(set(groups(texts)))
    assert 4 not in want and 6 not in want and 8 in want
    assert near(spark, texts)[0] == want


def test_similar():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.choice(40, rng.integers(1, 40)).astype(np.uint64)) for _ in range(150)]
    sets += [np.unique(np.append(s[1:], np.uint64(99))) for s in sets[:60]]
    whole = simhash.similar(sets, np.zeros(len(sets), int), 0.8)
    want = np.arange(len(sets))
    for a in range(len(sets)):
        for b in range(a):
            if jaccard(set(sets[a].tolist()), set(sets[b].tolist())) >= 0.8:
                want[want == want[a]] = want[b]
    assert len(np.unique(whole)) < len(sets) - 20
    assert len(np.unique(np.stack([whole, want]), axis=1).T) == len(np.unique(whole)) == len(np.unique(want))
    tile = np.arange(len(sets)) % 2
    parts = [simhash.similar([sets[i] for i in range(t, len(sets), 2)], np.zeros(len(sets[t::2]), int), 0.8) * 2 + t for t in (0, 1)]
    a = np.concatenate([np.arange(0, len(sets), 2), np.arange(1, len(sets), 2), np.arange(len(sets))])
    joined = simhash.forest(len(sets), a, np.concatenate([*parts, simhash.similar(sets, tile, 0.8)]))
    assert (joined == whole).all()
