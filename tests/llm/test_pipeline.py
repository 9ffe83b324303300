"""Each stage of the pipeline against brute force on a small corpus."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

import corpus_pipeline as cp
from lattica.llm import compression
from lattica.llm.queries import fold

DOCS = "doc_id long, text string, lang string, source string, n_chars long, copies string, rk double"
LAST = 1 << 63


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice("the of ant bee cat dog éel fox".split()) + str(r.randrange(90)) for _ in range(n))


def changed(text, at):
    w = text.split()
    w[at] = "changed"
    return " ".join(w)


def upper(text):
    return "".join(c.upper() if c.isascii() else c for c in text)


ITEM = prose(25, 900)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Clean, toxic and contaminated documents, copies, personal data, nulls, repeated rows, clashing columns."""
    rows = []

    def add(text, i=None):
        i = len(rows) if i is None else i
        rows.append((i, text, "en", f"s{len(rows) % 4}" if len(rows) % 7 else None, 1, "x", 0.5))
        return i

    clean = [add(prose(120, i)) for i in range(150)]
    toxic = [add(" ".join(w + (" dreadful" if k % 9 == 0 else "") for k, w in enumerate(prose(120, 200 + i).split()))) for i in range(75)]
    copies = [add(rows[3][1]), add(changed(rows[4][1], 60)), add(changed(rows[5][1], 2)), add(upper(rows[6][1]))]
    hits = [add(prose(40, 901) + " " + ITEM + " " + prose(40, 902)), add(" ".join(upper(ITEM).split()[5:15]))]
    personal = [add("write jo.1@mail.example.com or JO.1@MAIL.EXAMPLE.COM " + prose(50, 903)), add("ip 10.0.0.7 card 4111 1111 1111 1111 " + prose(50, 904))]
    add(None), add(""), add("one"), add(prose(6000, 905))
    rows += [rows[8], (9, prose(80, 906), "en", "s1", 1, "x", 0.5)]
    rows += [(None, t, None, None, None, None, None) for t in (prose(90, 907), prose(90, 907), prose(90, 908), rows[10][1])]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{at}/documents.parquet")
    marks = [(i, 1, int(i in toxic)) for i in clean + toxic]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "!!")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, {"toxic": set(toxic), "copies": set(copies), "hits": set(hits), "personal": set(personal), "clean": set(clean)}


def body(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir[0]}/documents.parquet")


def test_stages_in_order(spark, sf_dir, docs):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "mixing"]
    for _, stage in cp.STAGES[:-1]:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, sf_dir[0])
            assert out.columns == cp.COLUMNS
            assert out.dtypes == docs.select(cp.COLUMNS).dtypes
    assert stage(spark, docs.limit(0), sf_dir[0]).count() == 0
    assert cp.mix(spark, docs.limit(0), sf_dir[0]).count() == 0


def test_toxicity(spark, sf_dir, docs):
    model = compression.fit(docs, spark.read.parquet(f"{sf_dir[0]}/labels.parquet"), "toxic", fold(3) != 1, compression.Toxicity)
    got = body(cp.toxicity(spark, docs, sf_dir[0]))
    assert got == [(i, t) for i, t in body(docs) if model.score([(t or "").encode()])[0] < 0.7]
    kept = {i for i, _ in got}
    assert not kept & sf_dir[1]["toxic"] and sf_dir[1]["clean"] <= kept


def test_near_dedup(spark, sf_dir, docs):
    rows = body(docs)
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset() for w in ((t or "").encode().lower().split() for _, t in rows)]
    group = list(range(len(rows)))
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if group[a] != group[b] and len(x & y) >= 0.8 * len(x | y):
                group = [group[b] if g == group[a] else g for g in group]
    members = defaultdict(set)
    for g, r in zip(group, rows, strict=True):
        members[g].add(r)
    order = lambda r: LAST if r[0] is None else r[0]
    got = body(cp.near_dedup(spark, docs, sf_dir[0]))
    assert len(got) == len(set(got)) == len(members)
    for m in members.values():
        (own,) = m & set(got)
        assert order(own) == min(map(order, m))
    kept = {i for i, _ in got}
    assert not kept & sf_dir[1]["copies"] and sf_dir[1]["clean"] <= kept
    assert sum(i == 8 for i, _ in got) == 1 and sum(i == 9 for i, _ in got) == 2
    assert sorted(t for i, t in got if i is None) == sorted([prose(90, 907), prose(90, 908)])


def test_decontamination(spark, sf_dir, docs):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    item = split(ITEM)
    windows = {tuple(item[k : k + 10]) for k in range(len(item) - 9)}
    hit = lambda t: any(tuple(w[k : k + 10]) in windows for w in [split(t)] for k in range(len(w) - 9))
    got = body(cp.decontamination(spark, docs, sf_dir[0]))
    assert got == [r for r in body(docs) if not hit(r[1])]
    assert {i for i, _ in body(docs)} - {i for i, _ in got} == sf_dir[1]["hits"]


def test_pii(spark, sf_dir, docs):
    pattern = re.compile(r"[\w.]+@[\w.]+\w|\d{1,3}(?:\.\d{1,3}){3}|\d{4}(?: ?\d{4}){3}")
    before, after = body(docs), body(cp.surrogate_pii(spark, docs, sf_dir[0]))
    assert [i for i, _ in before] == [i for i, _ in after]
    was = {pattern.sub("", t or "") for i, t in before if i in sf_dir[1]["personal"]}
    now = {pattern.sub("", t or "") for i, t in after if i in sf_dir[1]["personal"]}
    assert was == now
    for i in sf_dir[1]["personal"]:
        (old,), (new,) = [t for k, t in before if k == i], [t for k, t in after if k == i]
        assert not {m[0].lower() for m in pattern.finditer(old)} & {m[0].lower() for m in pattern.finditer(new)}
    rest = lambda rows: [r for r in rows if r[0] not in sf_dir[1]["personal"]]
    assert rest(before) == rest(after)


def test_mix(spark, sf_dir, docs):
    """On rows of distinct ids; all documents stand in one queue, by virtual finish time."""
    given = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).cache()
    rows = [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")), hashlib.md5((r["text"] or "").encode()).hexdigest()) for r in given.collect()]
    names = sorted({s for _, s, *_ in rows if s is not None}) + [None]
    own, queue, budget = defaultdict(list), [], sum(n for *_, n, _ in rows)
    for i, s, n, text in rows:
        own[s].append((hashlib.md5(f"mix:{i}:{text}".encode()).hexdigest(), i, n))
    for k, s in enumerate(names):
        total, end = sum(n for *_, n in own[s]), 0
        for digest, i, n in sorted(own[s]):
            end += n
            queue += [((e * total + end) / (k % 3 + 1), k + 1, digest, i, end, n) for e in range(3)]
    want, used = defaultdict(int), 0
    for *_, i, _, n in sorted(queue):
        used += n
        if used > budget:
            break
        want[i] += n > 0
    out = cp.mix(spark, given, sf_dir[0]).collect()
    assert {r["doc_id"]: r["copies"] for r in out} == {i: c for i, c in want.items() if c}
    given.unpersist()


def test_run(spark, sf_dir):
    got = cp.run(spark, sf_dir[0])
    assert got.columns == [*cp.COLUMNS, "copies"]
    rows = sorted(map(repr, got.collect()))
    ids = {r["doc_id"] for r in got.collect()}
    assert not ids & (sf_dir[1]["toxic"] | sf_dir[1]["copies"] | sf_dir[1]["hits"])
    assert "jo.1@mail" not in "".join(rows).lower()
    assert rows == sorted(map(repr, cp.run(spark, sf_dir[0]).collect()))
