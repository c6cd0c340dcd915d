import random
import re

import numpy as np
import pytest

from hazardspark.llm import jaccard as j


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    all_sets = [sets(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            x, y = all_sets[a], all_sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                up[top(a)] = top(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        t = top(i)
        ids = [x for x in (least.get(t), d) if x is not None]
        least[t] = min(ids) if ids else None
    return sorted(((d, len(s), least[top(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, all_sets, strict=True))), key=str)


def corpus(seed, groups=12, copies=14):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=40)
    rows = []
    for _ in range(groups):
        base = rng.choices(words, k=rng.choice([3, 5, 6, 8, 9, 12, 25, 40, 90, 200, 420]))
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 22))):
                t[rng.randrange(len(t))] = rng.choice(words)
            if rng.random() < 0.3:
                t = t[: rng.randint(max(1, int(len(t) * 0.7)), len(t))]
            rows.append((len(rows), " ".join(t)))
    for _ in range(40):
        rows.append((len(rows), " ".join(rng.choices(words, k=rng.randint(5, 40)) + passage)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, rows[0][1].upper()), (5004, rows[0][1]), (5004, rows[0][1]), (None, rows[1][1]), (None, "only here with no id at all"), (5005, "\x1c é É x y z"), (5006, "word " * 30_000), (5007, "word " * 7)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,size,chunk", [(1, 8 << 20, 8 << 20), (2, 9000, 3000)])
def test_equals_brute_force(spark, monkeypatch, seed, size, chunk):
    cut = j.blocks.with_blocks
    monkeypatch.setattr(j.blocks, "with_blocks", lambda d, carried=(): cut(d, size, carried))
    monkeypatch.setattr(j, "CHUNK", chunk)
    monkeypatch.setattr(j, "AT_ONCE", 4 * chunk)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS cls", "2 AS label", "3 AS block")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in j.components(docs).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("seed,chunk", [(1, 8 << 20), (2, 3000)])
def test_links_are_all_there(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(j, "CHUNK", chunk)
    rows = corpus(seed)
    classes = {j.class_of(j.shingles(t, j._Words())): sets(t) for _, t in rows if sets(t)}
    linked = {(a, b) for a, x in classes.items() for b, y in classes.items() if a < b and 100 * len(x & y) >= 75 * len(x | y)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found, got = j.links(docs)
    assert found.count() == len(rows)
    assert sorted((r.a, r.b) for r in got.collect()) == sorted(linked)


def chain(n):
    """Texts of which each is alike to its neighbours alone."""
    return [(i, " ".join(f"w{k}" for k in range(10 * i, 10 * i + 100))) for i in range(n)]


def test_a_chain_through_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(j, "CHUNK", 4000)
    rows = chain(60) + [(100 + i, t + " tail") for i, t in chain(60)[::7]]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in j.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows) and {c for *_, c in got} == {0}


def test_a_task_gives_no_more_links_than_rows():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    made = [np.unique(np.concatenate([np.delete(base, rng.integers(0, 200, 12)), rng.integers(0, 1 << 63, 12, dtype=np.uint64)])) for _ in range(400)]
    labels = np.arange(400)
    assert len(j.search(made, labels, np.arange(400))) <= 399
    assert len(j.search(made, np.arange(400), np.arange(400), every=True)) > 10_000


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert j.components(docs).count() == 0


def test_partners_share_as_many_as_they_need():
    rng, seen = np.random.default_rng(4), 0
    for _ in range(3000):
        size = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
        b = a.copy()
        for _ in range(int(rng.integers(0, size // 6 + 2))):
            b = np.delete(b, rng.integers(len(b))) if rng.random() < 0.5 and len(b) > 1 else np.unique(np.append(b, rng.integers(0, 1 << 63, dtype=np.uint64)))
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both):
            continue
        seen += 1
        held = []
        for v in (a, b):
            signed = j.Signed(v, np.array([len(v)]))
            weak = signed.need < 1
            found = {}
            for entry, (band, *_) in enumerate(j.bands(len(v))):
                mine = signed.entry == entry
                found[band] = max(1, int(signed.need[entry])), weak[entry], set(signed.sig[mine & ~signed.single].tolist()), set(signed.sig[mine & signed.single].tolist())
            held.append((found, signed, np.array([len(v)])))
        band = int(np.searchsorted(j.tops(), min(len(a), len(b))))
        (p, wa, s, ss), (q, wb, t, tt) = held[0][0][band], held[1][0][band]
        assert len(s & t) >= max(0 if wa else p, 0 if wb else q)
        assert not (wa and wb) or 100 * len(ss & tt) >= 75 * max(len(a), len(b))
        # what goes on meets, whatever is rare
        rare = lambda sig: sig % np.uint64(5)
        every = set(held[0][1].sig.tolist()) & set(held[1][1].sig.tolist())
        one, two = ({int(x) for x in h[1].sig[j.rarest(h[1], h[2], np.array([x in every for x in h[1].sig.tolist()], bool), rare(h[1].sig))]} for h in held)
        assert one & two
    assert seen > 500
