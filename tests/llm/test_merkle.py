import hashlib
import zlib
from collections import defaultdict

import pytest

from hazardspark.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, add=0):
    row = (*row[:3], row[3] + add if row[3] is not None else None, row[4])
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, k):
    """The root, and each node's runs up to it: (place in the run, run)."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + k] for i in range(0, len(nodes), k)]
        for path, i in zip(paths, places, strict=True):
            path.append((i % k, runs[i // k]))
        places, nodes = [i // k for i in places], [H(*r) for r in runs]
    return nodes[0], paths


def brute(rows, k):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda v: (v is not None, (v or "").encode()))
    subs = {}
    for v in langs:
        by[v].sort(key=lambda r: (r[0] is not None, r[0], leaf(r)))
        subs[v] = tree([leaf(r) for r in by[v]], k)
    root, uppers = tree([subs[v][0] for v in langs], k)
    out = []
    for v, upper in zip(langs, uppers, strict=True):
        for r, path in zip(by[v], subs[v][1], strict=True):
            h = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)
            proof = ""
            for i, run in (*path, *upper):
                proof += "".join(run[:i] + run[i + 1 :])
                h = H(*run[:i], h, *run[i + 1 :])
            out.append((r[0], leaf(r), subs[v][0], root, H(proof), h, h == root))
    return sorted(out, key=repr)


def rows():
    out = [(i, f"s{i % 3}", ("en", "de", "é", None, "")[i % 5 if i % 2 else 0], i, "wörd " * (i % 7)) for i in range(150)]
    out += [(300, None, "solo", None, None), (None, None, None, None, None), (None, "a", "en", 3, ""), (301, "a", "en", -1, "x" * 300_000)]
    return out + [out[0]] * 40 + [(0, "other", "en", 0, "")]


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_equals_brute_force(spark, arity):
    docs = spark.createDataFrame(rows(), SCHEMA).selectExpr("*", "1 AS tree", "2 AS idx", "'x' AS digest", "3 AS size", "4 AS path").repartition(7)
    got = merkle.verified(*merkle.manifest(docs, arity)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows(), arity)
    assert not all(r.verified for r in got)


def test_small_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert merkle.verified(*merkle.manifest(none)).count() == 0
    one = [(7, "s", "en", 1, "a")]
    (r,) = merkle.verified(*merkle.manifest(spark.createDataFrame(one, SCHEMA))).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == H("") and tuple(r) == brute(one, 2)[0]


def test_repeated_rows_are_dealt_over_ranges(spark):
    docs = spark.createDataFrame([(1, "s", "en", 1, "a")] * 4000 + [(i, "s", "en", 1, "b") for i in range(2, 200)], SCHEMA)
    placed = merkle.numbered(merkle.leaves(docs), ["lang"], ["doc_id", "digest"]).orderBy("idx").collect()
    assert [r.idx for r in placed] == list(range(4198)) and {r.size for r in placed} == {4198}
    assert [r.doc_id for r in placed] == [1] * 4000 + list(range(2, 200))
