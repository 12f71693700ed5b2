"""The Merkle manifest against a recursive one, with proofs checked as a holder would."""

import hashlib
import zlib

import pytest

from lakeproof.llm.merkle import MerkleParams, dataset_manifest
from lakeproof.session import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root int, tree string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r, text):
    return H(*[field(x) for x in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)])


def tree(leaves):
    """The root, and for every leaf its (left, right) siblings from the leaf up."""
    paths, groups, nodes = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(nodes) > 1:
        up, over = [], []
        for a in range(0, len(nodes), 3):
            run = nodes[a : a + 3]
            for j in range(len(run)):
                for i in groups[a + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(H(*run))
            over.append([i for g in groups[a : a + 3] for i in g])
        nodes, groups = up, over
    return nodes[0], paths


def by_hand(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        own = sorted(by[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
        trees.append((own, *tree([leaf_of(r, r["text"]) for r in own])))
    root, over = tree([t[1] for t in trees])
    out = []
    for k, (own, sub, paths) in enumerate(trees):
        for r, path in zip(own, paths):
            even = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            folded = leaf_of(r, r["text"].replace("\n", "") if even and r["text"] is not None else r["text"])
            for a, b in path + over[k]:
                folded = H(a, folded, b)
            out.append((r["doc_id"], leaf_of(r, r["text"]), sub, root, H(*[a + b for a, b in path + over[k]]), folded, folded == root))
    return sorted(out, key=str)


def row(i, text, source, lang="en", n=1):
    return {"doc_id": i, "text": text, "lang": lang, "source": source, "n_chars": n, "leaf": "x", "root": 3, "tree": "y"}


ROWS = [row(i, f"line {i}\nnext ü{i}" if i % 3 else f"no break {i}", f"s{i % 4 if i % 7 else 0}") for i in range(150)]
ROWS += [row(1_000 + i, "one\n", f"Z{i}") for i in range(11)]  # many small sources
ROWS += [row(900, None, None), row(901, "", None), row(902, "\n\n", "", None, None), row(None, "a\nb", "s1"), row(None, "c\n", "s1"), row(5, "again", "s1"), row(5, "again", "s1"), row(-3, "x\ny" * 50_000, "é"), row(2**40, "x", "😀")]


@pytest.mark.parametrize("params", [MerkleParams(), MerkleParams(broadcast_runs=0), MerkleParams(broadcast_runs=12), MerkleParams(broadcast_sources=3, broadcast_runs=30)])
def test_by_hand(spark, params):
    """All ways of joining: broadcast, shuffled, both; few and many sources."""
    ship(spark)
    df = spark.createDataFrame([tuple(r[c] for c in SCHEMA.replace(",", "").split()[::2]) for r in ROWS], SCHEMA)
    out = dataset_manifest(df, params)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == by_hand(ROWS)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 28])
def test_sizes(spark, n):
    ship(spark)
    rows = [row(i, f"t\n{i}", "s") for i in range(n)]
    df = spark.createDataFrame([tuple(r[c] for c in SCHEMA.replace(",", "").split()[::2]) for r in rows], SCHEMA)
    assert sorted((tuple(r) for r in dataset_manifest(df).collect()), key=str) == (by_hand(rows) if n else [])
