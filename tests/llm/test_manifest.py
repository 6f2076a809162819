import zlib
from hashlib import sha256

import numpy as np
import pytest

from quotemill.llm import manifest
from quotemill.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def hashed(parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(doc_id, text, lang, source, n_chars):
    return hashed(map(field, (doc_id, source, lang, n_chars, text)))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([hashed(levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    out = []
    for nodes in levels[:-1]:
        start = i // 8 * 8
        out.append((nodes[start:i], nodes[i + 1 : start + 8]))
        i //= 8
    return out


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(*row[:5]), row[:5]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels_of([r[2] for r in sorted(groups[g], key=lambda r: r[:3])]) for g in order}
    top, out = levels_of([trees[g][-1][0] for g in order]), []
    for place, g in enumerate(order):
        for i, (_, _, leaf, row) in enumerate(sorted(groups[g], key=lambda r: r[:3])):
            path = siblings(trees[g], i) + siblings(top, place)
            now = leaf
            if row[0] is not None and row[1] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[1])
                now = leaf_of(row[0], lowered, *row[2:])
            for left, right in path:
                now = hashed([*left, now, *right])
            others = hashed([h for left, right in path for h in left + right])
            out.append((row[0], leaf, trees[g][-1][0], top[-1][0], others, now, now == top[-1][0]))
    return sorted(out, key=str)


def query(docs):
    rows = manifest.proofs(manifest.manifest(docs, changed=manifest.lowered_every_third))
    return sorted((tuple(r) for r in rows.select(COLUMNS).collect()), key=str)


def test_whole_query_equals_brute_force(spark, small, documents):
    got = QUERIES["op11_manifest"](spark, small)
    assert got.columns == COLUMNS
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in documents.collect()]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("height", [1, 4])
def test_odd_rows(make, spark, monkeypatch, height):
    """Null and repeated ids, null fields and groups, equal rows, one-row groups, many groups."""
    monkeypatch.setattr(manifest, "MOST_HEIGHT", height)
    rows = [(i, f"Text {i} É", "en", "s", i, "x") for i in range(600)]
    rows += [(None, "A", "en", None, None, "x"), (None, None, None, None, None, "x"), (3, "Text 3 É", "en", "s", 3, "y")]
    rows += [(3, "B", "en", "", 0, None), (7, "", None, "s", 1, None), (7, "", None, "s", 1, None)]
    rows += [(i, "T", f"l{i}é", "s", 1, "z") for i in range(700, 780)] + [(5, "w" * 300_000, "", "s", 1, None)]
    assert query(make(rows, SCHEMA)) == brute(rows)
    assert query(spark.createDataFrame([], SCHEMA)) == []
    assert query(make(rows[:1], SCHEMA)) == brute(rows[:1])


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_addresses_are_a_permutation_with_contiguous_subtrees(levels):
    places = [manifest.address(levels, d, np.arange(8**d)) for d in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range(manifest.tree_nodes(levels)))
    top = levels // 2
    if top:
        assert max(p.max() for p in places[:top]) == manifest.tree_nodes(top) - 1
        size = manifest.tree_nodes(levels - top)
        for tree in range(8**top):
            mine = [places[d][tree * 8 ** (d - top) : (tree + 1) * 8 ** (d - top)] for d in range(top, levels)]
            low = manifest.tree_nodes(top) + tree * size
            assert sorted(np.concatenate(mine).tolist()) == list(range(low, low + size))


def test_a_block_holds_its_tree():
    leaves = np.random.default_rng(1).integers(0, 256, (70, 32), dtype=np.uint8)
    tree = manifest.build_block(leaves, 3)
    names = [row.tobytes().hex() for row in leaves]
    levels = levels_of(names)
    assert len(levels) == 4 and tree[:32].hex() == levels[-1][0]
    for i, path in enumerate(manifest.block_paths(tree, 70, 3, ["l", "r"])):
        assert path == [x for pair in siblings(levels, i) for x in map("".join, pair)] + ["l", "r"]
        assert manifest.fold(names[i], path[:-2]) == levels[-1][0]
    assert manifest.block_paths(manifest.build_block(leaves[:1], 0), 1, 0, []) == [[]]


def test_places_within_groups(make):
    from quotemill.llm.common import ranked

    rows = [(i % 7 if i % 5 else None, i * 37 % 50, "t") for i in range(500)] + [(99, 1, "t")] * 300
    got = ranked(make(rows, "g long, o long, t string").coalesce(1), "g", ["o"], "test").collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r.pos, r.o))
    assert len(got) == len(rows)
    for found in by.values():
        assert [p for p, _ in sorted(found)] == list(range(len(found)))
        assert [o for _, o in sorted(found)] == sorted(o for _, o in found)
