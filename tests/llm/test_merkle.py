"""The manifest against trees written out in plain Python."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartweave.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string, at long, Leaf string, _group string, block int, trail string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, i):
    for level in tree[:-1]:
        s = i // 16 * 16
        yield level[s:i], level[i + 1 : s + 16]
        i //= 16


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = {s: levels([leaf(r, r[4]) for r in groups[s]]) for s in order}
    above = levels([trees[s][-1][0] for s in order])
    out = []
    for j, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            now, proof = leaf(r, r[4].translate(LOW) if hit else r[4]), []
            for left, right in [*siblings(trees[s], i), *siblings(above, j)]:
                now, proof = h(*left, now, *right), [*proof, *left, *right]
            out.append((s, r[0], trees[s][0][i], trees[s][-1][0], above[-1][0], h(*proof), now, now == above[-1][0]))
    return sorted(out, key=repr)


def found(docs):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    manifest = merkle.build(merkle.document_leaves(docs, tampered))
    return sorted(map(tuple, merkle.fold(manifest).collect()), key=repr), manifest


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash", "g", 1, "t") for r in rows], DOCS)


def test_states_equal_the_library():
    rng = np.random.default_rng(2)
    children = rng.integers(0, 256, (40, 32), dtype=np.uint8)
    starts, counts = np.array([0, 16, 17, 33]), np.array([16, 1, 16, 7])
    blocks = merkle._message(merkle._words(children.tobytes()))
    parents, before = merkle.hash_runs(blocks, starts, counts)
    for k, (s, c) in enumerate(zip(starts, counts, strict=True)):
        assert merkle._raw(parents)[k].tobytes().hex() == h(*(x.tobytes().hex() for x in children[s : s + c]))
    other = rng.integers(0, 256, (40, 32), dtype=np.uint8)
    run = np.repeat(np.arange(4), counts)
    folded = merkle.resume(before, merkle._words(other.tobytes()), blocks, np.arange(40) + 1, (starts + counts)[run], counts[run])
    for i in range(40):
        own = [(other[j] if j == i else children[j]).tobytes().hex() for j in range(starts[run[i]], starts[run[i]] + counts[run[i]])]
        assert merkle._raw(folded)[i].tobytes().hex() == h(*own)
    assert merkle._START[0] == 0x6A09E667 and merkle._ROUND[0] == 0x428A2F98 and merkle._ROUND[63] == 0xC67178F2


def test_odd_rows_equal_brute_force(spark):
    rows = [(i, None if i % 7 == 0 else f"s{i % 3}", "de" if i % 2 else None, i if i % 5 else None, [None, "", "ÄB c", "X" * 9000][i % 4]) for i in range(70)]
    rows += [rows[3], rows[3], rows[12], (None, "s1", None, None, None), (None, "s1", None, None, None), (None, "s1", "a", 1, "B"), (5, "é", "a", 1, "B"), (6, "z", "a", 1, "B"), (7, "Z", "a", 1, "B"), (-8, "s1", "a", 1, "B")]
    got, manifest = found(table(spark, rows).repartition(3))
    assert got == brute(rows) and any(not r[-1] for r in got)
    manifest.delete()


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [256], [257], [4097, 1], [272, 300, 3, 1]])
def test_sizes_of_groups(spark, sizes):
    rows = [(i, f"g{k}", "x", 1, f"Text {i}") for k, n in enumerate(sizes) for i in range(n)]
    got, manifest = found(table(spark, rows).repartition(4))
    assert got == brute(rows)
    assert len(manifest.rows.passes) == (1 if max(sizes) <= 256 else 2)


def test_many_groups(spark):
    rows = [(i, f"g{i % 600}", "x", 1, "T") for i in range(700)]
    assert found(table(spark, rows))[0] == brute(rows)


def test_equal_rows_are_leaves_of_their_own(spark):
    rows = [(4, "s", "x", 1, "Same Text")] * 900 + [(5, "s", "x", 1, "Other")]
    assert found(table(spark, rows).repartition(5))[0] == brute(rows)


def test_empty_table(spark):
    got, manifest = found(table(spark, []))
    assert got == [] and manifest.root is None


def test_a_block_holds_a_bounded_number_of_nodes(spark):
    rows = [(i, "hot", "x", 1, "T") for i in range(2000)]
    _, manifest = found(table(spark, rows))
    low, high = (p.select("n", "block", F.size("ids").alias("k")).collect() for p in manifest.rows.passes)
    assert sorted(r.k for r in low) == [208, *[256] * 7] and [(r.n, r.k) for r in high] == [(8, 8)]
