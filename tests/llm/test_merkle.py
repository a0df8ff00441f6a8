"""The Merkle manifest against trees built by hand."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.llm import merkle

from .test_operators import SCHEMA

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text):
    i, _, lang, source, n = row
    return sha("".join(map(enc, (i, source, lang, n, text))))


def grow(nodes):
    """Root, and of each node the list of (left, right) on its way up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, k in zip(paths, at, strict=True):
            lo = k - k % 3
            p.append(("".join(nodes[lo:k]), "".join(nodes[k + 1 : lo + 3])))
        nodes = [sha("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)]
        at = [k // 3 for k in at]
    return nodes[0], paths


def by_hand(rows):
    """doc_id, leaf, subroot, root, proof, folded, verified of every row (in the schema's order of columns)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    subroots, out = [], []
    for k in keys:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        root, paths = grow([leaf(r, r[1]) for r in groups[k]])
        subroots.append((root, paths))
    if not keys:
        return []
    root, above = grow([s for s, _ in subroots])
    for k, (sub, paths), up in zip(keys, subroots, above, strict=True):
        for r, p in zip(groups[k], paths, strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            now = leaf(r, r[1].replace("\n", "") if hit and r[1] is not None else r[1])
            for left, right in [*p, *up]:
                now = sha(left + now + right)
            out.append((r[0], leaf(r, r[1]), sub, root, sha("".join(a + b for a, b in [*p, *up])), now, now == root))
    return out


def result(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    df = merkle.op12_merkle_manifest(spark, str(tmp_path))
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, df.collect()), key=str)


def made(sizes, seed=1):
    r = random.Random(seed)
    rows, i = [], 0
    for s, n in enumerate(sizes):
        for _ in range(n):
            text = r.choice((None, "", "one line", "two\nlines", "é\n\n中", "x" * 40))
            rows.append((i, text, r.choice((None, "en", "")), None if s == 0 else f"s{'é' * (s % 3)}{s}", r.choice((None, i))))
            i += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [(1,), (0, 1), (2,), (3, 1), (4, 9, 10), (81, 1), (82, 3), (244, 27, 28)])
def test_trees_of_all_sizes(spark, tmp_path, sizes):
    rows = made(sizes)
    assert result(spark, rows, tmp_path) == sorted(by_hand(rows), key=str)


@pytest.mark.parametrize("levels", [1, 2])
def test_many_rounds(spark, tmp_path, monkeypatch, levels):
    """Chunks of 3 and of 9, so that trees and the tree of sources both take several rounds."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "CHUNK", 3**levels)
    rows = made((100, 28, *[1, 2] * 15))
    assert result(spark, rows, tmp_path) == sorted(by_hand(rows), key=str)


def test_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, "a\n", None, None, None), (1, "x\ny", "en", "s", 3), (1, "x\ny", "en", "s", 3), (1, "z", "en", "s", 1), (2, "\n" * 50_000, "", "", 0), (-5, "long " * 200_000, "en", "s", 10), ((1 << 63) - 1, "", "en", "s", -1)]
    assert result(spark, rows, tmp_path) == sorted(by_hand(rows), key=str)


def test_stored_preimages_hold_each_other(spark):
    """Every stored preimage's digest stands in its parent's preimage, and the topmost gives the root."""
    rows = made((90, 5))
    m = merkle.manifest(spark.createDataFrame(rows, SCHEMA))
    roots = {r.tree: r.root for r in m.groups.roots().collect()}
    stored = {(r.tree, r.level, r.idx): r.preimage for r in m.groups.preimages().collect()}
    assert len({t for t, _, _ in stored}) == 2
    for (tree, level, idx), text in stored.items():
        up = stored.get((tree, level + 1, idx // 3))
        assert (up[64 * (idx % 3) :][:64] if up else roots[tree]) == sha(text)


def test_more_columns_and_other_names(spark):
    """Group and id may be other columns, and a manifest of some columns does not see changes of the others."""
    df = spark.createDataFrame([(k, f"g{k % 2}", f"text {k}", k) for k in range(20)], "n int, key string, path string, leaf int")
    of = lambda d: {(r.n, r.key): (r.leaf, r.root, r.extra) for r in merkle.manifest(d, "n", "key", ("n", "path"), {"extra": d["leaf"]}).leaves.collect()}
    a, b, c = of(df), of(df.withColumn("leaf", F.col("leaf") + 1)), of(df.withColumn("path", F.when(F.col("n") == 7, "other").otherwise(F.col("path"))))
    assert {k: v[:2] for k, v in a.items()} == {k: v[:2] for k, v in b.items()} and a[(3, "g1")][2] == 3 and b[(3, "g1")][2] == 4
    assert {v[1] for v in a.values()} != {v[1] for v in c.values()} and sum(a[k][0] != c[k][0] for k in a) == 1


def test_query_equals_its_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    mine, theirs = merkle.op12_merkle_manifest(spark, small), con.sql(merkle.OP12_SQL)
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert sorted(map(tuple, mine.select(*theirs.columns).collect())) == sorted(theirs.fetchall())
