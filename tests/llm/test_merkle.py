"""Merkle manifests against trees built one node after the other."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from forklore.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos long, g string, path string, node string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = [row[0], row[3], row[2], row[4], text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The levels from ``nodes`` up to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h("".join(last[i : i + 3])) for i in range(0, len(last), 3)])
    return levels


def siblings(levels, at):
    for nodes in levels[:-1]:
        first = at - at % 3
        yield "".join(nodes[first:at]), "".join(nodes[at + 1 : first + 3])
        at //= 3


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append((row, leaf(row, row[1])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[name] = tree([x[1] for x in groups[name]])
    upper = tree([trees[name][-1][0] for name in names])
    found = []
    for place, name in enumerate(names):
        for at, (row, own) in enumerate(groups[name]):
            path = [*siblings(trees[name], at), *siblings(upper, place)]
            text = row[1]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf(row, text)
            for left, right in path:
                node = h(left + node + right)
            proof = h("".join(left + right for left, right in path))
            root = upper[-1][0]
            found.append((row[0], own, trees[name][-1][0], root, proof, node, node == root))
    return found


def rows_of(n, seed):
    rng = random.Random(seed)
    sources = ["hot"] * 6 + ["a", "é", "", None, *"bcdefghijklm"]
    made = []
    for _ in range(n):
        text = rng.choice([None, "", "one", "a\nb", "Zürich\n\n" * 3, "x\ny" * rng.randint(1, 50)])
        lang = rng.choice(["en", None, "1:x"])
        doc_id = rng.choice([None, *range(-3, 3 * n)])
        made.append((doc_id, text, lang, rng.choice(sources), rng.choice([None, 7]), 1, "g", "p", "n"))
    return made + made[: n // 10]


@pytest.mark.parametrize("n,levels", [(1, 7), (40, 2), (300, 1)])
def test_manifest_equals_plain_trees(spark, n, levels):
    rows = rows_of(n, n)
    docs = spark.createDataFrame(rows, SCHEMA)
    carry = {"seen": merkle.tampering(docs, merkle.COLUMNS)}
    found = merkle.audit(merkle.manifest(docs, merkle.COLUMNS, carry=carry, levels=levels))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, brute(rows)))


def test_one_group_fills_its_blocks(spark):
    """Sizes around the edges of blocks and of levels."""
    for n in (9, 10, 28):
        rows = [(i, f"t{i}\n", "en", "s", i, 1, "g", "p", "n") for i in range(n)]
        docs = spark.createDataFrame(rows, SCHEMA)
        carry = {"seen": merkle.tampering(docs, merkle.COLUMNS)}
        found = merkle.audit(merkle.manifest(docs, merkle.COLUMNS, carry=carry, levels=2))
        assert sorted(map(tuple, found.collect())) == sorted(brute(rows))


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert merkle.audited(docs).collect() == []


def test_a_row_may_be_moved_or_changed_but_not_unseen(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", f"s{i % 3}", 6, 1, "g", "p", "n") for i in range(50)], SCHEMA)
    roots = {merkle.manifest(d, merkle.COLUMNS).select("root").distinct().collect()[0][0] for d in (
        docs, docs.orderBy(F.rand(1)), docs.withColumn("text", F.when(F.col("doc_id") == 7, "tex 7").otherwise(F.col("text"))),
        docs.where("doc_id <> 7"),
    )}
    assert len(roots) == 3
