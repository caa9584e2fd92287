import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerfield.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes, fan):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + fan])) for i in range(0, len(out[-1]), fan)])
    return out


def climbed(tree, at, digest, fan):
    """Siblings of a node up to the top of its tree, and what the digest folds to."""
    proof = ""
    for level in tree[:-1]:
        first = at // fan * fan
        left, right = "".join(level[first:at]), "".join(level[at + 1:first + fan])
        proof, digest, at = proof + left + right, sha(left + digest + right), at // fan
    return proof, digest


def expected(rows, fan):
    """Rows (doc_id, lang, text) by brute force; rows with one id and leaf come in any order."""
    groups = defaultdict(list)
    for d, g, t in rows:
        hit = d is not None and zlib.crc32(str(d).encode()) % 3 == 0 and t is not None
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t) if hit else t
        groups[g].append((d is not None, d or 0, leaf((d, g, t)), leaf((d, g, low))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [levels([r[2] for r in sorted(groups[g])], fan) for g in names]
    crown = levels([t[-1][0] for t in trees], fan)
    out = []
    for number, (g, tree) in enumerate(zip(names, trees)):
        for at, (known, d, digest, other) in enumerate(sorted(groups[g])):
            proof, top = climbed(tree, at, other, fan)
            more, top = climbed(crown, number, top, fan)
            out.append((d if known else None, digest, tree[-1][0], crown[-1][0], sha(proof + more), top))
    return out


def found(spark, df, fan, levels):
    made = merkle.manifest(spark, df, ("doc_id", "lang", "text"), "lang", "doc_id",
                           {"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                                "abcdefghijklmnopqrstuvwxyz")}, merkle.tampered(), fan, levels)
    rows = made.proofs()
    return [tuple(r) for r in rows.select(
        "id", "leaf", "subroot", "root", F.sha2(merkle.joined(F.col("path")), 256),
        merkle.folded(F.coalesce("altered", "leaf"), F.col("path"))).collect()], made


SCHEMA = "doc_id long, lang string, text string, tree string, rank string, payload string, level0 int"


@pytest.mark.parametrize("fan, levels, n", [(8, 3, 700), (2, 2, 150), (3, 1, 60)])
def test_manifest_against_brute_force(spark, fan, levels, n):
    """A hot group, many groups, nulls, empty texts, repeated ids and rows, clashing columns."""
    rng = random.Random(n)
    rows = [(i, "en" if i % 3 else rng.choice([None, "", "1", "dé", f"g{i % 40}"]),
             rng.choice(["Some Text", "plain", "", None, "ÉÀ Ü"])) for i in range(n)]
    rows += [(5, "en", "plain"), (5, "en", "plain"), (5, "en", "Other"), (None, "en", "A"), (None, None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", "y", "z", 3) for r in rows], SCHEMA).repartition(5)
    got, made = found(spark, df, fan, levels)
    assert sorted(got, key=str) == sorted(expected(rows, fan), key=str)
    assert made.root().count() == 1
    assert {r["group"] for r in made.subroots().collect()} == {r[1] for r in rows}


def test_one_row_and_no_row(spark):
    got, _ = found(spark, spark.createDataFrame([(7, None, "T", "", "", "", 0)], SCHEMA), 8, 3)
    digest = leaf((7, None, "T"))
    assert got[0][1:5] == (digest, digest, digest, sha(""))
    got, made = found(spark, spark.createDataFrame([], SCHEMA), 8, 3)
    assert got == [] and made.root().count() == 0


def test_any_change_is_noticed(spark):
    """A changed leaf folds to another root; an unchanged one to the root."""
    rows = [(i, "en", "Aa" if i % 2 else "aa") for i in range(90)]
    got, _ = found(spark, spark.createDataFrame([(*r, "", "", "", 0) for r in rows], SCHEMA), 4, 2)
    for d, _, _, root, _, fold in got:
        assert (fold == root) == (zlib.crc32(str(d).encode()) % 3 != 0 or d % 2 == 0)


def test_rows_of_one_key_are_spread(spark):
    """All rows alike: the range partitioning still splits them."""
    rows = spark.range(20_000).select(F.lit("1").alias("tree"), F.lit(None).cast("long").alias("id"),
                                      F.lit("x").alias("digest"), F.col("id").alias("row"))
    ranked = merkle.ranked(spark, rows, ["id", "digest", "row"])
    assert [tuple(r) for r in ranked.agg(F.min("rank"), F.max("rank"), F.count_distinct("rank"),
                                         F.min("n"), F.max("n")).collect()] == [(0, 19_999, 20_000, 20_000, 20_000)]
    sizes = [r["count"] for r in ranked.groupBy(F.expr("rank div 2500")).count().collect()]
    assert max(sizes) == 2500
