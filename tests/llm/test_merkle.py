"""The manifest against a tree built level by level, with proofs and versions rebuilt whole."""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import functions as F

from ordina.llm import merkle

SCHEMA = "text string, doc_id long, lang string, n_chars long, source string, leaf string, pos int, tree string"


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    values = [None if x is None else str(x) for x in (doc_id, source, lang, n_chars, text)]
    return sha(*("-" if x is None else f"{len(x.encode())}:{x}" for x in values))


def grow(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def siblings(levels, at):
    return [level[(at >> i) ^ 1] for i, level in enumerate(levels[:-1]) if (at >> i) ^ 1 < len(level)]


def brute(docs):
    """Every row's result; versions are whole trees with one leaf changed."""
    langs = sorted({d["lang"] for d in docs}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = [(d, leaf(d["doc_id"], d["source"], lang, d["n_chars"], d["text"])) for d in docs if d["lang"] == lang]
        own.sort(key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
        trees[lang] = (own, grow([x for _, x in own]))
    over = grow([trees[lang][1][-1][0] for lang in langs])
    rows = []
    for k, lang in enumerate(langs):
        own, levels = trees[lang]
        for at, (d, first) in enumerate(own):
            hit = d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 7 == 0 and d["n_chars"] is not None
            changed = leaf(d["doc_id"], d["source"], lang, d["n_chars"] + 1, d["text"]) if hit else first
            folded = over[-1][0]
            if hit:
                tops = list(over[0])
                tops[k] = grow([changed if i == at else x for i, x in enumerate(levels[0])])[-1][0]
                folded = grow(tops)[-1][0]
            proof = sha(*siblings(levels, at), *siblings(over, k))
            rows.append((d["doc_id"], first, levels[-1][0], over[-1][0], proof, folded, folded == over[-1][0], lang))
    return sorted(rows, key=str)


def frame(spark, docs):
    rows = [(d["text"], d["doc_id"], d["lang"], d["n_chars"], d["source"], "x", 1, "y") for d in docs]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def doc(doc_id, lang="en", text="a", n_chars=1, source="s"):
    return {"doc_id": doc_id, "lang": lang, "text": text, "n_chars": n_chars, "source": source}


EDGES = [
    doc(None), doc(None), doc(1, None), doc(2, None, None), doc(3, "", ""), doc(4, "de", "x" * 200_000), doc(5, "de", "ü\n日本", None),
    doc(6, "zz", source=None), doc(6, "zz", source=None), doc(6, "zz", "b"), doc(-7, "zz"), doc(2**63 - 1, "ß", "", 2**63 - 1),
    *(doc(i, "es", n_chars=None if i % 5 == 0 else i) for i in range(10, 60)),
]


def test_edge_cases(spark):
    got = merkle.audit(frame(spark, EDGES)).collect()
    assert sorted(map(tuple, got), key=str) == brute(EDGES)
    assert sum(not r.verified for r in got) > 3
    assert merkle.audit(frame(spark, EDGES[:1]).limit(0)).count() == 0
    assert sorted(map(tuple, merkle.audit(frame(spark, EDGES[:1])).collect()), key=str) == brute(EDGES[:1])


def test_many_languages_and_narrow_blocks(spark, monkeypatch):
    """Blocks of four nodes: three rounds in a language and three above the languages."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "WIDTH", 4)
    docs = [doc(i, f"l{i % 19:02d}" if i % 3 else "hot", n_chars=i) for i in range(150)]
    assert sorted(map(tuple, merkle.audit(frame(spark, docs)).collect()), key=str) == brute(docs)


def test_blocks_of_a_large_language(spark):
    docs = [doc(i * 3, "en", str(i % 10), i) for i in range(2 * merkle.WIDTH + 5)]
    assert sorted(map(tuple, merkle.audit(frame(spark, docs)).collect()), key=str) == brute_sampled(docs)


def brute_sampled(docs):
    """As `brute`, a version found from the first tree's siblings instead of a whole tree."""
    levels = grow([leaf(d["doc_id"], d["source"], d["lang"], d["n_chars"], d["text"]) for d in docs])
    rows = []
    for at, d in enumerate(docs):
        hit = zlib.crc32(str(d["doc_id"]).encode()) % 7 == 0
        node = leaf(d["doc_id"], d["source"], d["lang"], d["n_chars"] + hit, d["text"])
        for i, level in enumerate(levels[:-1]):
            pair = list(level[(at >> i) & ~1 : ((at >> i) & ~1) + 2])
            pair[(at >> i) & 1] = node
            node = sha(*pair)
        root = levels[-1][0]
        rows.append((d["doc_id"], levels[0][at], root, root, sha(*siblings(levels, at)), node, node == root, "en"))
    return sorted(rows, key=str)


def test_versions_hold_the_path_only(spark):
    """A version is the first tree with its own nodes laid over it."""
    docs = [doc(i, "en", str(i), i) for i in range(13)]
    tree = merkle.build(frame(spark, docs), F.col("doc_id").isin(4, 12), {"text": F.lit("forged")})
    levels = grow([leaf(i, "s", "en", i, str(i)) for i in range(13)])
    got = merkle.versions(tree).collect()
    assert {r.doc_id for r in got} == {4, 12} and len(got) == 2 * len(levels)
    for d in (4, 12):
        want = grow([leaf(i, "s", "en", i, "forged" if i == d else str(i)) for i in range(13)])
        own = {(r.level, r.pos >> r.level): r.node for r in got if r.doc_id == d}
        laid = [[own.get((k, i), x) for i, x in enumerate(level)] for k, level in enumerate(levels)]
        assert laid == want
