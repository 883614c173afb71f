"""The manifest against a plain tree."""

from __future__ import annotations

import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from conftest import corpus

from mcqflow.llm import merkle
from mcqflow.llm.common import table


def h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(row, text) -> str:
    fields = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return h("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree_of(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return levels


def beside(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    out = []
    for nodes in levels[:-1]:
        start = i // 8 * 8
        out.append(("".join(nodes[start:i]), "".join(nodes[i + 1 : start + 8])))
        i //= 8
    return out


def plain(rows) -> list[tuple]:
    langs = defaultdict(list)
    for r in rows:
        langs[r.lang].append(r)
    trees, order = {}, sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for lang in order:
        langs[lang].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        trees[lang] = tree_of([leaf(r, r.text) for r in langs[lang]])
    top = tree_of([trees[x][-1][0] for x in order])
    out = []
    for k, lang in enumerate(order):
        for i, r in enumerate(langs[lang]):
            path = beside(trees[lang], i) + beside(top, k)
            text = r.text
            if r.doc_id is not None and text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            now = leaf(r, text)
            for a, b in path:
                now = h(a + now + b)
            root = top[-1][0]
            out.append((r.doc_id, trees[lang][0][i], trees[lang][-1][0], root, h("".join(a + b for a, b in path)), now, now == root))
    return out


def frame_of(spark, rows):
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, at int, digest int, total int"
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], columns).repartition(3)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("height", [1, 3])
def test_manifest(spark, height):
    """Trees of one, eight, nine and many leaves, and more languages than a node has children."""
    langs = ["a"] * 1 + ["b"] * 8 + ["c"] * 9 + ["d"] * 73 + [None] * 5 + [""] * 2 + [f"l{i}" for i in range(9)] + ["é"] * 2
    texts = [t for _, t, _ in corpus(8, len(langs))]
    rows = [(i * 7, t, lang, None if i % 5 == 0 else "Src", len(t) if i % 4 else None) for i, (t, lang) in enumerate(zip(texts, langs))]
    df = frame_of(spark, rows)
    got = rows_of(merkle.manifest(df, height))
    assert got == sorted(plain(df.collect()), key=repr)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_versions_copy_the_path_of_a_changed_leaf(spark, folder):
    docs = table(spark, folder, "documents")
    rows = merkle.versions(docs).collect()
    want = {r[0]: r for r in plain(docs.collect())}
    assert len(rows) == len(want)
    for r in rows:
        assert tuple(r)[:7] == want[r.doc_id]
        assert r.verified == (not r.copied) and (r.verified or r.copied[-1] == r.folded_root)


def test_odd_rows(spark):
    text = "Very LONG text " * 20_000
    rows = [
        (1, "A b", "en", "s", 3), (1, "A b", "en", "s", 3), (1, "other", "en", "s", 5), (None, "NULL", "en", None, None), (None, None, None, None, None),
        (6, text, "en", "s", len(text)), (7, "", "en", "", 0), (8, None, "", "é", -1),
    ]
    df = frame_of(spark, rows)
    assert rows_of(merkle.manifest(df)) == sorted(plain(df.collect()), key=repr)
    assert merkle.manifest(df.limit(0)).count() == 0
    one = frame_of(spark, rows[:1])
    assert rows_of(merkle.manifest(one)) == plain(one.collect())
    assert one.count() == 1 and merkle.manifest(one).first().proof_sha256 == h("")
