"""Packing, archives, pages and the whole pipeline."""

from __future__ import annotations

import hashlib
import io
import zlib
from collections import defaultdict

import brute
import numpy as np
import pytest
from conftest import corpus

import corpus_pipeline
from mcqflow.llm import html, packing, quality, warc


def _ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    found = tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [np.asarray([*e.ids, packing.END_ID], dtype="<u4") for e in found]


def _check_packing(rows, ids, window=2048):
    sequences = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    for d, mine in pieces.items():
        at = 0
        for r in sorted(mine, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[d])
            assert r.ids_crc32 == zlib.crc32(ids[d][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[d])
    for mine in sequences.values():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or at & (at - 1) == 0
    assert set(pieces) == set(ids)


@pytest.mark.parametrize("window", [2048, 64])
def test_packing(frame, window):
    docs = [*corpus(7), (900, "long " * 9000, "s"), (901, None, "s")]
    ids = dict(zip((d for d, *_ in docs), _ids([t for _, t, _ in docs])))
    _check_packing(packing.pack(frame(docs), window=window).collect(), ids, window)


def test_packing_of_odd_rows(odd, empty):
    assert packing.pack(empty).count() == 0
    assert sum(r.length for r in packing.pack(odd).collect()) == sum(map(len, _ids([r.text for r in odd.collect()])))


def test_sum_of_squares_levels():
    packer = packing.Packer(10)
    packer.levels[[3, 4]] = [2, 1]
    assert packer.level_for(7) == 3  # closes one of two windows at level 3
    packer.levels[:] = 0
    packer.levels[6] = 1
    assert packer.level_for(3) == 6 and packer.level_for(5) == 0


def test_word_ids_are_those_of_whole_texts():
    odd = ["İ ΣΑΣ", "it's we'll 'Sx", "ábc Å", "x\x1cy \x85z", "<|endoftext|> a", "½ ①", "日本語 漢字", " \t\n ", "", "a b　c", "🙂👍🏽x"]
    coder = packing.WordIds(packing.default_tokenizer())
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.texts(odd)] == [e.tolist() for e in coder.encode(odd)]


PAGES = "page_id bigint, url string, html string, digest string, key string"


def test_warc_round_trip(spark):
    rows = [(3, "http://a/ä b\n", "same"), (1, None, "same"), (2, "u", None), (4, "u", ""), (5, "u", "é" * 100_000), (5, "v", "é" * 100_000), (None, "u", "same"), (9, "u", "x")]
    df = spark.createDataFrame([(*r, "d", "k") for r in rows], PAGES).repartition(3)
    got = sorted(warc.round_trip(df).collect(), key=lambda r: (r.page_id or 99, r.record_type))
    for r in got:
        payload = next((h or "").encode() for p, _, h in rows if p == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(payload), brute.sha1_base32(payload))
    assert [(r.page_id, r.record_type, r.refers_to) for r in got] == [
        (1, "response", None), (2, "response", None), (3, "revisit", 1), (4, "revisit", 2), (5, "response", None),
        (5, "revisit", 5), (9, "response", None), (None, "revisit", 1),
    ]
    assert {r.url for r in got} == {u for _, u, _ in rows}
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_keeps_percent_signs(spark):
    urls = ["http://a/b%20c%2Fd", "100%", "%zz%", "a%0D%0Ab", "ä%20b", "ä%C3%A4\r\nX-Page-Id: 9", " x ", "", "%25"]
    df = spark.createDataFrame([(i, u, f"page {i}", "d", "k") for i, u in enumerate(urls)], PAGES)
    assert {r.page_id: r.url for r in warc.round_trip(df).collect()} == dict(enumerate(urls))


def test_warc_reader_is_strict():
    block = warc._HTTP % 3 + b"abc"
    head = {"WARC-Type": "response", "WARC-Payload-Digest": "sha1:" + warc.payload_digest(b"abc")}
    data = warc.encode_record(head, block) * 3
    for chunk in (1, 7, 1 << 18):
        assert [r.payload for r in warc.read_records(io.BytesIO(data), chunk)] == [b"abc"] * 3
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.read_records(io.BytesIO(data[:-4])))
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records(io.BytesIO(warc.encode_record(head, block[:-1] + b"d"))))


def _page(article: str, nav: str = "menu", tail: str = "") -> str:
    return f"<!DOCTYPE html><html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li>{nav}</ul></nav><div class='ad'>buy</div><article>{article}</article>{tail}<footer>&copy; x</footer></body></html>"


def test_main_text():
    assert html.main_text(_page("<h1>A &amp; B</h1><p><b>c<br>d</b><p>e\n  f</p>")) == "A & B\n\nc d\n\ne f"
    assert html.main_text(_page("<p>one<p>two")[:-60]) != ""
    noisy = "<p>text</p><aside>side</aside><div class='share-bar'>s</div><form><p>f</p></form><section id='comments'>c</section><style>x</style><p>end"
    assert html.main_text(_page(noisy)) == "text\n\nend"
    assert html.main_text("") == "" and html.main_text("<body><nav>x</nav></body>") == ""
    assert html.main_text("plain 1 < 2 &lt;b&gt;") == "plain 1 < 2 <b>"
    assert html.main_text("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == "a\n\nb\n\nc\n\nd"


def test_names_do_not_drop_the_article():
    inside = "<h2 id='search-and-rescue'>Search</h2><section id='related-work'><p>work</p></section><div class='share-bar'>s</div>"
    assert html.main_text(_page(inside)) == "Search\n\nwork"
    story = "<p>The story and its many words</p>"
    for wrapper in ("div class='content has-sidebar'", "form", "div class='notice'"):
        page = f"<body><{wrapper}>{{}}<div class='sidebar'>side</div></{wrapper.split()[0]}></body>"
        assert html.main_text(page.format(story)) == "The story and its many words"
        assert html.main_text(page.format(f"<article>{story}</article>")) == "The story and its many words"
    assert html.main_text(f"<body><div hidden>{story}</div><p>x</body>") == "x"


def test_style_tree_cuts_what_a_host_repeats(spark):
    body = "<div class='x1'><p>Subscribe to us</p></div><div class='story'><p>{0} first words of page {0}</p></div>"
    rows = [(i, f"http://h.example/{i}", f"<html><body>{body.format(i)}</body></html>", "d", "k") for i in range(20)]
    rows += [(100 + i, "http://copies.example/", _page("<p>always the same</p>"), "d", "k") for i in range(20)]
    rows += [(200, None, None, "d", "k"), (201, "no url", "<p>alone</p>", "d", "k")]
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    got = {r.page_id: r for r in html.extract(df).collect()}
    assert all(got[i].text == f"{i} first words of page {i}" for i in range(20))
    assert all(got[100 + i].text == "always the same" for i in range(20))
    assert (got[200].text, got[200].n_chars, got[201].text) == ("", 0, "alone")
    assert html.extract(df.limit(0)).count() == 0


def test_mirrored_stories_stay(spark):
    """18 of 20 pages of a host tell one story beside menus of their own, without an article's tag."""
    story = "A story that many mirrors tell, sentence after sentence, much longer than any menu beside it. " * 3
    rows = []
    for i in range(20):
        text = story if i < 18 else f"Another story, number {i}, told by one page alone, and at some length as well. " * 3
        same = "<div class='hint'>The same words of the house on every page.</div>"
        rows.append((i, f"http://m.example/{i}", f"<body><div class='items'>Menu {i} of {i * i}</div><div class='told'><p>{text}</p></div>{same}</body>"))
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in range(20):
        assert (story.strip() if i < 18 else f"number {i}") in got[i] and "house" not in got[i]


def test_pipeline_stages(spark, folder, tmp_path):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    docs, columns = documents, documents.columns
    rows = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        rows[name] = docs.collect()
        if i < 4:
            assert docs.columns == columns
    before = {r.doc_id: r.text for r in documents.collect()}
    good = {r.doc_id for r in quality.judge(documents).where("kept").collect()}
    assert {r.doc_id for r in rows["quality_rules"]} == good
    want = brute.components([(d, before[d]) for d in good])
    assert sorted(r.doc_id for r in rows["ngram_jaccard_join"]) == sorted(set(want.values()))
    one = [(r.doc_id, r.text) for r in rows["ngram_jaccard_join"]]
    left = dict(zip((d for d, _ in one), brute.strings([t for _, t in one])))
    for r in rows["suffix_array_dedup"]:
        if hashlib.sha256(r.text.encode()).hexdigest() != left[r.doc_id][3]:
            assert 0 <= left[r.doc_id][0] - left[r.doc_id][1] - len(r.text.encode()) <= 6 * left[r.doc_id][2]
    taken = sum(len(brute.words(r.text)) for r in rows["source_mixing"])
    words = sum(len(brute.words(r.text)) for r in rows["suffix_array_dedup"])
    assert abs(taken - words) <= 20
    tokens = sum(map(len, _ids([r.text for r in rows["source_mixing"]])))
    assert sum(r.length for r in rows["packing"]) == tokens
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, folder).count() == len(rows["packing"])
