"""Corpus operators against brute force, on hand-made rows and the smallest tables."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aislecast.llm import decontaminate, lines, near_copies, neighbours, privacy, quality, templates, token_files, trie_bpe, warc
from aislecast.llm.components import components
from aislecast.llm.elias_fano import EliasFano
from aislecast.llm.hilbert import hilbert_keys
from aislecast.llm.queries import QUERIES
from aislecast.llm.text import table

FOLDER = "/root/testdata/sf0.001"
BYTE_BPE, WORD_BPE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
DOC = "doc_id long, text string, n_lines string, score string, extra array<int>"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, texts, first=0):
    """Documents with these texts, and columns whose names the operators use too."""
    return spark.createDataFrame([(first + i, t, "x", "y", [i]) for i, t in enumerate(texts)], DOC)


@pytest.fixture(scope="module")
def documents(spark):
    return [(r[0], r[1] or "") for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()]


# --- privacy

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in twice) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


PII_TEXTS = [
    None,
    "",
    "a@b.c_d@e.f x@y a.@b.cc..dd @@ a@b@c.d é@b.c ü",
    "1.2.3.4.5.6.7.8 999.1.1.1 0001.002.03.4 1.2.3 255.255.255.255 256.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111111 12345  67 4111 1111 1111 1111 9",
    "+1 (456) 555-2186. +12 +123456789012345678 ++49 30 1234567 +4",
    "1" * 20_000 + "." + "2" * 5_000,
    "a" * 30_000 + " " + "b." * 5_000 + "@" + "c." * 9_000 + "d",
    "1 " * 9_000,
    "😀 me@x.org 😀😀 10.0.0.1",
]


def test_identifiers_equal_plain_patterns(spark):
    rows = privacy.sanitise(frame(spark, PII_TEXTS)).orderBy("doc_id").collect()
    for text, row in zip(PII_TEXTS, rows):
        assert [(s["kind"], s["start"], s["end"]) for s in row["spans"]] == plain_spans(text)
    assert rows[0]["sanitised"] is None and rows[9]["sanitised"] == "😀 [email] 😀😀 [ip]"


def test_words_that_disclose_an_identifier(spark):
    told = [f"Case {n} of Zebulon was sent to zeb@corp.example by mail" for n in range(4)]
    other = [f"The case {n} of the mail was sent by mail to the office of Ann{n}" for n in range(60)]
    copies = ["Quixotic word beside once@corp.example here"] * 6
    rows = privacy.sanitise(frame(spark, told + other + copies)).orderBy("doc_id").collect()
    for row, text in zip(rows, told):
        words = {text[s["start"] : s["end"]] for s in row["spans"] if s["kind"] == "term"}
        assert words == {"Zebulon"}
        assert "Zebulon" not in row["sanitised"] and "[email]" in row["sanitised"]
    # One line is one piece of evidence, however often it is copied; clean documents stay.
    assert all(s["kind"] != "term" for row in rows[4:] for s in row["spans"])
    assert [r["sanitised"] for r in rows[4:64]] == other


def test_disclosure_counts_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = []
    for n in range(300):
        words = [f"w{rng.integers(40)}x" for _ in range(6)]
        if rng.random() < 0.4:
            words.insert(3, f"u{rng.integers(5)}@h.example")
        texts.append(" ".join(words))
    got = {(r[0], r[1]): r[2] for r in privacy.disclosures(frame(spark, texts), 2, 0.2).collect()}
    unique = set(texts)
    entities = {t: {f"email:{w}" for w in t.split() if "@" in w} for t in unique}
    terms = {t: {w for w in t.split() if "@" not in w} for t in unique}
    want = {}
    for c in {e for s in entities.values() for e in s}:
        n_c = sum(c in entities[t] for t in unique)
        for w in {w for s in terms.values() for w in s}:
            n_t, n_ct = sum(w in terms[t] for t in unique), sum(w in terms[t] and c in entities[t] for t in unique)
            if n_ct >= 2:
                d = np.log(len(unique) * n_ct / (n_c * n_t)) / np.log(len(unique) / n_c)
                if d >= 0.2:
                    want[c, w] = d
    assert want and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_privacy_query_on_whole_table(spark, documents):
    rows = {r["doc_id"]: r for r in QUERIES["op1_disclosure"](spark, FOLDER).collect()}
    assert len(rows) == len(documents)
    for doc_id, text in documents:
        spans = plain_spans(text)
        assert rows[doc_id]["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
        assert rows[doc_id]["n_email"] == sum(k == "email" for k, _, _ in spans)


# --- token files

ODD_TEXTS = [
    None,
    "",
    " ",
    "a  b",
    "a   b ",
    " a\n \nb  ",
    "x\n y\t z a b",
    "<|endoftext|> a <|startoftext|>b",
    "ΑΣ ΟΔΟΣ İ ǅ ﬁ é",
    "a\x1cb c\x1fd",
    "日本語 テキスト 🙂🙂 ½²",
    "it's DON'T we'LL 'tis !!?? a1b22",
    "word " * 4000,
]


def test_elias_fano_selects_every_value():
    rng = np.random.default_rng(1)
    for values in ([], [0], [5], [0, 0, 0], [7] * 900, np.cumsum(rng.integers(0, 5000, 3000)), np.cumsum(rng.integers(0, 2, 3000))):
        coded = EliasFano.from_bytes(EliasFano.encode(np.array(values, dtype=np.int64)).to_bytes())
        assert coded.values().tolist() == list(values)
        assert [coded.select(i) for i in range(0, len(values), 7)] == list(values)[::7]
    big = EliasFano.encode(np.cumsum(rng.integers(0, 2000, 10_000)))
    assert len(big.to_bytes()) < 10_000 * (2 + 11) / 8 + 100
    with pytest.raises(IndexError):
        big.select(10_000)


def expected_tokens(texts):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def test_token_files_round_trip(spark):
    rows = sorted(token_files.token_round_trip(frame(spark, ODD_TEXTS), BYTE_BPE, with_ids=True).collect())
    start = 0
    for row, ids in zip(rows, expected_tokens(ODD_TEXTS)):
        assert row["start"] == start and row["n_tokens"] == len(ids) and row["ids"] == ids
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_token_files_roll_over_and_hold_repeated_and_null_ids(spark, tmp_path):
    docs = spark.createDataFrame([(None, "no id"), (7, "b"), (7, "a"), (7, "a"), (-3, "neg")], "doc_id long, text string")
    files = token_files.write_token_files(docs, BYTE_BPE, str(tmp_path / "t"), file_ids=1).cache()
    rows = sorted(token_files.read_token_files(files, True).collect(), key=lambda r: r["start"])
    assert files.count() == 5
    assert [r["doc_id"] for r in rows] == [None, -3, 7, 7, 7]
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1]]


def test_token_query_on_whole_table(spark, documents):
    rows = sorted(QUERIES["op2_token_files"](spark, FOLDER).collect())
    want, start = [], 0
    for (doc_id, _), ids in zip(sorted(documents), expected_tokens(t for _, t in sorted(documents))):
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in rows] == want


# --- trie BPE


def test_trie_encoding_equals_library_and_decodes(spark, documents):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    texts = ODD_TEXTS + [t for _, t in documents]
    docs = frame(spark, texts).withColumnRenamed("extra", "Ids")
    rows = trie_bpe.encode_and_decode(docs, WORD_BPE, with_ids=True).orderBy("doc_id").collect()
    assert len(rows) == len(texts)
    for text, row in zip(texts, rows):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert row["ids"] == ids and row["n_tokens"] == len(ids) and row["n_lines"] == "x"
        assert row["ids_sha256"] == sha(" ".join(map(str, ids)))
        assert row["decoded_sha256"] == sha(tokenizer.decode(ids, skip_special_tokens=False))


def test_trie_equals_merges_for_every_short_word():
    letters = ["a", "b", "c"]
    merges = [("a", "b"), ("a", "a"), ("ab", "c"), ("b", "c"), ("aa", "b"), ("c", "c</w>"), ("b", "c</w>"), ("aa", "aa")]
    vocab = {t: i for i, t in enumerate([*letters, *[x + "</w>" for x in letters], *[a + b for a, b in merges]])}
    encoder = trie_bpe.TrieEncoder(vocab, merges, "</w>")
    words = ["".join(w) for n in range(1, 8) for w in itertools.product(letters, repeat=n)]
    found = encoder.encode(words)
    for word in words:
        assert found[word] == encoder.by_merges([*word[:-1], word[-1] + "</w>"]), word


def test_trie_equals_merges_where_two_merges_make_a_token():
    letters = ["a", "b", "c"]
    merges = [("b", "c"), ("a", "b"), ("a", "bc"), ("ab", "c"), ("abc", "a"), ("c", "a"), ("b", "a"), ("ba", "ba")]
    vocab = {t: i for i, t in enumerate(dict.fromkeys([*letters, *[a + b for a, b in merges]]))}
    encoder = trie_bpe.TrieEncoder(vocab, merges)
    assert not encoder.ordered
    for word in ("".join(w) for n in range(1, 7) for w in itertools.product(letters, repeat=n)):
        assert encoder.encode([word])[word] == encoder.by_merges(word), word


def test_letters_and_signs_need_no_cutting_and_no_merging(monkeypatch):
    words = trie_bpe.WordEncoder(WORD_BPE)

    def refuse(*_):
        raise AssertionError

    monkeypatch.setattr(words, "_cut", refuse, raising=False)
    monkeypatch.setattr(words.encoder, "by_merges", refuse)
    text = "The theÿ, Été! étés... ÀÉ naïve?! AAAA aaaa; Straße thing) thing,,;"
    [(n, ids, _)] = words.encode([text])
    want = Tokenizer.from_file(WORD_BPE).encode(text, add_special_tokens=False).ids
    assert (n, ids) == (len(want), " ".join(map(str, want)))


# --- web archives


def test_archives_hold_duplicates_segments_and_empty_pages(spark):
    long = "äö" * 40_000
    pages = [
        (3, "http://a.example/\n3", long, "c"),
        (1, None, long, "c"),
        (2, "u", None, "c"),
        (4, "u", "", "c"),
        (5, "u", "x" * 99, "c"),
        (6, "u", "x" * 99, "c"),
        (8, "u", "y" * 100, "c"),
        (7, "u", "y" * 100, "c"),
        (7, "u", "y" * 100, "c"),
        (None, "u", "kept", "c"),
    ]
    docs = spark.createDataFrame(pages, "page_id long, url string, html string, digest string")
    rows = {r["page_id"]: r for r in warc.archive_round_trip(docs, segment=1000).collect()}
    assert set(rows) == {None, 1, 2, 3, 4, 5, 6, 7, 8}
    for page_id, _, text, _ in pages:
        data = (text or "").encode()
        assert rows[page_id]["payload_digest"] == hashlib.sha256(data).hexdigest()
        assert rows[page_id]["payload_bytes"] == len(data)
        assert rows[page_id]["refers_to"] == {3: 1, 8: 7}.get(page_id)
        assert rows[page_id]["record_type"] == ("revisit" if page_id in (3, 8) else "response")
        assert rows[page_id]["payload"] == (None if page_id in (3, 8) else data)


def test_segmented_pages_with_one_id_are_records_of_their_own(spark):
    long = "äö" * 40_000
    rows = [(1, "u", long), (1, "u", long), (1, "v", long), (1, "u", long + "!"), (2, "u", long)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    found = warc.archive_round_trip(docs).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in found) == [(1, "response", None)] * 4 + [(2, "revisit", 1)]
    assert sorted(len(r["payload"]) for r in found if r["payload"]) == [160_000] * 3 + [160_001]


def test_rows_without_page_id_are_records_too(spark):
    long = "äö" * 40_000
    rows = [(None, "u", long), (None, "v", long), (5, "u", long), (None, "u", "z" * 200), (None, "w", "z" * 200), (None, None, None)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = [(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.archive_round_trip(docs).collect()]
    want = [(None, "revisit", 5, 160_000)] * 2 + [(5, "response", None, 160_000), (None, "response", None, 0)]
    want += [(None, "response", None, 200)] * 2
    assert sorted(found, key=str) == sorted(want, key=str)


def test_reassembly_refuses_missing_segments(spark):
    rows = [("o", n, None if n < 3 else 9, "response" if n == 1 else "continuation", None, "", "u", b"abc") for n in (3, 1, 2)]
    whole = warc.reassemble(spark.createDataFrame(rows, warc.RECORDS)).collect()
    assert bytes(whole[0]["block"]) == b"abcabcabc" and whole[0]["type"] == "response"
    for broken in (rows[:2], rows + rows[:1], rows[1:]):
        with pytest.raises(Exception, match="segments do not fit"):
            warc.reassemble(spark.createDataFrame(broken, warc.RECORDS)).collect()


def test_chunk_framing():
    for size in (0, 1, 4095, 4096, 4097, 10_000):
        assert warc.unchunked(warc.chunked(b"\r\n0" * size)) == b"\r\n0" * size
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


# --- benchmark search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_leaks(text, items):
    found, hit, w = set(), set(), words(text)
    for item, item_text in items:
        p = words(item_text)
        size = min(10, len(p))
        for i in range(len(p) - size + 1 if size else 0):
            for j in range(len(w) - size + 1):
                if w[j : j + size] == p[i : i + size]:
                    found.add(str(item))
                    hit |= set(range(j, j + size))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("pass_words", [200_000, 20])
def test_leaks_equal_brute_force(spark, pass_words):
    rng = np.random.default_rng(2)
    bag = ["aa", "Bb", "é", "d4", "Éx"]
    items = [(i, " ".join(rng.choice(bag, int(rng.integers(0, 14))))) for i in range(25)]
    items += [(100, None), (101, "?!"), (None, "aa"), (3, "aa, Bb"), (102, items[4][1])]
    texts = [" - ".join(rng.choice(bag, int(rng.integers(0, 60)))) for _ in range(40)] + [None, "", "...", "ab\x80" * 3]
    texts += [items[7][1], ("lead " * 50_000) + items[8][1]]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, texts).withColumnRenamed("extra", "Hits")
    rows = decontaminate.find_leaks(docs, benchmark, pass_words=pass_words).orderBy("doc_id").collect()
    named = [(i, t) for i, t in items if i is not None]
    for text, row in zip(texts, rows):
        assert (row["n_words"], row["n_hit"], row["items"]) == plain_leaks(text, named)
        assert row["contaminated"] == (row["n_hit"] > 0) and row["score"] == "y"


# --- page text


def test_article_text_leaves_out_what_is_around():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="no-ads">
    <header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav><!-- <p>no</p> --><div class="ad box">Buy</div>
    <article><h1>One &amp; two&nbsp;&#233;</h1><script>if (a<b) "<p>x</p>"</script><p>First <b>bold
      text</b><p>a < b &am<br>next</p><ul><li>i<li>ii</ul><aside>side</aside>
      <blockquote title="a > b">said</blockquote><form><p>mail</p></form></article>
    <section id="comments"><p>Great!</p></section><div role="contentinfo">c</div><footer>&copy;</footer></body></html>"""
    assert templates.main_text(page, None) == "One & two é\nFirst bold text\na < b &am next\ni\nii\nsaid"
    assert templates.main_text("", None) == "" and templates.main_text("<p>", None) == ""
    assert templates.main_text("bare & text", None) == "bare & text"
    assert templates.main_text("<div>" * 3000 + "deep", None) == "deep"


def test_words_of_class_and_id_are_only_hints():
    def page(body, around="div class='site with-sidebar'"):
        return f"<html><body><{around}>{body}</{around.split()[0]}></body></html>"

    long = " ".join(["word"] * 30)
    article = f"<article><div class='article-header'>By me</div><h2 id='related-work'>Related</h2><p>{long}</p>"
    article += "<section id='discussion'><p>We discuss</p></section><div class='ad'>Buy</div></article>"
    kept = f"By me\nRelated\n{long}\nWe discuss"
    for around in ("div class='site with-sidebar'", "div class='content-sidebar-wrap'", "div class='comments'"):
        assert templates.main_text(page(article + "<div class='sidebar'>Side</div>", around), None) == kept
    alone = f"<p>{long}</p><h2 class='header'>Head</h2><div class='left-sidebar'>Side</div>"
    assert templates.main_text(page(alone), None) == f"{long}\nHead"


def test_template_of_a_host_gives_its_slot(spark):
    def page(i, body):
        return f"<html><body><div class='top'>Daily Site</div><div class='x{'' }'><div class='post'>{body}</div></div><div class='end'>All rights</div></body></html>"

    long = " ".join(["word"] * 30)
    rows = [(i, f"http://h.example/{i}", page(i, f"<p>{long} {i}</p><p>tail {i}</p>"), 1) for i in range(6)]
    rows += [(9, "http://h.example/9", page(9, "<p>short</p>"), 1), (10, None, None, 1), (11, "http://x.example/", "", 1)]
    rows += [(12, "http://h.example/12", "<html><body><table><tr><td>Other layout</td></tr></table></body></html>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    found = {r["page_id"]: r for r in templates.extract_main_text(pages).collect()}
    assert len(found) == len(rows)
    assert found[2]["text"] == f"{long} 2\ntail 2"
    # By itself the page would not tell its short article from the rest.
    assert found[9]["text"] == "short" and found[9]["n_chars"] == 5
    assert found[10]["text"] == "" and found[11]["text"] == "" and found[12]["text"] == "Other layout"


def test_classes_decide_on_slots_and_fixed_texts(spark):
    def words(i, n):
        return " ".join(f"w{i}x{k}" for k in range(n))

    def page(i):
        notice = "<div class='box'><p class='small'>Join our club</p></div>"
        heading = "<h2>Methods</h2>" if i % 3 else "<h2>Other</h2>"
        lead, body = f"<div class='lead'><p>{words(i, 20)}</p></div>", f"<div class='rest'>{heading}<p>{words(-i, 50)}</p></div>"
        links = f"<div class='more'><a href='/'>{words(i + 1000, 15)}</a></div>"
        return f"<html><body><div class='page'><div class='post'>{lead}{notice}{body}</div>{links}</div></body></html>"

    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(1, 13)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in templates.extract_main_text(pages).collect()}
    # All slots of the article, without the template's text in it, but with a heading that many pages have.
    for i in range(1, 13):
        heading = "Methods" if i % 3 else "Other"
        assert found[i] == f"{words(i, 20)}\n{heading}\n{words(-i, 50)}"


def test_headings_stay_however_many_pages_repeat_them(spark):
    def page(i):
        words = " ".join(f"w{i}x{k}" for k in range(40))
        return f"<html><body><article><h2>Introduction</h2><p>{words}</p><h2>References</h2><p>{words} end</p></article></body></html>"

    rows = [(i, f"http://h{n}.example/{i}", page(i)) for n in (1, 3, 4, 8) for i in range(n)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for row in templates.extract_main_text(pages).collect():
        assert [line for line in row["text"].split("\n") if " " not in line] == ["Introduction", "References"], row["url"]


def test_title_and_lead_beside_the_content_belong_to_the_article(spark):
    def page(i, shape):
        words = " ".join(f"w{i}x{k}" for k in range(60))
        body = shape.replace("BODY", words).replace("<p>intro", f"<p>intro{i}").replace("<p>outro", f"<p>outro{i}").replace("<p>lead", f"<p>lead{i}")
        return f"<html><body><div class='top'>Daily Site</div>{body}<p>Owned by us</p></body></html>"

    shapes = {
        "<div class=post><h1>Title</h1><p>intro</p><div class=content><p>BODY</p></div><p>outro</p></div>": ["Title", "intro", "outro"],
        "<main><h1>Title</h1><p>lead</p><article><p>BODY</p></article></main>": ["Title", "lead"],
        "<div class=page><h1>Site</h1><article><h1>Title</h1><p>BODY</p></article></div>": ["Title"],
        "<div class=page><div class=list>Links</div><p>near</p><div class=content><p>BODY</p></div></div>": [],
    }
    for shape, around in shapes.items():
        text = templates.main_text(page("", shape), None).split("\n")
        assert [line for line in text if " " not in line] == around, shape
    for n in (1, 2, 5):
        rows = [(i, f"http://h{j}.example/{i}", page(i, shape)) for j, shape in enumerate([*shapes][:3]) for i in range(n)]
        pages = spark.createDataFrame(rows, "page_id long, url string, html string")
        for row in templates.extract_main_text(pages).collect():
            around = [*shapes.values()][int(row["url"][8])]
            short = [line.rstrip("0123456789") for line in row["text"].split("\n") if " " not in line]
            assert short == around, (n, row["url"])


def test_tokens_without_one_order_leave_their_class(spark):
    def page(i):
        parts = [f"<div class='{c}'>{c} text</div>" for c in ("a", "b")]
        own = f"<div class='post'><p>{' '.join(f'w{i}x{k}' for k in range(40))}</p></div>"
        return f"<html><body>{''.join(parts[:: 1 if i % 2 else -1])}<div class='c'>c text</div>{own}</body></html>"

    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    (template,) = templates.host_templates(pages).collect()
    assert template["container"] == "/html/body/div.post"
    assert [f["path"] for f in template["fixed"]] == ["/html/body/div.c"]


def test_page_text_on_whole_table(spark):
    import html as entities

    pages = {r["page_id"]: r["html"] for r in table(spark, FOLDER, "pages").collect()}
    rows = QUERIES["op6_template_text"](spark, FOLDER).collect()
    assert len(rows) == len(pages)
    for row in rows:
        inner = re.search("<article>(.*)</article>", pages[row["page_id"]], re.S)[1]
        parts = (" ".join(entities.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner))
        assert row["text"] == "\n".join(p for p in parts if p)


# --- lines


def test_repeated_lines_leave_all_documents_but_one(spark):
    line, short = "É" + "x" * 39, "y" * 39
    texts = [f"{line}\n{short}\nown {i}" for i in range(4)] + [f"  {line}\x0b \n{line.replace('x', 'X')}", line.lower(), None, ""]
    rows = [(i, t, "x", "y", [i]) for i, t in enumerate(texts)] + [(4, texts[4], "x", "y", None), (None, line, "x", "y", None)]
    out = lines.drop_repeated_lines(spark.createDataFrame(rows, DOC)).collect()
    assert len(out) == len(rows)
    by_id = {r["doc_id"]: r for r in out if r["doc_id"] != 4}
    for i in range(4):
        assert by_id[i]["text"] == f"{short}\nown {i}" and by_id[i]["n_dropped"] == 1 and by_id[i]["n_lines"] == 3
    assert [r["text"] for r in out if r["doc_id"] == 4] == [texts[4]] * 2  # the largest id that holds it
    assert by_id[5]["text"] == texts[5]  # é is not É: another key
    assert by_id[6]["text"] is None and by_id[6]["n_lines"] == 1 and by_id[7]["n_lines"] == 1
    assert by_id[None]["text"] == line
    assert out[0]["score"] == "y"


# --- near copies


def plain_components(texts, width, percent=80):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(width, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            top[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def copies(rng):
    """Groups of copies with edits of all strengths, chains and a passage that many share."""
    def text(n):
        return [f"w{rng.integers(4000)}" for _ in range(n)]

    texts = [None, "", "  ", "One", "one", "two words", "Two  words\n", "a b c d", "a b c d e"]
    passage = text(60)
    for _ in range(60):
        texts.append(" ".join(passage + text(int(rng.integers(5, 60)))))
    for size, edits in ((2, 1), (3, 4), (8, 6), (90, 8), (40, 3)):
        base = text(int(rng.integers(60, 200)))
        for _ in range(size):
            copy = list(base)
            for _ in range(int(rng.integers(0, edits + 1))):
                copy[int(rng.integers(len(copy)))] = f"e{rng.integers(10**6)}"
            texts.append(" ".join(copy))
    chain = text(100)
    for i in range(12):
        texts.append(" ".join([f"c{i}-{j}" for j in range(i * 3)] + chain[i * 3 :]))
    return texts + [texts[-1]] * 5 + [" ".join(text(20_000))]


@pytest.mark.parametrize("block", [400, 7])
def test_near_copies_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK_NODES", block)
    texts = copies(np.random.default_rng(4))
    rows = near_copies.near_copies(frame(spark, texts), width=4).orderBy("doc_id").collect()
    want = plain_components(texts, 4)
    assert [(r["n_shingles"], r["component_id"]) for r in rows] == want
    assert [r["kept"] for r in rows] == [c == i for i, (_, c) in enumerate(want)]


def test_links_at_the_threshold_are_rarely_missed():
    import math

    n = near_copies.COORDINATES
    missed = sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(near_copies.MATCHES))
    assert missed < 1 / 200_000


def test_near_copies_of_rows_without_or_with_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (2, "A b c d e f"), (2, "A b c d e f"), (9, None), (9, None)]
    out = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in out)
    assert [g for g in got if g[0] > 0] == [(2, 2, True), (2, 2, True), (4, 2, False), (9, 9, True), (9, 9, True)]
    assert got[0][2] is True


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert got == want


# --- quality


def test_quality_model_tells_classes_apart(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    model = quality.train(docs, labels)
    rows = (
        quality.score_documents(docs, model)
        .join(labels, "doc_id")
        .where(quality.held_out(F.col("doc_id")))
        .select("quality", "score", "predicted")
        .collect()
    )
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    wins = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(bad) >= 5 and wins > 0.98
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


def test_one_long_document_does_not_end_the_sample(spark):
    ids = [r[0] for r in spark.range(300).where(~quality.held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").collect()]
    texts = {i: "good words here" if i % 2 else "bad stuff there" for i in ids}
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")

    def odds(first):
        rows = [(i, first if i == ids[0] else text) for i, text in texts.items()]
        model = quality.train(spark.createDataFrame(rows, "doc_id long, text string"), labels, chars=5000)
        return model.score("good words here") - model.score("bad stuff there")

    # Longer than all characters together, and one that would leave nearly none.
    assert odds("long " * 2000) > 0.2 and odds("x" * 4990) > 0.2


def test_quality_scores_have_a_value_for_every_row(spark):
    blank = quality.train(frame(spark, ["a"]), spark.createDataFrame([], "doc_id long, quality int"))
    rows = quality.score_documents(frame(spark, [None, "", "a a a", "x" * 100_000]), blank).collect()
    assert [r["score"] for r in rows] == [0.5] * 4 and [r["predicted"] for r in rows] == [1] * 4
    assert rows[0]["n_lines"] == "x"
    texts = ["good words here"] * 8 + ["bad!! bad!! bad!!"] * 8
    model = quality.fit(texts, [1] * 8 + [0] * 8)
    assert model.score("good words") > 0.5 > model.score("bad!! bad!!")
    assert 0 < model.score("") < 1


def test_held_out_rows_are_not_learnt(spark):
    ids = range(200)
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    held = {r[0] for r in docs.where(quality.held_out(F.col("doc_id"))).select("doc_id").collect()}
    assert held == {i for i in ids if zlib.crc32(str(i).encode()) % 5 == 0}


# --- neighbours


def test_hilbert_order_steps_to_neighbouring_cells():
    for axes, bits in ((1, 4), (2, 4), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        keys = hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def plain_nearest(rows, k=20):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in good:
        if q % 20 == 0:
            scored = sorted((-float(sum(a * b for a, b in zip(x, y))), i) for i, y in good if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_nearest_leaves_out_bad_vectors_and_settles_ties(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=5) * rng.integers(1, 4)]) for i in range(150)]
    hot = rows[3][1]
    rows += [(i, hot) for i in range(200, 320)]
    rows += [(400, None), (420, []), (440, [0.0] * 5), (460, [1.0, None, 0.0, 0.0, 0.0]), (480, [float("nan")] * 5), (500, [float("inf")] * 5), (None, hot)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = plain_nearest(rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]])


def test_nearest_of_ids_with_several_vectors(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.5, 1.0]), (3, [0.2, 0.9]), (4, [0.9, 0.1]), (4, [0.9, 0.1]), (5, [0.0, 2.0])]
    rows += [(40, [float(i), 1.0]) for i in range(60)] + [(i, [0.1 * i, -1.0]) for i in range(61, 79)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df).orderBy("query_id", "rank", "score").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    distinct = sorted({(i, tuple(v)) for i, v in rows})
    want = {}
    for q, x in distinct:
        if q % 20 == 0:
            scored = sorted((-(x[0] * y[0] + x[1] * y[1]), i) for i, y in distinct if i != q)
            want.setdefault(q, []).extend((n, i, -s) for n, (s, i) in enumerate(scored[:20], 1))
    assert got.keys() == want.keys()
    for q in want:
        assert len(got[q]) == len(want[q])
        for (n, _, s), (m, _, t) in zip(sorted(got[q], key=lambda r: (r[0], r[2])), sorted(want[q], key=lambda r: (r[0], r[2]))):
            assert n == m and np.isclose(s, t)
    assert 20 not in {i for _, i, _ in got[20]} and 40 not in {i for _, i, _ in got[40]}


def test_recall_with_many_ranges(spark):
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r[0], list(r[1])) for r in vectors.select("vec_id", "embedding").collect()]
    want = plain_nearest(rows)
    found = neighbours.nearest(vectors, min_range=40, block=60).collect()
    hits = sum(r["vec_id"] in {i for i, _ in want[r["query_id"]]} for r in found)
    assert len(found) == 20 * len(want) and hits >= 0.9 * len(found)


# --- empty tables


def test_empty_tables_give_empty_results(spark):
    docs = frame(spark, ["x"]).limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    empty = [
        privacy.sanitise(docs),
        token_files.token_round_trip(docs, BYTE_BPE),
        trie_bpe.encode_and_decode(docs, WORD_BPE),
        warc.archive_round_trip(pages),
        decontaminate.find_leaks(docs, spark.createDataFrame([], "item_id long, text string")),
        templates.extract_main_text(pages),
        lines.drop_repeated_lines(docs),
        near_copies.near_copies(docs),
        quality.score_documents(docs, quality.Model.blank()),
        neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")),
    ]
    assert [df.count() for df in empty] == [0] * 10


def test_ranges_of_boundaries_equal_the_values():
    rng = np.random.default_rng(6)
    for count, largest in ((1, 0), (5, 9), (3000, 50_000), (2000, 3)):
        values = np.sort(rng.integers(0, largest + 1, count))
        coded = EliasFano.from_bytes(EliasFano.encode(values).to_bytes())
        for _ in range(30):
            a, b = sorted(rng.integers(0, count + 1, 2).tolist())
            assert np.array_equal(coded.range(a, b), values[a:b])
        assert [coded.select(i) for i in range(min(count, 50))] == values[:50].tolist()


def test_words_at_line_ends_are_encoded_as_by_the_library():
    encode = token_files.SpacedEncoder(BYTE_BPE)
    texts = ["one two\nthree four", "a\n\nb c\n d", "x\r\ny z\n\tw", " \nlead", "end\n", "é\nü ß\nß's\n's", "a\n b\n\n\nc d\ne\nf", ""]
    texts += ["\n".join(texts), " ".join(texts), "it's\nwe'll go\n1\n2 3\n-4"]
    texts += ["one. one, one! two.\ntwo; . .. a.b. 3. é: it's. ế, x\n.", "One.", "é!", ". one", "two.\n\nthree? ²."]
    library = Tokenizer.from_file(BYTE_BPE)
    for _ in range(2):  # with an empty memo, then a full one
        for packed, text in zip(encode.encode(texts), texts):
            assert np.frombuffer(packed, encode.type).tolist() == library.encode(text, add_special_tokens=False).ids


class Counting:
    """A tokenizer that counts the texts it is asked to encode."""

    def __init__(self, inner):
        self.inner, self.texts = inner, 0

    def __getattr__(self, name):
        def call(texts, **options):
            self.texts += 1 if isinstance(texts, str) else len(texts)
            return getattr(self.inner, name)(texts, **options)

        return call


def test_words_of_letters_are_handed_to_the_library_together():
    words = ["".join(w) for w in itertools.product("abcdé", repeat=4)]
    text = "x " + " ".join(w + sign for w in words for sign in ("", ",", "&&&", ".%%"))
    encode = token_files.SpacedEncoder(BYTE_BPE)
    encode.tokenizer = Counting(encode.tokenizer)
    [packed] = encode.encode([text])
    want = Tokenizer.from_file(BYTE_BPE).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packed, encode.type).tolist() == want
    assert encode.tokenizer.texts < 20


def odd_texts(n, seed):
    """Texts of letters, signs, spaces and special tokens in any order."""
    rng = np.random.default_rng(seed)
    parts = [*"abTs'.,;&%-_<|>1²", *" \n\t\u00a0\u200b\u3000\x1c", *"éÉßİſµªΣς\u0301中", " ", " ", "\n", "the", "ing", "'s", "<|endoftext|>"]
    return ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(n)]


def test_odd_texts_are_encoded_as_by_the_library(monkeypatch):
    for module in (token_files, trie_bpe):
        monkeypatch.setattr(module, "MEMO", 300)
    spaced, words = token_files.SpacedEncoder(BYTE_BPE), trie_bpe.WordEncoder(WORD_BPE)
    bytes_bpe, word_bpe = Tokenizer.from_file(BYTE_BPE), Tokenizer.from_file(WORD_BPE)
    for seed in range(30):
        texts = odd_texts(50, seed)
        for text, packed, (n, ids, decoded) in zip(texts, spaced.encode(texts), words.encode(texts)):
            assert np.frombuffer(packed, spaced.type).tolist() == bytes_bpe.encode(text, add_special_tokens=False).ids
            want = word_bpe.encode(text, add_special_tokens=False).ids
            assert (n, ids) == (len(want), " ".join(map(str, want)))
            assert decoded == word_bpe.decode(want, skip_special_tokens=False)


def test_workers_keep_nothing_of_texts_between_tasks(spark):
    docs = frame(spark, [f"wort{i} text{i} gone{i} by{i}" for i in range(200)])
    trie_bpe.encode_and_decode(docs, WORD_BPE).collect()
    near_copies._sets(docs, 2).collect()

    def kept(batches):
        encoder = trie_bpe.word_encoder(WORD_BPE)
        sizes = [len(x) for x in (encoder.ids, encoder.number, encoder.piece_ids, encoder.encoder.pairs, near_copies._words)]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(sizes)] * batch.num_rows, pa.int64())], names=["n"])

    assert {r["n"] for r in spark.range(32, numPartitions=16).mapInArrow(kept, "n long").collect()} == {0}


def test_memos_are_bounded_by_characters(monkeypatch):
    monkeypatch.setattr(trie_bpe, "MEMO_CHARS", 5000)
    monkeypatch.setattr(quality, "MEMO_CHARS", 500)
    words, library = trie_bpe.WordEncoder(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    model = quality.Model(np.linspace(-1, 1, 64).astype(np.float32), 0.1)
    for i in range(30):
        text = f"{i}" + "long" * 60 + f" and again and {i}"
        [(n, ids, _)] = words.encode([text])
        want = library.encode(text, add_special_tokens=False).ids
        assert (n, ids) == (len(want), " ".join(map(str, want)))
        assert model.score(text) == quality.Model(model.margin, model.bias).score(text)
        assert len(words.ids) < 25 and sum(map(len, model.known)) < 1000


def test_a_carried_text_is_sent_once(spark):
    docs = frame(spark, ["a b c", None, ""])
    model = quality.Model(np.linspace(-1, 1, 64).astype(np.float32), 0.1)
    rows = quality.score_documents(docs, model, carry=["text", "doc_id"])
    assert "_text" not in rows._jdf.queryExecution().analyzed().toString()
    alone = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, model, carry=["doc_id"]).collect()}
    found = {r["doc_id"]: (r["text"], r["score"]) for r in rows.collect()}
    assert found == {i: (t, alone[i]) for i, t in enumerate(["a b c", None, ""])}


def test_files_are_read_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_DOCS", 20)
    docs = frame(spark, [f"text {i}" for i in range(200)])
    rows = token_files.token_round_trip(docs, BYTE_BPE)
    assert rows.select(F.spark_partition_id()).distinct().count() > 3
    assert [r["doc_id"] for r in rows.orderBy("start").collect()] == list(range(200))
