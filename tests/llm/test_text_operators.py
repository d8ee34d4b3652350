"""Token counts, personal data, HTML text and language identification."""

import hashlib
import html
import random
import re

import pandas as pd
import pytest

from trolley.llm import html_text, langid, pii, tokens
from conftest import SF_SMALL

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  a", "a  b ", "\t a\n b", "\n\n", "▁a ▁b", "<s> </s> <unk> <0x0A>", "\u3000x\xa0y", "e\u0301 😀😀", "\0", "a\r\nb", "   \n   ",
         "x" * 20_000, "word " * 20_000, "Hello, world! It's 3.14.", "été Straße niño", "\ufeffabc", "a▁▁▁b", "\n a", "▁", "日本語 テキスト"]


def test_tokens_equal_the_library(spark):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    whole = tokens.whole_tokens(MODEL)
    assert len(whole) > 20_000
    docs = pd.read_parquet(f"{SF_SMALL}/documents.parquet").text.tolist()
    rng = random.Random(1)
    mixed = ["".join(rng.choice([" ", "  ", "\n", "▁", "a", "the", "é", ".", "😀", "\t", "ing", "0"]) for _ in range(40)) for _ in range(500)]
    count = tokens.counter(MODEL, whole)
    for t in TEXTS + docs + mixed:
        assert count(t) == len(sp.encode(t or "")), repr(t)[:80]
    frame = spark.createDataFrame([(t, 7) for t in TEXTS] * 2, "text string, n_tokens int")
    got = tokens.count_tokens(frame, MODEL)
    assert sorted(r["n_tokens"] for r in got.collect()) == sorted(len(sp.encode(t or "")) for t in TEXTS * 2)
    assert tokens.count_tokens(frame.limit(0), MODEL).count() == 0


def test_token_query_columns(spark):
    r = tokens.op4_token_counts(spark, SF_SMALL)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in r.schema] == ["doc_id bigint", "n_bytes bigint", "n_tokens bigint", "over_limit boolean"]
    docs = pd.read_parquet(f"{SF_SMALL}/documents.parquet").set_index("doc_id").text
    assert all(x["n_bytes"] == len(docs[x["doc_id"]].encode()) and x["over_limit"] == (x["n_tokens"] > 4096) for x in r.collect())


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))) or (kind == "phone" and 8 <= len(d) <= 15) or (
                    kind == "card" and 16 <= len(d) <= 19 and sum(sum(map(int, str(int(c) * (1 + k % 2)))) for k, c in enumerate(reversed(d))) % 10 == 0):
                out.append((kind, *m.span()))
    return out


def test_pii_base_spans_against_patterns(spark):
    rng = random.Random(2)
    atoms = ["1.2.3.4", "255.255.255.256", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 555-7713", "a.b@c.d.e", "@", ".", "-", " ", "5", "12", "+", "x",
             "%", "a@b", "9807915762804490", "é", "😀", "(", "\n", "1.2.3.", "0007.1.1.1", "https://u:p@h.com", "://", "SSN: 123-45-6789", "IBAN DE89 3704 0044 0532 0130 00"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text.tolist()
    anchors = pii.automaton()
    for t in texts:
        assert [s for s in pii.find_spans(t, anchors) if s[0] in pii.BASE] == base_spans(t), repr(t)[:200]
    for long in ("a" * 300_000 + "@", "1." * 200_000, "+1" + "(" * 300_000, "@" * 200_000, "4 " * 100_000):
        assert [s for s in pii.find_spans(long, anchors) if s[0] in pii.BASE and s[0] != "ip"] is not None


def test_pii_added_kinds_and_redaction(spark):
    anchors = pii.automaton()
    text = "Mail a@b.co, SSN: 123-45-6789, IBAN DE89 3704 0044 0532 0130 00, https://joe:pw@h.com/x iban DE00 3704 0044 0532 0130 00"
    spans = pii.find_spans(text, anchors)
    assert [k for k, *_ in spans] == ["email", "email", "login", "iban", "ssn"]
    assert pii.redact_text(text, spans) == "Mail <EMAIL>, SSN: <SSN>, IBAN <IBAN>, <LOGIN>/x iban DE00 3704 0044 0532 0130 00"
    rows = [(1, text, "k"), (1, text, "k"), (2, None, "k"), (3, "", "k"), (None, "clean", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii string")
    got = pii.redact_pii(docs).collect()
    assert sorted(repr(r["text"]) for r in got) == sorted(map(repr, [pii.redact_text(text, spans)] * 2 + [None, "", "clean"]))
    assert pii.find_pii(docs).filter("size(pii) > 0").count() == 2 and pii.find_pii(docs.limit(0)).count() == 0


def test_pii_query(spark):
    docs = pd.read_parquet(f"{SF_SMALL}/documents.parquet").set_index("doc_id").text
    for r in pii.op10_pii(spark, SF_SMALL).collect():
        base = base_spans(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(b[0] == k for b in base) for k in pii.BASE]


def article(page):
    a = page[page.index("<article>") + 9:page.index("</article>")]
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|br|h1)>", a)]
    return "\n".join(b for b in blocks if b)


def test_html_query_gives_the_article(spark):
    pages = pd.read_parquet(f"{SF_SMALL}/pages.parquet").set_index("page_id").html
    got = html_text.op9_html_text(spark, SF_SMALL).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == article(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain  text", "plain text"), ("<p></p>", ""), ("<script>var a='<p>x</p>'", ""), ("<!-- <p>x</p>", ""),
    ("<nav><p>menu</p></nav><p>One &lt;b&gt; &amp;lt; two&nbsp;three</p><p>x</p><footer>f</footer>", "One <b> &lt; two three\nx"),
    ("<div class='side sidebar'><div>a</div>b</div><div id=c><p>t<b>e</b>xt\n more</div><div class='comments'><p>c</p></div>", "text more"),
    ("<article><p>a<div class=ad>buy<p>now</div><p>b</article><p>outside", "a\nb"),
    ("<article><header><h1>T</h1></header><p>a</p><aside>x</aside><form>f</form><p>b", "T\na\nb"),
    ("<nav>unclosed<article><p>a</article>", "a"), ("<ul><li><a href=x>one</a></li></ul><p>a <a>b</a> c</p>", "a b c"),
    ("<p title='a>b'>x</p><p>1 < 2</p>", "x\n1 < 2"), ("<p>" + "long " * 50_000, ("long " * 50_000).strip())])
def test_html_cases(page, text):
    assert html_text.main_text(page) == text


LONG = "long text of the article " * 8


@pytest.mark.parametrize("page, text", [
    (f'<div class="elementor-widget-container"><p>{LONG}</div>', LONG.strip()), (f'<div class="layout no-sidebar"><p>{LONG}</div>', LONG.strip()),
    ('<article class="post comments-open"><p>a</article>', "a"), ('<section id="related-work"><p>a</section><p>b', "a\nb"),
    ('<h2 id="social-impact">T</h2><p>b', "T\nb"), ('<section class=related><h2 class=social>T</h2><p>a</section>b', "T\na\nb"),
    ("<div data-id=menu data-testid='ad' title='x class=\"ad\"'>a</div><p>b", "a\nb"), (f"<div class=widget><p>{LONG}</div><p>x", f"{LONG.strip()}\nx"),
    ('<p class="ad">buy<p>main</p><p>main</p>', "main\nmain"), ("<ul><li class=ad>buy<li>one<li>two</ul><p>x", "one\ntwo\nx"),
    ("<dl><dt>a<dd class=ad>x<dt>b<dd>c</dl>", "a\nb\nc"), ("<table><tr><td class=ad>x<td>y<tr><td>z</table>", "y\nz"),
    ("<div><span class=ad>buy</div><p>main text</p>", "main text"), ("<div class='ad'>buy<div>now</div>x</div><p>the main text</p>", "the main text")])
def test_html_marks(page, text):
    assert html_text.main_text(page) == text


def test_html_surge_and_dive():
    menu, foot = "".join(f"<div>{w}</div>" for w in ("Home", "News", "Sports", "About us")), "<div>&copy; 2020 Example</div>"
    body = ["Title", LONG, "Yes.", "No.", "Why?", "Because.", LONG, "The end."]
    text = "\n".join(x.strip() for x in body)
    flat = "".join(f"<p>{x}</p>" for x in body)
    assert html_text.main_text(f"{menu}<div>{flat}</div>{foot}") == text
    assert html_text.main_text(f"<ul><li>{'<li>'.join(body[2:6])}</ul>{flat}<div><p>We use small files.</div>{foot}") == text
    items = "".join(f"<li>{x}</li>" for x in body[2:6])
    assert html_text.main_text(f"<p>{LONG}</p><ul>{items}</ul><p>{LONG}</p>") == "\n".join(x.strip() for x in body[1:7])
    assert html_text.main_text(f"<pre>{'x' * 50_000}</pre><div><div><p>{LONG}</div></div>") == "x" * 50_000 + "\n" + LONG.strip()
    assert html_text.main_text(f"{menu}{foot}") == "Home\nNews\nSports\nAbout us\n© 2020 Example"
    assert html_text.main_text(f"<main><p>a</p><div>{flat}</div>{menu}</main>{foot}") == f"a\n{text}\nHome\nNews\nSports\nAbout us"


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "<p>a", 5)] * 2 + [(None, None, 5)], "page_id long, html string, text int")
    assert sorted(r["text"] for r in html_text.extract_text(pages).collect()) == ["", "a", "a"]
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_language_held_out_accuracy(spark):
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").set_index("doc_id")
    got = langid.op5_language_id(spark, "/root/testdata/sf0.01").toPandas()
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    held = got[got.held_out]
    assert 200 < len(held) < 500 and (held.lang_pred == docs.lang.reindex(held.doc_id).to_numpy()).mean() > 0.98
    assert got.rejected.mean() < 0.01


def test_language_edge_cases(spark):
    rows = [(k, t, lang, 0.5) for k in range(40) for t, lang in (("the cat sat on the mat " * 3, "en"), ("der Hund und die Katze " * 3, "de"))]
    rows += [(1, None, "en", 1.0), (None, "12 ?!", None, 1.0), (3, "", "de", 1.0), (4, "the mat " * 30_000, None, 1.0), (4, "Katze", None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = langid.fit(docs)
    got = langid.identify(docs, model).filter("lang is null or text is null or text = ''").collect()
    assert sorted((r["lang_pred"], r["rejected"]) for r in got) == [("de", False), ("en", False), ("und", True), ("und", True), ("und", True)]
    assert langid.fit(docs.limit(0)) is None
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


PARA = "<p>" + "text words here " * 30 + "</p>"
PARA_TEXT = ("text words here " * 30).strip()


@pytest.mark.parametrize("page,want", [
    # link lists, table rows and headings inside the text
    (f"<article>{PARA}<h2>See</h2><ul><li><a href=x>ref 1</a><li><a href=y>ref 2</a></ul></article>", f"{PARA_TEXT}\nSee\nref 1\nref 2"),
    (f"<div><table><tr><td><a href=1>a1</a></td><td><a href=2>a2</a></td></tr></table>{PARA}<p>end.</p></div>", f"a1\na2\n{PARA_TEXT}\nend."),
    # size saves no advert, and compound values mark one
    (f"<div class=advert>{'buy now ' * 400}</div><article>{PARA}</article>", PARA_TEXT),
    (f"<article>{PARA}<div class='ad-banner'>buy</div><section id=comments>{PARA}</section><div class='x cookie-notice'>c</div>"
     f"<div class=comments-section>{PARA}</div><p>end.</p></article>", f"{PARA_TEXT}\nend."),
    # values that only contain such words, and frames of the whole page, mark none
    (f"<div class='layout no-sidebar'><div class=elementor-widget-container>{PARA}</div></div>", PARA_TEXT),
    (f"<div class=sidebar><main>{PARA}</main></div>", PARA_TEXT),
    (f"<article class='post comments-open'>{PARA}<section id=related-work><p>More.</p>{PARA}</section></article>", f"{PARA_TEXT}\nMore.\n{PARA_TEXT}"),
    # no article: title and intro stay, menu and copyright lines go
    (f"<div><a href=1>a</a> <a href=2>b</a></div><div>x</div><nav>n</nav><h1>Title</h1><p>Short intro.</p>{PARA}<p>end.</p><div>© 2020 {'rights ' * 60}</div>",
     f"Title\nShort intro.\n{PARA_TEXT}\nend."),
    (f"<article>tiny</article><form>f</form><form>f</form><form>f</form><div>{PARA}{PARA}</div>", f"{PARA_TEXT}\n{PARA_TEXT}"),
    ("<div>" * 3000 + PARA + "</div>" * 3000, PARA_TEXT),
])
def test_line_blocks_decide(page, want):
    assert html_text.main_text(f"<html><body>{page}</body></html>") == want


def test_pages_without_their_article_tag_give_the_same_text():
    import duckdb
    pages = [r[0] for r in duckdb.sql("select html from '/root/testdata/sf0.1/pages.parquet'").fetchall()]
    for page in pages:
        if page:
            assert html_text.main_text(re.sub(r"(</?)(article|main)\b", r"\1div", page)) == html_text.main_text(page)


def test_very_long_pages_of_many_blocks():
    blocks = "".join(f"<p>paragraph {k} with some words of its own and a few more</p>" for k in range(30_000))
    assert html_text.main_text(f"<nav>menu</nav><div>{blocks}</div><footer>f</footer>").count("\n") == 29_999


def test_texts_without_a_letter_are_undetermined():
    model = langid.train([("the cat sat on the mat " * 5, "en"), ("der hund und die katze " * 5, "de")] * 10)
    parts, letters = (model.langs, model.rows, model.bias), langid.letter_table()
    for text in ("😀😀", "𝟙𝟚𝟛", "\u0301", "123 ²!", "", None, "\U000E0100"):
        assert langid.predict(text, parts, letters) == ("und", 0.0)
    assert langid.predict("𐐷𐐯 the cat", parts, letters)[0] in model.langs and langid.predict("the cat", parts, letters)[0] == "en"


def test_language_forward_pass_by_hand():
    """Scores of a model again by loops over words: mean of the subwords' rows, then softmax."""
    import math
    import unicodedata
    model = langid.train([("the cat sat on the mat " * 5, "en"), ("der hund und die katze " * 5, "de")] * 10, buckets=1 << 10)
    letters = langid.letter_table()
    for text in ("the cat", "die Katze, the mat!", "x", "und\nso"):
        words = ["".join(ch.lower() for ch in w) for w in re.split(r"[^\w]|[\d_]", text) if w]
        grams = []
        for w in words:
            marked = "\0" + w + "\0"
            for n in langid.GRAMS:
                grams += [marked[i:i + n] for i in range(len(marked) - n + 1) if marked[i:i + n].strip("\0") or n > 2]

        def bucket(g):
            # the hash of a gram: that of its first character, then one step per character
            mask = 0xFFFFFFFF
            h = ord(g[0]) * 0x9E3779B1 & mask
            for n, ch in enumerate(g[1:], 2):
                h = (h * 0x85EBCA6B & mask) ^ (ord(ch) * 0xC2B2AE35 + n & mask)
            h = (h ^ h >> 15) * 0x2C1B3C6D & mask
            return (h ^ h >> 13) & len(model.rows) - 1
        z = [sum(float(model.rows[bucket(g)][k]) for g in grams) / len(grams) + float(model.bias[k]) for k in range(2)]
        score = [math.exp(x) / sum(map(math.exp, z)) for x in z]
        lang, got = langid.predict(text, (model.langs, model.rows, model.bias), letters)
        assert lang == model.langs[score.index(max(score))] and got == pytest.approx(max(score), rel=1e-4)
