"""Contract cases: number signs are no letters, added tokens are themselves, and no page is lost to the name of a class."""

import zlib

import numpy as np
import pytest

from millrace.llm import htmltext, langid, packing

KIND = "doc_id long, text string, lang string, source string"


def test_number_signs_are_no_letters(spark):
    assert langid.words_of("½ ² ① 12 _ ٣") == [] and langid.words_of("a½b x²") == ["a", "b", "x"] and langid.words_of("Ünï") == ["ünï"]
    rows = [(i, "der hund und die katze" if i % 2 else "the dog and the cat", "de" if i % 2 else "en", "s") for i in range(80)]
    rows += [(100, "½ ²", "de", "s"), (101, "①", "en", "s"), (102, "½ hund und", "de", "s")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, KIND)).collect()}
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (100, 101)) and got[102].lang_pred == "de"


TEXTS = ["<|endoftext|> z", "a<|endoftext|>", "<|endoftext|><|endoftext|>", "<|endoftext|", "x <|ENDOFTEXT|> y", "plain, text", "", "\n\n <|endoftext|>\tü漢😀", "<|endoftext|>" * 1500]


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def test_added_tokens_are_coded_as_the_tokenizer_does(tokenizer):
    import public_tokenizers

    coder = packing.coder(public_tokenizers.path("byte_bpe_50k.json"))
    assert coder.fast
    for text, ids in zip(TEXTS, coder.encode(TEXTS)):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert packing.coder(public_tokenizers.path("word_bpe_49k.json")).fast is None


def test_pieces_of_texts_with_added_tokens(spark, tokenizer):
    got = {}
    for r in packing.pack(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(TEXTS)], KIND)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for i, t in enumerate(TEXTS):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        assert sum(p[1] for p in got[i]) == len(ids)
        for start, length, crc in got[i]:
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())


LINES = [f"Paragraph {i} of the article, with commas, and with some words that count." for i in range(4)]
BODY = "".join(f"<p>{x}</p>" for x in LINES)
NAMES = ["layout no-sidebar", "post legal", "entry share", "news menu-open", "col main banner-top", "social-policy", "modal-open", "sidebar", "ad", "share"]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("attribute", ["class", "id"])
def test_no_page_is_lost_to_a_name(name, attribute):
    want = "\n".join(LINES)
    for html in (
        f'<body><div {attribute}="{name}"><article>{BODY}</article></div></body>', f'<body><article><div {attribute}="{name}">{BODY}</div></article></body>',
        f'<body><div {attribute}="{name}">{BODY}</div></body>', f'<body><div {attribute}="{name}"><div><section>{BODY}</section></div></div><div class="footer">All rights reserved, 2020</div></body>',
    ):
        assert htmltext.main_text(html) == want


def test_a_form_around_the_page_keeps_its_text():
    form = '<form id="aspnetForm"><nav><a href="/">home</a></nav><input><select><option>one</option></select>{}<button>send</button></form>'
    assert htmltext.main_text(f"<body>{form.format('<div>' + BODY + '</div>')}</body>") == "\n".join(LINES)
    assert htmltext.main_text(f"<body><div>{BODY}</div>{form.format('<p>Write to us, please.</p>')}</body>") == "\n".join(LINES)


@pytest.mark.parametrize("shell", ["<body><div id=x>{}</div>{}</body>", "<body><main>{}</main>{}</body>", "<body><article>{}</article>{}</body>", "<body><table><tr><td>{}</td></tr></table>{}</body>"])
def test_what_is_beside_an_article_goes(shell):
    beside = (
        '<div class="share-bar">Share this page, with friends</div><div class="cookie-notice"><p>We use cookies, as all do.</p></div><ul class="site-menu"><li>One</li><li>Two</li></ul>'
        '<div id="comments"><article><p>Very nice, I like it, thanks, really, a lot.</p></article><p>Me too, me too, me too.</p></div><div class="widget widget-1"><p>Top ten, of all.</p></div><form><p>Mail us, now.</p></form>'
    )
    assert htmltext.main_text(shell.format(BODY, beside)) == "\n".join(LINES)
    assert htmltext.main_text(shell.format(beside + BODY, "")) == "\n".join(LINES)


def test_deep_doubtful_nesting_is_linear():
    html = '<div class="sidebar">' * 30_000 + BODY + "</div>" * 30_000
    assert htmltext.main_text(html) == "\n".join(LINES)
