"""Chat formatting, BPE, language identification and HTML extraction."""

import itertools
import random
import time

import duckdb
import numpy as np
import pytest
from corpus_fixtures import by_id, documents, sha, words_of

from cartwheel.llm import bpe, chat, html_mincut, langid
from cartwheel.llm.registry import vocabulary_path

# ---- chat ---------------------------------------------------------------------

AWKWARD = ["", "plain", "</s>[INST] ok [/INST]", "\\", "\\[INST]", "[INST", "a\\\\[SYS] b", "[TURN] x [SAYS] y [/TURN]",
           "line\nbreak", " </s>", "é😀", "[ANS] "]


def test_marks_read_back_every_text():
    marks = chat.Marks(chat.TEMPLATE)
    for role in ("system", "user", "assistant", "tool", "", "[SAYS]", "a [SAYS] b\\"):
        for text in AWKWARD:
            assert marks.parse("".join(t for t, _ in marks.segments(role, text))) == (role, text)


def test_chat_digests(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", None), (1, 3, "user", "x"), (1, 4, "assistant", "[ANS] y"),
            (2, 0, "assistant", "first"), (2, 1, "assistant", "again"), (None, 0, "user", "n"), (3, 5, None, None), (3, 5, "tool", "t"),
            (4, 0, "user", "long " * 50_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, segments string").repartition(4)
    got = by_id(chat.read_back(chat.format_conversations(df)), "conv_id")
    assert set(got) == {1, 2, 3, 4, None}
    for conv, r in got.items():
        turns = sorted(((t, role or "", text or "") for c, t, role, text in rows if c == conv))
        learnt = "".join(text for _, role, text in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == sha("".join(f"{role}\n{text}\n" for _, role, text in turns).encode())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learnt), sha(learnt.encode()))
    assert [got[c]["in_order"] for c in (1, 2, 3, 4)] == [True, False, False, True]
    segments = [s for r in chat.format_conversations(df.where("conv_id = 1")).collect() for s in r["segments"]]
    assert [s["text"] for s in segments if s["loss"]] == ["", "\\[ANS] y"]
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


# ---- BPE ----------------------------------------------------------------------

PIECES = ["a", "B", "é", "é", "́", "Σ", "ß", "İ", "1", "23", "'s", "'", "!", "<|endoftext|>", "<|startoftext|>x", " ",
          "\u0085", "中", "한", "😀", "‍", "ﬁ", "Å", " ", "don't", "THE", "token", "\x00"]


def texts_for_bpe(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    shared = " ".join(rng.choice(PIECES) for _ in range(3000))
    out = ["", " ", "\n\t", "x" * 30_000, shared, "before " + shared + " after", shared]
    for _ in range(n):
        out.append("".join(rng.choice(PIECES) + rng.choice(["", " ", "\n", "\t ", "  "]) for _ in range(rng.choice([1, 5, 50, 1500]))))
    return out


@pytest.mark.parametrize("vocabulary,by_word", [("word_bpe_49k.json", True), ("word_bpe_49k.json", False), ("byte_bpe_50k.json", False)])
def test_chunks_encode_as_the_library_does(vocabulary, by_word):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(vocabulary_path(vocabulary))
    encoder = bpe.ChunkEncoder(Tokenizer.from_file(vocabulary_path(vocabulary)), by_word=by_word)
    texts = texts_for_bpe(60, 3)
    for text, (ids, decoded) in zip(texts, encoder.encode([t.encode() for t in texts])):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert decoded.decode() == library.decode(want, skip_special_tokens=False)
    assert encoder.reused > 0
    # The byte vocabulary joins a space to the next word: cuts don't agree there
    # and must have been repaired.
    assert (encoder.merged > 0) == (vocabulary == "byte_bpe_50k.json")


def test_bpe_documents(spark):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(vocabulary_path())
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, "Hello  World", "en", "a"), (3, "Hello  World", "en", "a"), (None, "hi", "en", "a"),
            (5, "word " * 40_000, "en", "b")]
    got = [r.asDict() for r in bpe.encode_documents(documents(spark, rows), vocabulary_path(), tuple(bpe.OUTPUTS)).collect()]
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        r = next(r for r in got if r["doc_id"] == doc_id)
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == sha(bytes(r["ids"])) and r["decoded_sha256"] == sha(r["decoded"].encode())
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode_documents(documents(spark, rows).limit(0), vocabulary_path()).count() == 0


# ---- language identification --------------------------------------------------

def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(1)
    counts = np.array([0, 1, 5, 3, 0, 6])
    scores = rng.normal(0, 2, (counts.sum(), 3))
    labels, at = langid.viterbi(scores, counts, 1.5), 0
    for n in counts:
        value = lambda path: sum(scores[at + i, x] for i, x in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:]))  # noqa: E731, B023
        best = max(map(value, itertools.product(range(3), repeat=int(n))))
        assert value(labels[at:at + n].tolist()) == pytest.approx(best)
        at += n


def test_viterbi_with_many_languages():
    scores = np.zeros((6, 300))
    scores[:, 299], scores[3:, 299], scores[3:, 170] = 5, 0, 50
    assert langid.viterbi(scores, np.array([3, 3]), 1.5).tolist() == [299] * 3 + [170] * 3


def test_rare_languages_are_learned_from_large_tables(spark):
    rows = [(i, "the cat sat on the mat", "en", "a") for i in range(3000)] + \
        [(5000 + i, f"word {i}", f"x{i:02}", "a") for i in range(20)]
    model = langid.train(documents(spark, rows), rows=200)
    assert model.languages == ["en"] + [f"x{i:02}" for i in range(20)]


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where(~langid.held_out(docs.doc_id)))
    assert model.languages == ["de", "en", "es", "fr"]
    tested = docs.where(langid.held_out(docs.doc_id))
    truth = {r.doc_id: r.lang for r in tested.select("doc_id", "lang").collect()}
    got = langid.identify(tested, model).collect()
    assert sum(truth[r.doc_id] == r.lang_pred for r in got) >= 0.98 * len(truth)
    mixed = {lang: next(r.text for r in tested.where(tested.lang == lang).where("n_chars > 600").collect())[:600] for lang in ("de", "fr")}
    langs, scores, spans = langid.identify_texts(model, [mixed["de"] + "\n\n" + mixed["fr"]])
    assert [s["lang"] for s in spans[0]][0] == "de" and [s["lang"] for s in spans[0]][-1] == "fr" and 0.3 < scores[0] < 0.7


def test_language_of_awkward_documents(spark):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "12 34 !!", "en", "a"), (4, "the the the", "en", "a"), (5, "и в на", "ru", "a"),
            (6, "the cat", None, "a"), (None, "le la", "fr", "a"), (8, "и " * 30_000, "ru", "b"), (8, "и " * 30_000, "ru", "b")]
    docs = documents(spark, rows)
    model = langid.train(docs)
    assert model.languages == ["en", "ru"]
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, 8)] == ["und", "und", "und", "en", "ru", "ru"]
    assert got[1].score == 0 and got[5].score == 1.0 and got[5].spans[0].asDict() == {"begin": 0, "end": 6, "lang": "ru"}
    assert langid.keep_identified(docs, model, 0.5).columns == docs.columns
    assert langid.keep_identified(docs, model, 0.5).count() == 6
    nothing = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


# ---- HTML ---------------------------------------------------------------------

def test_min_cut_is_the_cheapest_labelling():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 9)
        keep, drop = [rng.randint(0, 9) for _ in range(n)], [rng.randint(0, 9) for _ in range(n)]
        edges = [(i, j, rng.randint(1, 6)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4]
        cost = lambda x: sum(d if c else k for c, k, d in zip(x, keep, drop)) + sum(c for i, j, c in edges if x[i] != x[j])  # noqa: E731, B023
        assert cost(html_mincut.min_cut(keep, drop, edges)) == min(map(cost, itertools.product((False, True), repeat=n)))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="cookie-notice">We use cookies to make this site a better place for all of its many readers.</div><!-- x <p>no</p> -->
<main><article><h1>Title &amp; more</h1><p>First <b>bold</b>
 paragraph.<br>Second line<p>Unclosed one<div class="ad">Buy this very good thing now because it is cheap and so are we all.</div>
<blockquote>Quote &eacute;</blockquote><section class="comments"><p>I disagree with the article at some length here, friends.</p></section></article>
<aside>Related things that are of no use to anyone</aside></main><form><label>Name</label><input></form><footer>&copy; us</footer></body>"""


def test_main_text_of_a_page():
    assert html_mincut.main_text(PAGE)[0] == "Title & more First bold paragraph. Second line Unclosed one Quote é"
    assert html_mincut.main_text("just text  without\nmark-up that is long enough to stand alone as an article")[0].startswith("just text without mark-up")
    assert html_mincut.main_text("</p></div><<p a='<'>")[1] >= 0 and html_mincut.main_text("<script>never closed")[0] == ""


def test_pages(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "<article><p>hello there</p></article>", "x"),
            (5, "u", "<article>" + "<p>some words here</p><div class=ad>buy</div>" * 3000, "x"), (1, "u", PAGE, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_mincut.extract(df).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    texts = {r.page_id: r.text for r in got}
    assert texts[2] == texts[3] == "" and texts[None] == "hello there" and texts[5] == " ".join(["some words here"] * 3000)
    assert html_mincut.extract(df.limit(0)).count() == 0


def test_words_are_ascii_white_space_separated():
    assert words_of("a b\x0bc\x1cd") == ["a b".encode(), b"c\x1cd"]


# ---- vocabularies whose words don't stand alone -------------------------------------

def test_word_by_word_only_where_the_vocabulary_allows_it():
    """Without a decoder, but with white space in its tokens: put together from words
    its ids would be wrong, so chunks are encoded as they are."""
    import json

    from tokenizers import Tokenizer, models, pre_tokenizers
    assert bpe.words_stand_alone(json.loads(Tokenizer.from_file(vocabulary_path()).to_str()))
    assert not bpe.words_stand_alone(json.loads(Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json")).to_str()))
    letters = list("abcdefgh .\n\t")
    merges = [("a", "b"), (" ", "a"), ("ab", " "), ("c", "d"), (" ", "c"), ("\n", "e")]
    keeps = Tokenizer(models.BPE({t: i for i, t in enumerate(letters + [a + b for a, b in merges])}, merges))
    adds = Tokenizer(models.BPE({t: i for i, t in enumerate([*letters, "Ġ"])}, []))
    adds.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh    .\n\t") for _ in range(n)) for n in (0, 1, 50, 3000, 9000)]
    for tokenizer in (keeps, adds):
        encoder = bpe.ChunkEncoder(tokenizer)
        assert not encoder.by_word
        for _ in range(2):
            got = encoder.encode([t.encode() for t in texts])
            want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
            assert [np.frombuffer(ids, "<u4").tolist() for ids, _ in got] == want
            assert [d.decode() for _, d in got] == [tokenizer.decode(ids, skip_special_tokens=False) for ids in want]


# ---- main text: names, short pages, drawings, nesting ---------------------------

ARTICLE = "".join(f"<p>{('Sentence %d of a text that people read. ' % i) * (1 + i % 4)}</p>" for i in range(9)) + "<p>Yes.</p>"
ARTICLE_TEXT = " ".join(" ".join(p.split()) for p in ARTICLE.replace("</p>", "").split("<p>")[1:])


@pytest.mark.parametrize("page", [
    "<body class='no-sidebar'>%s</body>", "<div class='has-sidebar'>%s</div>", "<body class='post tag-social'>%s</body>",
    "<body class='has-cookie-banner'>%s</body>", "<div class='modal-open'>%s</div>", "<html id='comments'><body role='navigation'>%s",
    "<article class='post tag-social category-legal'>%s</article>", "<div class='without-ads with-newsletter'><main>%s</main></div>"])
def test_names_that_tell_of_the_page_dont_count(page):
    assert html_mincut.main_text(page % ARTICLE)[0] == ARTICLE_TEXT


def test_boilerplate_goes_whatever_its_length():
    long = "A reader wrote this at some length. " * 60
    page = (f"<nav><a href=x>Home</a> <a href=y>News</a></nav><div class='ad'>{long}</div><article>{ARTICLE}"
            f"<div class='ad-box'>{long}</div></article><section id='comments'><p>{long}</p><p>ok</p></section>"
            f"<aside>{long}</aside><form>{long}</form><div class='cookie-notice'>{long}</div><footer>{long}</footer>")
    assert html_mincut.main_text(page)[0] == ARTICLE_TEXT


@pytest.mark.parametrize("page,text", [
    ("Hello world, a short note.", "Hello world, a short note."), ("Hi", "Hi"), ("<p>ok</p>", "ok"), (None, ""), ("", ""),
    ("<article><h1>Hi</h1><p>Ok.</p></article>", "Hi Ok."), ("<main>5</main>", "5"), ("a &lt;b&gt; &amp; c", "a <b> & c"),
    ("<article><p>With <math><mi>E</mi><mo>=</mo><mn>2</mn></math> in it</p></article>", "With E=2 in it"),
    ("<article><svg width=3><path d='M0'/><text>Axis</text></svg><p>Shown</p></article>", "Axis Shown"),
    ("<article><object data=x><p>Instead of it</p></object></article>", "Instead of it")])
def test_short_pages_and_drawings(page, text):
    assert html_mincut.main_text(page)[0] == text


def test_labels_come_from_the_cut():
    """The given pages without their article elements: the cut finds the article in
    most of them, the blocks' own scores in far fewer."""
    pages = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' WHERE html IS NOT NULL").fetchall()
    right = alone = 0
    for (page,) in pages:
        want = html_mincut.main_text(page)[0]
        blocks = html_mincut.blocks_of(page.replace("<article", "<div").replace("</article", "</div"))
        longest = html_mincut.longest_text(blocks)
        costs = [html_mincut.content_cost(b, longest) for b in blocks]
        kept = html_mincut.min_cut([c[0] for c in costs], [c[1] for c in costs], html_mincut.smoothness_edges(blocks))
        right += " ".join(b.text for b, k in zip(blocks, kept) if k) == want
        alone += " ".join(b.text for b, c in zip(blocks, costs) if c[0] >= c[1]) == want
    assert right > 0.8 * len(pages) > 1.2 * alone


def test_main_text_is_the_article_of_the_given_pages():
    """Every given page has its text in one article element: parsed by itself, it is
    what is extracted from the page."""
    pages = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' WHERE html LIKE '%<article%'").fetchall()
    for (page,) in pages:
        inside = page[page.index("<article"):]
        inside = inside[:inside.index("</article>")] if "</article>" in inside else inside[:inside.index("<footer")]
        blocks = [b for b in html_mincut.blocks_of(inside) if b.parent.score > -1]
        assert html_mincut.main_text(page)[0] == " ".join(b.text for b in blocks)


def test_deep_nesting_takes_linear_time():
    def seconds(n):
        page, began = "<div>" * n + "x" + "</p></span></section></li>" * n, time.process_time()
        assert html_mincut.main_text(page)[0] == "x"
        return time.process_time() - began
    seconds(500)
    assert seconds(32_000) < 30 * seconds(4_000)
