"""Operators 4, 5, 6 and 9 against plain versions, and on odd rows."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from spoolyard.llm import bpe, chat_format, html_text, quality

ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "a null id here"), (5, "same text"), (5, "same text"), (6, "x" * 3000 + " " + "y z " * 2000), (7, "é漢字🙂 </s> [INST] ~t \x00")]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with nulls, empty and long texts, repeats, and columns whose names the operators use inside."""
    rows = [(i, t, None, 1, "b") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, h string, n int, bucket string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# operator 5


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(*bpe.public_ranks())


def test_bpe_is_tiktoken(vocabulary):
    import tiktoken

    ranks, pattern = bpe.public_ranks()
    plain = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=plain, special_tokens={})
    pick = random.Random(7)
    alphabet = "aàé  \n\t'sthe 1239!?#€漢字🙂​Àñ\x00ing"
    texts = ["".join(pick.choices(alphabet, k=pick.randint(0, 200))) for _ in range(400)]
    texts += ["".join(pick.choices("abcdefgh", k=pick.randint(1, 700))) for _ in range(60)]
    texts += ["", " ", "a" * 1000, " " * 1000, "ab" * 500 + "!" * 300, "don't we'll I'VE"]
    for text, ids in zip(texts, vocabulary.encode(texts), strict=True):
        assert ids.tolist() == encoding.encode_ordinary(text)
        assert vocabulary.decode(ids) == text.encode()


def test_bpe_long_pieces_merge_like_short_ones(vocabulary):
    for piece in (b"internationalization" * 6, b"  " * 60, b"aaab" * 30):
        flat, start, size = vocabulary.encode_pieces([piece])
        assert flat[start[0] :][: size[0]].tolist() == vocabulary._merge_long(piece).tolist()


def test_bpe_rows(odd, none, vocabulary):
    rows = bpe.encode(odd, *bpe.public_ranks(), decoded=True).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((i is None, i or 0) for i, _ in ODD)
    for r in rows:
        assert r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(bytes(r.decoded)).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
    assert Counter(bytes(r.decoded).decode() for r in rows) == Counter(t or "" for _, t in ODD)
    back = bpe.decode(bpe.encode(odd, *bpe.public_ranks()), *bpe.public_ranks())
    assert Counter(bytes(r.decoded).decode() for r in back.collect()) == Counter(t or "" for _, t in ODD)
    assert bpe.encode(none, *bpe.public_ranks()).count() == 0


# operator 4


def plain_base(s):
    w = re.findall(r"[^\x20\x09-\x0D]+", s)
    lines = s.split("\n")
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    twice = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", s)), twice, len(covered)


def test_base_counts():
    pick = random.Random(3)
    texts = ["", " \n \n", "a\xa0b c d", "x\n\nx\n x\nx", "a b c d e " * 4, "1 2 3 4 5 6 1 2 3 4 5", "#*$%&|<> &&"]
    texts += [" ".join(pick.choices(["a", "b", "c\n", "\n", "d#"], k=pick.randint(0, 60))) for _ in range(200)]
    for s in texts:
        assert quality.base_counts(s) == plain_base(s), s
    assert quality.base_counts(None) == (0, 0, 0, 0, 0)


def test_threshold_is_deterministic():
    assert quality.choose_threshold([]) == -float("inf") == quality.choose_threshold([(1, 5, 0)])
    bins = [(-100, 0, 10), (-50, 0, 5), (10, 90, 0), (11, 10, 0)]
    assert quality.choose_threshold(bins) == pytest.approx(-49 * quality.STEP)


def test_quality_parts_prose_from_junk(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").where("not base_failed").collect()
    assert {(r.quality, r.kept) for r in rows} == {(0, False), (1, True)}


def test_ratios_by_hand():
    raw, good = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    raw[:2], good[0] = (6, 2), 4
    ratio = quality.log_ratios(raw, good)
    assert ratio[0] == pytest.approx(np.log((1 + 1e-2 / quality.BUCKETS) / (0.75 + 1e-2 / quality.BUCKETS)))
    assert ratio[1] < -5 and ratio[5] == 0
    assert not quality.log_ratios(raw, np.zeros(quality.BUCKETS)).any()


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (5, 0), (6, 0), (None, 1), (1, None)], "doc_id long, quality int")
    rows = quality.judge(odd, labels).collect()
    assert len(rows) == len(ODD) and all(r.base_failed and not r.kept for r in rows if r.doc_id in (1, 2, 3))
    assert quality.judge(none, labels).count() == 0
    assert all(r.llr == 0 for r in quality.judge(odd, labels.limit(0)).collect())


# operator 6

WEIGHTS = html_text.learn_weights(html_text.labelled_pages(), html_text.labelled_pages(named=False))


def test_weights_have_the_signs_of_the_method():
    assert WEIGHTS["tag"] < 0 < WEIGHTS["word"] and WEIGHTS["<article>"] > 0 > WEIGHTS["<nav>"]


def test_page_of_all_parts():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class="has-sidebar"><header>Site</header>
    <nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-banner">Accept</div><div id="content"><h1>Title &amp; more</h1>
    <p>First with <a href="q">a link</a> in<b>side</b>.<div class="advert">Buy</div><p>Second   para<br>line&nbsp;two.</p>
    <aside>Related stuff</aside><form>Subscribe <input></form><script>var x = "<p>";</script><!-- <p>no</p> --><p>Third.</p></div>
    <div class="sidebar">Side words</div><section class="comments"><div class=comment><p>A long comment of a reader who has
    many words to say about all of this and more of it.</p></div></section><footer>(c)</footer></body></html>"""
    assert html_text.extract(page, WEIGHTS) == "Title & more First with a link inside. Second para line two. Third."


def test_generated_pages(spark, sf_dir):
    import html

    for r in html_text.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.DOTALL)[1]
        want = " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>", " ", inner).replace("<b>", "")).split())
        assert r.text == want and r.n_chars == len(want)


def test_best_run_is_the_best_of_all():
    """The linear scan against all runs."""
    pick = random.Random(1)
    for _ in range(60):
        parts = [pick.choice(["<p>{}</p>", '<div class="ad">{}</div>', "<nav>{}</nav>", "<br>", "{}"]).format(" ".join("w" * pick.randint(0, 6))) for _ in range(pick.randint(1, 9))]
        page = "".join(parts)
        gains = [html_text.word_score(c, WEIGHTS) * len(t.split()) if k == "text" else WEIGHTS["tag"] for k, c, t in html_text.tokens_of(page)]
        best = max((sum(gains[i:j]) for i in range(len(gains)) for j in range(i, len(gains) + 1)), default=0)
        words = sum(len(t.split()) for k, c, t in html_text.tokens_of(page) if k == "text" and html_text.word_score(c, WEIGHTS) > 0)
        got = len(html_text.extract(page, WEIGHTS).split())
        assert (got > 0) == (best > 1e-9) and got <= words


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("plain text", "plain text"), ("<p>open <b>x<!-- never", "open x"), ("a < b &lt;c&gt;", "a < b <c>"), ("</div></nav><p>ok", "ok"), ("<nav>only menus</nav>", "")])
def test_broken_pages(page, text):
    assert html_text.extract(page, WEIGHTS) == text


@pytest.mark.parametrize(
    "wrapper",
    ['<div class="overflow-hidden">', '<div class="row has-sidebar">', '<div class="sidebar widget">', '<div class="no-ads not-hidden" data-hidden="x">', '<section title="hidden">', '<div hidden="until-found">'],
)
def test_wrappers_do_not_drop_the_article(wrapper):
    name = wrapper[1:].split()[0]
    page = f'<body>{wrapper}<article><p>The whole story of the day</p><div class="sidebar widget">More about it</div></article></{name}></body>'
    assert html_text.extract(page, WEIGHTS) == "The whole story of the day"


@pytest.mark.parametrize("tag", ["<div hidden>", '<div style="color:red; display:none">', '<div aria-hidden="true">', '<aside class="related">'])
def test_hidden_and_side_parts_stay_out(tag):
    name = tag[1:].split()[0].rstrip(">")
    page = f"<body><article><p>The whole story of the day</p></article>{tag}<article>Nothing to see</article></{name}></body>"
    assert html_text.extract(page, WEIGHTS) == "The whole story of the day"


def test_pages_odd_rows(spark):
    rows = [(1, None, None, 1), (None, "u", "<p>x</p>", 2), (3, "u", "<p>x</p>", 3), (3, "u", "<p>x</p>", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = html_text.extract_pages(pages).collect()
    assert sorted(r.text for r in out) == ["", "x", "x", "x"] and {r.n_chars for r in out} == {0, 1}
    assert html_text.extract_pages(pages.limit(0)).count() == 0


# operator 9


def test_chat_matches_sql(same):
    same(chat_format.op9_chat_format, chat_format.ORACLE)


def test_windows_keep_budget_history_and_masks(spark):
    pick = random.Random(5)
    talk = [(c, t, "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2], "w" * pick.randint(0, 900 if c == 3 else 120) + "</T>[T ]~~t") for c in range(6) for t in range(25)]
    frame = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    windows = chat_format.format_windows(frame, budget=100, history=40).collect()
    by: dict = {}
    for w in sorted(windows, key=lambda w: (w.conv_id, w.window_no)):
        turns = re.findall(r"\[([TP]) ([^\]]*)\](.*?)</T>", w.formatted, re.DOTALL)
        new = [x for x in turns if x[0] == "T"]
        cost = [-(-len(x[2].replace("~l", "<").replace("~o", "[").replace("~c", "]").replace("~t", "~")) // 4) + chat_format.MARKS for x in new]
        assert sum(cost) <= 100 or len(new) == 1
        if w.window_no and w.conv_id % 2:
            assert turns[0][:2] == ("P", "system")
        assert [x[0] for x in turns] == sorted((x[0] for x in turns))
        masked = [w.formatted[s.start : s.start + s.chars] for s in w.loss]
        assert masked == [x[2] for x in new if x[1] == "assistant"]
        by.setdefault(w.conv_id, []).extend(new)
    for c, turns in by.items():
        text = [(r, x.replace("~c", "]").replace("~o", "[").replace("~l", "<").replace("~t", "~")) for _, r, x in turns]
        assert text == [(r, x) for conv, _, r, x in talk if conv == c]


def test_chat_odd_rows(spark):
    rows = [(1, 0, None, None, 0), (1, 0, None, None, 0), (None, 1, "assistant", "x", 1), (2, None, "assistant", "~t[", 2), (2, 1, "we]ird", "", 3)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, size int")
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.format_windows(frame)).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (out[1].n_turns, out[1].turns_sha256, out[1].loss_chars) == (2, digest("\n\n\n\n"), 0)
    assert (out[None].loss_chars, out[None].loss_sha256) == (1, digest("x"))
    assert (out[2].turns_sha256, out[2].loss_sha256) == (digest("assistant\n~t[\nwe]ird\n\n"), digest("~t["))
    assert chat_format.format_windows(frame.limit(0)).count() == 0


def test_whole_windows_keep_the_budget(spark):
    pick = random.Random(12)
    rows = []
    for c in range(30):
        start = [("system", "s" * pick.choice((10, 120, 300, 700)))] if c % 3 else []
        for k, (role, text) in enumerate(start + [(pick.choice(("user", "assistant")), "t" * pick.choice((1, 20, 60, 150, 500))) for _ in range(25)]):
            rows.append((c, k, role, text))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    over = total = 0
    for w in chat_format.format_windows(frame, budget=100, history=30).collect():
        parts = [p for p in w.formatted.split(chat_format.END) if p]
        cost = [-(-len(p.split("]", 1)[1]) // 4) + chat_format.MARKS for p in parts]
        kinds = [p.split("]")[0] for p in parts]
        total += 1
        if sum(cost) > 100:
            over += 1
            # A system turn and one new turn, neither of which can be cut.
            assert kinds.count("[P system") + sum(k[1] == "T" for k in kinds) == len(parts) and sum(k[1] == "T" for k in kinds) == 1
    assert total > 100 and over < total / 2


def test_headline_in_an_article_header():
    for holder in ("article", "main"):
        page = f"<body><header>The site</header><{holder}><header><h1>The headline of it</h1></header><p>{'Some words of the story. ' * 9}</p></{holder}><footer>(c)</footer></body>"
        assert html_text.extract(page, WEIGHTS) == " ".join(["The headline of it", *["Some words of the story."] * 9])


def test_short_blocks_of_unknown_classes_go():
    story = " ".join(["Es regnete fast den ganzen Tag und die Leute blieben zu Hause."] * 6)
    page = f'<body><div class="inhalt"><h1>Regen im Norden</h1><p>{story}</p></div><div class="werbung"><p><a href="/k">Jetzt kaufen</a></p></div><div class="hinweis"><p>Cookies</p><button>Ja</button></div></body>'
    got = html_text.extract(page, WEIGHTS)
    assert story in got and "kaufen" not in got and "Ja" not in got.split()[-3:]


@pytest.mark.parametrize("piece", ["<script ", "<!", "<a ", "<a \"", "<![CDATA[", "<div class='", "</", "<p><a href=x>", "<textarea>", "&amp;<"])
def test_hostile_pages_take_linear_time(piece):
    import time

    page = "<p>start of it</p>" + piece * (1_000_000 // len(piece))
    began = time.process_time()
    html_text.extract(page, WEIGHTS)
    assert time.process_time() - began < 20


def test_markup_is_read_like_a_browser_does():
    read = lambda page: list(html_text.markup_of(page))
    assert read("a<b title='x > y'>c</b><!-- d <p> -->e<script>var t='</p>';</script>f< g") == [("", "", "", "a"), ("tag", "", "b", " title='x > y'"), ("", "", "", "c"), ("tag", "/", "b", ""), ("", "", "", "e"), ("", "", "", "f< g")]
    assert read("1 <2 <p>x<a href=") == [("", "", "", "1 <2 "), ("tag", "", "p", ""), ("", "", "", "x")]
    assert read("it's <i>so</i>") == [("", "", "", "it's "), ("tag", "", "i", ""), ("", "", "", "so"), ("tag", "/", "i", "")]
