"""Cases in which an operator once did less than its whole job."""

import random
import string

import numpy as np
import xxhash

from parcelscope.llm import html_text, masked_lm, secret_scan, toxicity

# HTML

LEAD = "A lead paragraph, outside the article, of good length. " * 4
PARTS = ["First part, of the article. " * 20, "Second part, of the article. " * 18]


def test_chosen_blocks_beside_the_article_are_kept():
    page = f"""<body><nav>x</nav><div class=lead><p>{LEAD}</p></div><article><h1>T</h1><p>{PARTS[0]}</p><p>Short.</p></article>
        <div class=blurb>Buy now</div><footer>f</footer></body>"""
    assert html_text.main_text(page) == " ".join(f"{LEAD} T {PARTS[0]} Short.".split())
    page = f"<body><article><p>{PARTS[0]}</p></article><div class=more><p>{PARTS[1]}</p></div><div>Buy now</div></body>"
    assert html_text.main_text(page) == " ".join(f"{PARTS[0]} {PARTS[1]}".split())


def test_pages_without_article():
    page = f"""<body><div class=top>Site</div><div class=c><h1>T</h1><p>{PARTS[0]}</p></div><div class=d><p>{PARTS[1]}</p><p>Short.</p></div>
        <div class=blurb>Buy now</div></body>"""
    assert html_text.main_text(page) == " ".join(f"T {PARTS[0]} {PARTS[1]} Short.".split())
    page = f"<body><form id=aspnet><div id=c><h1>T</h1><p>{PARTS[0]}</p></div></form></body>"
    assert html_text.main_text(page) == " ".join(f"T {PARTS[0]}".split())


def test_attributes_are_read_by_name():
    page = """<article style="overflow:hidden" aria-hidden="false"><p>Seen, all of it.</p><p hidden>Not</p>
        <p aria-hidden="true">Nor</p><div data-hidden="no" title="class=ad">Yes, seen.</div></article>"""
    assert html_text.main_text(page) == "Seen, all of it. Yes, seen."
    page = """<article><p>Before the icon, <svg class="i" width=1 /> after the icon.</p><math/><p>The end, really.</p>
        <svg href=a/><text>drawn</text></svg></article>"""
    assert html_text.main_text(page) == "Before the icon, after the icon. The end, really."


def test_class_words_are_outvoted_by_path_ratios():
    for name in ("content sidebar-right", "elementor-widget-text-editor", "article-share-body", "sidebar"):
        page = f"""<body><div>Site</div><div class="{name}"><h1>T</h1><p>{PARTS[0]}</p><p>Short.</p>
            <div class=comments><p>I think, well, that this is fine.</p></div></div><div class=ad>Buy, now.</div></body>"""
        assert html_text.main_text(page) == " ".join(f"T {PARTS[0]} Short.".split())


# secret scans


def keys(alphabet, size, n=300):
    rng = random.Random(7)
    return ["".join(rng.choice(alphabet) for _ in range(size)) for _ in range(n)]


def test_keys_of_letters_only_are_found():
    found = [secret_scan.random_spans(key) == [(0, 3, 20)] for key in keys(string.ascii_letters, 20)]
    assert sum(found) >= 285
    for name in ("MAX_CONNECTION_TIMEOUT_SECONDS", "getElementsByTagNameNS", "Donaudampfschifffahrt", "item-1-2-3-4-5-6-7-8", "a/b/c/d/e/f/g/h/i"):
        assert secret_scan.random_spans(name) == []


def test_words_joined_to_a_key_do_not_hide_it():
    for before in ("services/configuration/production/", "authentication_key_", "https-production="):
        for after in ("", "/configuration/production"):
            at = len(before)
            found = [secret_scan.random_spans(before + key + after) for key in keys(string.ascii_letters + string.digits, 24)]
            assert sum(any(a <= at and b >= at + 24 for a, _, b in spans) for spans in found) >= 290
    key = "q7Zx9Lp2Vw8Rt5Ks3Nd6"
    text = f"see services/configuration/production/{key}== now"
    assert secret_scan.redact(text, secret_scan.all_spans(text)[1]) == "see services/configuration/production/<SECRET> now"


# language model


def test_training_reads_every_window_and_words_are_their_own_tokens(spark, docs_of):
    rows = [(at, f"common words{at} here") for at in range(40)] + [(50, None), (51, "")]
    frequent = np.array([xxhash.xxh64_intdigest(b"common"), xxhash.xxh64_intdigest(b"here")], np.uint64)
    tokens = masked_lm.Tokens(frequent)
    stored = masked_lm.training_windows(docs_of(rows), frequent)
    sizes = [len(tokens.windows([text])[0]) for _, text in rows]
    assert stored.agg({"n": "sum"}).first()[0] == sum(sizes) == int(masked_lm.token_counts(stored).sum())
    assert all(size >= 3 for size in sizes[:40])
    ending = [tokens[word] for word in (b"nation", b"qzxtion", b"xkjwvtion")]
    assert len(set(ending)) == 3 and len(ending[2]) > len(ending[0])
    pieces = [x - masked_lm.FREQUENT for x in tokens[b"xkjwvtion"]]
    assert tokens.pieces.decode(pieces) == " xkjwvtion"
    assert tokens.pieces.n_vocab == masked_lm.PIECES


# toxicity


def test_words_of_other_scripts():
    assert toxicity.words_of("Злой Καλός رديء हिन्दी Straße x2") == ["злой", "καλός", "رديء", "हिन्दी", "straße", "x"]
    assert toxicity.words_of("坏东西, 好 ๑ไทย") == ["坏东", "东西", "好", "ไท", "ทย"]


def test_toxic_documents_of_other_scripts_are_found(spark, docs_of):
    rng = random.Random(8)
    for plain, bad in (("абвгде", "злой"), ("αβγδεζ", "κακός"), ("天地人日月山", "坏东西")):
        words = ["".join(rng.choice(plain) for _ in range(4)) for _ in range(40)]
        rows = [(at, " ".join(rng.choices(words, k=40) + [bad] * (at % 4 == 0))) for at in range(200)]
        labels = spark.createDataFrame([(at, int(at % 4 == 0)) for at in range(150)], "doc_id long, toxic int")
        out = {r.doc_id: r.toxic for r in toxicity.ordinal_toxicity(docs_of(rows), labels).collect()}
        assert all(out[at] == (at % 4 == 0) for at in range(150, 200))


def test_an_id_of_many_rows_is_one_labelled_document(spark, docs_of):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "doc_id long, toxic int")
    rows = [(1, "bad bad word")] * 30 + [(1, "bad")] + [(2, "fine word")]
    counted = toxicity.labelled_words(docs_of(rows), labels, 100)
    assert counted.where("word IS NULL").count() == 2
    found = {(r.doc_id, r.word): (r.total, r.n) for r in counted.collect()}
    assert found["1", "bad"] == (61, 31) and found["1", None] == (91, 31) and found["2", None] == (2, 1)
