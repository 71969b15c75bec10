import hashlib
import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tablescope.llm import exact_search, phrases, wrapper
from tablescope.llm.common import mix


def test_top_k_is_that_of_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in v], 1) for i, v in enumerate(rng.normal(0, 0.2, (900, 24)))]
    rows += [(2000 + i, rows[i % 3][1], 1) for i in range(60)]  # ties
    rows += [(3000, None, 1), (3050, [math.nan] + [0.0] * 23, 1), (3100, [None] + [0.0] * 23, 1), (3150, [math.inf] * 24, 1)]
    rows += [(4000, [1.0, 2.0], 1), (4001, [2.0, -1.0], 1), (4050, [0.0] * 24, 1), (None, [0.1] * 24, 1), (4100, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").repartition(4)
    whole = {i: [math.floor(256 * x) for x in v] for i, v, _ in rows if i is not None and v is not None and None not in v and all(map(math.isfinite, v))}
    expected = []
    for q in sorted(i for i in whole if i % 50 == 0):
        found = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
        expected += [(q, n, i, -s) for n, (s, i) in enumerate(found[:5], 1)]
    assert sorted(tuple(r) for r in exact_search.search(df).collect()) == sorted(expected)


def test_blocks_and_large_numbers(spark, monkeypatch):
    monkeypatch.setattr(exact_search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(exact_search, "CANDIDATE_BLOCK", 40)
    rows = [(i, [float((i * 7919) % 101) * 1e4, float(i % 13) * 1e5]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    expected = []
    for q in range(0, 300, 50):
        found = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
        expected += [(q, n, i, min(-s, 2**63 - 1)) for n, (s, i) in enumerate(found[:5], 1)]
    assert sorted(tuple(r) for r in exact_search.search(df).collect()) == sorted(expected)
    assert exact_search.search(df.limit(0)).count() == 0


def phrase_set(text):
    seen, start = set(), 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in seen:
            seen.add(text[start:end])
            start = end
    return seen


def test_phrases_are_those_of_the_plain_parse():
    for text in ("", "a", "aaaaaaa", "abracadabra abracadabra", "né " * 40):
        parser = phrases.PhraseParser()
        parser.grow(text)
        assert len(parser.tree) == len(phrase_set(text))
        state, before = parser.state(), parser.fingerprint().tolist()
        parser.grow("something else entirely")
        parser.back_to(state)
        assert parser.fingerprint().tolist() == before


def text_hash(text):
    return int(np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).astype(np.int64))


def plain_phrases(text):
    """The shortest phrases not seen before, by a set of strings."""
    seen, phrase = set(), ""
    for c in text:
        phrase += c
        if phrase not in seen:
            seen.add(phrase)
            phrase = ""
    return seen


def test_fingerprints_compare_like_phrase_sets():
    rng = np.random.default_rng(3)
    base = "".join(rng.choice(list("abcd "), 6000))
    for changed in (0, 200, 2000, 6000):
        other = base[: 6000 - changed] + "".join(rng.choice(list("abcd "), changed))
        prints = []
        for text in (base, other):
            parser = phrases.PhraseParser()
            parser.grow(text)
            prints.append(parser.fingerprint())
            assert len(parser.hashes) - 1 == len(plain_phrases(text))
        a, b = plain_phrases(base), plain_phrases(other)
        # 128 of the smallest hashes estimate the share within a few standard deviations
        assert abs(phrases.likeness(*prints) - len(a & b) / len(a | b)) < 0.15
    for text in (base, "é漢 x" * 50, "", "a"):
        parser = phrases.PhraseParser()
        parser.grow(text)
        expected = set()
        for phrase in plain_phrases(text):
            h = 1
            for c in phrase:
                h = (h * phrases._FACTOR + ord(c)) % (1 << 64)
            expected.add(int(mix(np.array([h], np.uint64))[0]) >> 32)
        assert parser.fingerprint().tolist() == sorted(expected)[: phrases.KEPT]


@pytest.mark.parametrize("ids", ["text", "null", "equal"])
def test_runs_of_any_ids(spark, ids):
    """Text ids sort by their bytes; ids that are null or equal are cut by the hashes of their texts."""
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("abc "), int(rng.integers(0, 30)))) for _ in range(400)]
    rows = [({"text": f"é{k}" if k % 3 else f"z{k}", "null": None, "equal": "7"}[ids], t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    order = sorted(rows, key=lambda r: ((r[0] or "").encode(), text_hash(r[1])), reverse=True)
    expected = []
    for k, (i, text) in enumerate(order):
        half = len(text) // 2
        edited = text[: len(text) - half] + order[(k + 1) % len(order)][1][:half]
        expected.append((str(i), len(text), hashlib.sha256(edited.encode()).hexdigest()))
    got = phrases.fingerprints(df).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(expected)
    sizes = [r["n"] for r in phrases._runs(df).groupBy("run").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 8 and max(sizes) < 100


@pytest.mark.parametrize("n", [0, 1, 2, 57])
def test_edited_texts_and_neighbours(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(3 * i), "".join(rng.choice(list("abcdé漢 "), int(rng.integers(0, 200)))), 1) for i in range(n)]
    rows += [(6, "again", 1), (None, "no id", 1), (2, None, 1), (4, "", 1)] if n > 2 else []
    df = spark.createDataFrame(rows, "doc_id long, text string, run int").repartition(4)
    got = phrases.fingerprints(df).collect()
    order = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), -text_hash(r[1])))
    expected, prints = [], {}
    for k, (i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        expected.append((str(i), len(text), hashlib.sha256(edited.encode()).hexdigest()))
        parser = phrases.PhraseParser()
        parser.grow(text)
        prints[str(i), len(text), expected[-1][2]] = (phrases.as_text(parser.fingerprint()), edited, following)
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(expected)
    for r in got:
        own, edited, following = prints[str(r["doc_id"]), r["n_chars"], r["edited_sha256"]]
        others = []
        for text in (edited, following):
            parser = phrases.PhraseParser()
            parser.grow(text)
            others.append(parser.fingerprint())
        mine = phrases.from_text(own)
        assert r["fingerprint"] == own and r["edited_fingerprint"] == phrases.as_text(others[0])
        assert r["near_edited"] == phrases.likeness(mine, others[0]) and r["near_next"] == phrases.likeness(mine, others[1])


PAGE = (
    '<html><head><title>t</title><script>var a="</p>";</script></head><body class="page-header"><header>Site</header>'
    "<div class='menu'><ul><li><a href=x>One</a><li><a>Two</a></ul></div><main><h1>T &amp; x</h1><p>One<br>two <b>bold</b>\n word"
    "<p>Three &#39;q&#39;<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><div class='comments'><p>no</p></div></main>"
    "<form>f</form><footer>foot</footer></body>"
)


def test_blocks_of_a_page():
    assert wrapper.main_text(PAGE, None, set(), set()) == "T & x\nOne two bold word\nThree 'q'\na\nb\nc\nd"
    for broken in ("", "<", "<p", "</p></div>", "<!-- x", "<script>", "a<b", "<p>x</p" * 3, "&bogus; &#xZZ; &#0;"):
        assert isinstance(wrapper.main_text(broken, None, set(), set()), str)


def test_alignment():
    assert wrapper.align("a(b()c())", "a(b()d()c())") == {0: 0, 1: 1, 2: 3}
    assert wrapper.align("a()", "b()") == {}


def test_wrappers(spark):
    rows = [
        (i, f"http://a.example/{i}", f"<div class=z>Fixed line</div><div class=q>Lead {i}</div><section><p>common</p><p>own {i}</p><p>more {i * 7}</p></section>"
         + ("<em>x{}</em>".format(i) if i % 2 else "<div class=new>extra {}</div>".format(i)), "k")
        for i in range(8)
    ]
    rows += [(20, None, None, "k"), (21, "http://b.example", "<p>x", "k"), (22, "junk", "", "k"), (21, "http://b.example", "<p>x", "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(3)
    got = {r["page_id"]: r for r in wrapper.extract(df).collect()}
    assert got[2]["text"] == "Lead 2\ncommon\nown 2\nmore 14\nextra 2"
    assert got[3]["text"] == "Lead 3\ncommon\nown 3\nmore 21\nx3"
    assert [got[i]["text"] for i in (20, 21, 22)] == ["", "x", ""]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert wrapper.extract(df).count() == len(rows) and wrapper.extract(df.limit(0)).count() == 0


BODY = "Article %d of these pages has a text that is long enough to be %d the main thing here."
ODD_NAMES = {
    "no-sidebar": ("<div class='content-area no-sidebar'><p>" + BODY + "</p></div><div class=sidebar>junk %d</div>", "{}"),
    "ad-free": ("<div class='post ad-free'><p>" + BODY + "</p></div><div class=ad>junk %d</div>", "{}"),
    "form": ("<form id=aspnetForm><p>" + BODY + "</p><div class=footer>junk %d</div></form>", "{}"),
    "section": ("<article><p>" + BODY + "</p><section id=copyright><p>On law %d.</p></section></article>", "{}\nOn law {n}."),
    "heading": ("<article><h2 id=social-security-notice>Part</h2><p>" + BODY + "</p></article><footer>junk %d</footer>", "{}"),
    "hidden": ("<article><p>" + BODY + "</p><p hidden>junk %d</p><p style='display: none'>more</p></article>", "{}"),
    "teaser": ("<div><p>" + BODY + "</p></div><article>Teaser %d</article>", "{}\nTeaser {n}"),
    "remarks": ("<div class=text><p>" + BODY + "</p></div><div class=comments><p>" + 9 * "I say so. " + "%d</p></div>", "{}"),
    "short": ("<article><p>Short %d %d.</p></article><div class=ad>" + 4 * "Buy this now. " + "%d</div>", "Short {n} {n}."),
}


@pytest.mark.parametrize("name", ODD_NAMES)
def test_names_do_not_lose_articles(spark, name):
    page, expected = ODD_NAMES[name]
    rows = [(i, f"http://x.example/{i}", page % (i, i, i)) for i in range(10)]
    if name == "short":  # most pages of the host have long articles
        rows = [(i, f"http://x.example/{i}", page.replace("Short %d %d.", BODY) % (i, i, i) if i else page % (0, 0, 0)) for i in range(10)]
    got = wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    for i, r in enumerate(got[:1] if name == "short" else got):
        assert r["text"] == expected.format(BODY % (i, i), n=i)
    if name == "heading":
        # the heading is the same on all pages, which makes it template; its name does not matter
        assert [r["text"] for r in got] == [BODY % (i, i) for i in range(10)]
        assert wrapper.main_text(rows[0][2], None, set(), set()) == "Part\n" + BODY % (0, 0)


def test_the_wrapper_alone_decides(spark):
    """No element has a name: what is alike on the host's pages and what is links goes, what varies stays."""
    page = (
        "<div>My Site</div><ul><li><a href=/a{0}>One{0}</a><li><a href=/b>Two</a></ul><h1>Title {0}</h1><p>By our staff {0}"
        "<p>Words of page {0}.</p><table><tr><td>All rights reserved</table>"
    )
    rows = [(i, f"http://x.example/{i}", page.format(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for r in wrapper.extract(df).collect():
        assert r["text"] == "Title {0}\nBy our staff {0}\nWords of page {0}.".format(r["page_id"])
    assert "All rights reserved" in wrapper.main_text(page.format(1), None, set(), set())


def test_long_pages_are_aligned_in_proportion():
    import time

    page = "<div>" + "".join(f"<h2 class=c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}>h</h2><p>t {i}</p><ul><li>x</ul>" for i in range(2000)) + "</div>"
    start = time.perf_counter()
    a, b = wrapper.Page(page), wrapper.Page(page.replace("cab", "cxy"))
    found = wrapper.align(a.text, b.text)
    assert time.perf_counter() - start < 1.0 and len(found) > 1900


def plain_match(a, b):
    """Simple tree matching by its table."""
    if a[0] != b[0]:
        return 0
    x, y = list(a[1].values()) if isinstance(a[1], dict) else a[1], list(b[1].values()) if isinstance(b[1], dict) else b[1]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, c in enumerate(x):
        for j, d in enumerate(y):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain_match(c, d))
    return best[-1][-1] + 1


def test_alignment_is_the_largest_match():
    rng = np.random.default_rng(5)

    def tree(depth):
        labels = rng.permutation(6)[: rng.integers(0, 6)] if depth else []
        return f"n({''.join(tree_of(int(k), depth - 1) for k in labels)})"

    def tree_of(label, depth):
        inner = tree(depth)
        return f"l{label}" + inner[1:]

    for _ in range(200):
        a, b = tree(3), tree(3)
        pairs = wrapper.align(a, b)
        if a != b:
            assert len(pairs) == plain_match(wrapper._tree(a), wrapper._tree(b))
        assert len(set(pairs.values())) == len(pairs)


def test_deep_pages(spark):
    deep = ["<font>" * 10_000 + "inline", "<div>" * 10_000 + "block", "<div>x" * 3_000, "<b><section>" * 5_000 + "end"]
    pages = [(i, "http://d.example", f"<p>own {i}</p>" + deep[i % 4], "k") for i in range(8)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(pages, "page_id long, url string, html string, host string").repartition(2)).collect()}
    assert got == {i: f"own {i}" + ("\n" + ("inline", "block", "\n".join(["x"] * 3_000), "end")[i % 4]) for i in range(8)}
    a, b = ("x(" * n + ")" * n for n in (10_000, 9_999))
    assert wrapper.align(a, b) == {k: k for k in range(9_999)}
