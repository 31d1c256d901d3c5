"""Each operator against brute force on small inputs, and its defined results for odd rows."""

import hashlib
import time
import uuid
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import decontaminate, exact_substrings, html_text, language_id, lm_score, near_dup, packing, sharding, topk, url_filter
from rasterloom.llm.common import shared_folder, shingles, words
from rasterloom.llm.queries import tokenizer_path

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, key string, rkey long, starts long, n_chars int"


def docs(spark, rows):
    """Rows of (doc_id, text[, lang]) with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, "x", 1, 2, len(r[1] or "")) for r in rows], DOCS)


def prose(seed, n, vocabulary=3000):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, vocabulary, n))


ODD = [(1, None), (2, ""), (3, " \n"), (4, "one"), (4, "one"), (None, "two words"), (5, "!!! ???"), (6, "é" * 3), (7, "x" * 100_000)]


# -- words and shingles


def test_words_and_shingles():
    h, b = words(["Ab, ab! AB", "", "é É x"])
    assert list(b) == [0, 3, 3, 6] and len(set(h[:3].tolist())) == 1 and h[3] == h[4]
    v, t = shingles(*words(["a b c d e f", "a b", ""]), 5)
    assert list(np.diff(t)) == [2, 1, 0]


# -- 1 language ID


def test_automaton_knows_all_substrings():
    text = "abcabxabcd"
    step, _ = language_id.automaton(text)

    def accepts(s):
        at = 0
        for c in s:
            if c not in step[at]:
                return False
            at = step[at][c]
        return True

    subs = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    assert all(accepts(s) for s in subs) and not accepts("ac") and not accepts("xx")


def phrases(train, text):
    n = 0
    for at in range(0, len(text), language_id.LANE):
        lane, i = text[at : at + language_id.LANE], 0
        while i < len(lane):
            j = i + 1
            while j <= len(lane) and lane[i:j] in train:
                j += 1
            n += 1
            i = max(j - 1, i + 1)
    return n


def test_phrases_equal_greedy_parsing():
    train = {"a": "the cat sat on the mat and the rat", "b": "der hund und die katze sind im haus"}
    model = language_id.Model(train)
    texts = ["The cat and the dog.", "die katze, der hund!", "zzz qqq", "the " * 400]
    n, letters, _ = model.phrases(texts)
    for i, t in enumerate(texts):
        s = language_id.normalised(t)
        for k, lang in enumerate(model.langs):
            assert n[i, k] == phrases(train[lang], s), (t, lang)
    assert letters[2] == 6
    assert model.predict(["the cat sat", "und die katze", "", "123"])[0] == ["a", "b", "und", "und"]


def test_large_alphabets_take_sorted_edges_with_the_same_phrases():
    rng = np.random.default_rng(1)
    train = {"zh": "".join(chr(0x4E00 + x) for x in rng.integers(0, 6000, 8000)), "a": "the cat sat on the mat and the rat"}
    flat, edges = language_id.Model(train, cells=1 << 40), language_id.Model(train)
    assert edges.tables[1].flat is None and edges.tables[0].flat is not None
    texts = [train["zh"][100:900] + " cat " + train["zh"][:5], "the 猫 sat", "", train["zh"][7000:] * 3]
    for x, y in zip(flat.phrases(texts), edges.phrases(texts), strict=True):
        assert (x == y).all()
    for i, t in enumerate(texts):
        for k, lang in enumerate(edges.langs):
            assert edges.phrases(texts)[0][i, k] == phrases(train[lang], language_id.normalised(t))


def test_ties_and_long_texts():
    model = language_id.Model({"b": "abc abd", "a": "abc abd"})
    lang, score, _ = model.predict(["abc", "zzz", "abd " * 200_000])
    assert lang == ["a", "a", "a"] and score.tolist() == [0.0, 0.0, 0.0]


def test_language_id_held_out_accuracy_and_odd_rows(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet")
    model = language_id.learn(rows)
    found = language_id.identify(rows, model).join(rows.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.where("lang_pred = lang").count() >= 0.95 * found.count() > 0
    odd = {(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(docs(spark, ODD), model).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (5, "und", 0.0)} <= odd
    assert language_id.identify(docs(spark, ODD), model).count() == len(ODD)
    assert language_id.identify(docs(spark, ODD).limit(0), model).count() == 0
    assert language_id.learn(docs(spark, ODD)) == {}
    assert {r.lang_pred for r in language_id.identify(docs(spark, ODD), {}).collect()} == {"und"}
    assert sorted(r.doc_id or 0 for r in language_id.keep_known(docs(spark, ODD), {}).collect()) == [0, 4, 4, 6, 7]
    kept = language_id.keep_known(docs(spark, [*ODD, (8, "Съешь же ещё этих мягких французских булок")]), model)
    assert kept.columns == docs(spark, ODD).columns and {r.doc_id for r in kept.collect()} <= {4, None, 6, 7}


# -- 2 HTML


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>t</title>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<nav><ul><li>Menu</ul></nav><article><h1>A &amp; B</h1><p>One\n two<br>three<p><b>Four</b> five</article><footer>f</footer>", "A & B\n\nOne two three\n\nFour five"),
        ('<div class="ad">Buy</div><p>x &lt;y&gt; &eacute;&#33;</p><aside>s</aside><form><p>q</form>', "x <y> é!"),
        ('<article><p>a</p><div class="share-buttons">s</div><section id="comments"><p>c</p></section></article>', "a"),
        ("<article><p>a</p><script>var x='</p><p>no';</script><style>p{}</style><!-- <p>no --></article>", "a"),
        ("<main><header><h1>T</h1></header><p>b</main><header>site</header>", "T\n\nb"),
        ("<p>cut off <b>here", "cut off here"),
        ("", ""),
    ],
)
def test_main_text(body, text):
    assert html_text.main_text(page(body), {}, "h") == text


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><p title='a hidden gem'>a</p><p data-x='1 class=ad'>b</p><p hidden>c</p></article>", "a\n\nb"),
        ("<form id=aspnetForm><nav>n</nav><main><p>a</p><form><p>q</p></form></main></form>", "a"),
        ("<form><article><p>a</p></article></form>", "a"),
        ("<div class='layout has-sidebar'><main class='with-sidebar'><p>a</p></main><div class=sidebar>s</div></div>", "a"),
        ("<p>t</p><section class=comments><article><p>c</p></article></section>", "t"),
    ],
)
def test_names_do_not_drop_what_holds_the_main_element(body, text):
    assert html_text.main_text(page(body), {}, "h") == text


def test_repeated_branches_of_a_site_are_removed(spark):
    pages = [(i, f"http://s.example/{i}", page(f"<div class=c1><p>All rights of the house</p></div><div class=c2><p>{prose(i, 60)}</p></div>")) for i in range(30)]
    pages += [(100, "http://other.example/", page("<div class=c1><p>All rights of the house</p></div>")), (101, None, None), (102, "x", ""), (5, pages[5][1], pages[5][2])]
    df = spark.createDataFrame([(*p, "e") for p in pages], "page_id long, url string, html string, host string")
    found = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert all(found[i] == prose(i, 60) for i in range(30))
    assert found[100] == "All rights of the house" and found[101] == found[102] == ""
    assert html_text.extract(df).count() == 34 and html_text.extract(df.limit(0)).count() == 0


def test_copies_of_an_article_are_no_furniture(spark):
    pages = [(i, f"http://s.example/{i}", page(f"<div class=c2><p>{prose(1, 60)}</p></div>")) for i in range(20)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.text for r in html_text.extract(df).collect()} == {prose(1, 60)}


def test_notices_in_an_article_go_and_shared_passages_stay(spark):
    notice, quote = "This site will be moved next week, see below", prose(77, 20)
    body = lambda i: f"<article><h1>{prose(400 + i, 4)}</h1><p>{prose(i, 60)}</p><p>{quote if i < 4 else prose(900 + i, 20)}</p><p>{notice}</p></article>"
    df = spark.createDataFrame([(i, f"http://s.example/{i}", page(body(i))) for i in range(30)], "page_id long, url string, html string")
    for r in html_text.extract(df).collect():
        i = r.page_id
        assert r.text == "\n\n".join([prose(400 + i, 4), prose(i, 60), quote if i < 4 else prose(900 + i, 20)])


def test_a_long_legal_text_of_a_site_of_stubs_is_removed(spark):
    legal = prose(5, 300)
    df = spark.createDataFrame([(i, f"http://s.example/{i}", page(f"<div><p>{prose(i + 10, 8)}</p></div><div><p>{legal}</p></div>")) for i in range(20)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(df).collect()} == {i: prose(i + 10, 8) for i in range(20)}


def test_a_menu_with_one_item_of_its_own_goes_as_a_branch(spark):
    items = "".join(f"<li>section {k}</li>" for k in range(8))
    body = lambda i: f"<div class=c1><ul>{items}<li>you are at {i}</li></ul></div><div class=c2><p>{prose(i, 60)}</p></div>"
    df = spark.createDataFrame([(i, f"http://s.example/{i}", page(body(i))) for i in range(25)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(df).collect()} == {i: prose(i, 60) for i in range(25)}


def test_tree_values_equal_brute_force(spark):
    """Importance of blocks and layout entropies against sums over the pages' own trees."""
    rng = np.random.default_rng(2)
    block = lambda: f"<p>{prose(int(rng.integers(0, 6)), 5)}</p>"
    bodies = ["".join(f"<div class=c{k}>{''.join(block() for _ in range(rng.integers(1, 4)))}{'<hr><span><b>x</b></span>' if rng.integers(0, 2) else ''}</div>" for k in range(3)) for _ in range(40)]
    rows = [(i, "http://s.example/", page(b)) for i, b in enumerate([*bodies, *bodies[:5]])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    keyed = df.withColumns({"host": F.lit("s.example"), "p1": F.col("page_id"), "p2": F.col("page_id")}).select("p1", "p2", "host", "html")
    p = html_text.Params()
    found = {r.key: (r.value, r.weight) for r in html_text.low_values(keyed.mapInArrow(html_text._nodes, html_text.NODES_DDL), p).collect()}
    styles, features = {}, {}
    for _, _, html in rows:
        x = html_text.read(html, "s.example")
        for e in x.elements[1:]:
            if e.texts:
                styles.setdefault(html_text.node_key("s.example", e.path), set()).add((e.style, x.sign))
        for (at, _), k in zip(x.blocks, x.keys, strict=True):
            features.setdefault((html_text.node_key("s.example", x.elements[at].path), k), set()).add(x.sign)
    expected = {}
    for node, seen in styles.items():
        n = np.array(list(Counter(s for s, _ in seen).values()))
        if len(n) > 1:
            expected[node] = (float(-(n / n.sum() * np.log(n / n.sum())).sum() / np.log(n.sum())), 1 - 0.9 ** len(n))
    for (node, k), signs in features.items():
        if len(signs) > 1:
            expected[k] = (max(0.0, 1 - np.log(len(signs)) / np.log(len(styles[node]) + 2)), 0.0)
    assert found.keys() == expected.keys()
    assert all(found[k] == pytest.approx(v, abs=1e-9) for k, v in expected.items())


def test_deep_and_hostile_pages_take_time_in_proportion():
    def seconds(n):
        begin = time.perf_counter()
        for html in ("<div>x" * n, "<b>" * n + "<li>x" * n, "<article>" * n + "x", "<form>" * n + "<article>x" * n, "<p></q>x" * n, "<x-a>" * n + "<p>x" * n):
            html_text.main_text(page(html), {}, "h")
        return time.perf_counter() - begin

    seconds(500)
    assert seconds(16_000) < 24 * seconds(2000) + 0.5


# -- 3 exact substrings


def brute_substrings(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(x), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return out


def brute_passages(texts, length, least):
    """Runs that windows of ``length`` bytes with an equal elsewhere cover, and that have ``least`` words."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x) + 2, np.int8)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = 1
        out.append(sum(len(x[a:b].split()) >= least for a, b in np.flatnonzero(np.diff(gone)).reshape(-1, 2)))
    return out


@pytest.mark.parametrize("passage", [0, 200, 395])
@pytest.mark.parametrize("hot", [4096, 3, 1])
def test_substrings_equal_brute_force(spark, hot, passage):
    rng = np.random.default_rng(3)
    base = "".join(rng.choice(list("abcdé "), 2500))
    rows = []
    for i in range(120):
        text = "".join(rng.choice(list("abcdefgh "), rng.choice([0, 50, 390, 600])))
        for _ in range(rng.integers(0, 4)):
            a = rng.integers(0, 2000)
            text += base[a : a + rng.choice([300, 395, 400, 401, 410, 450])] + "".join(rng.choice(list("xyz"), rng.choice([0, 1, 3, 120])))
        rows.append((i, text))
    rows += [(900, "a" * 2000), (901, "ab" * 700), (902, None), (903, ""), (904, rows[5][1]), (905, rows[5][1]), (905, rows[5][1]), (906, "a" * 400), (None, base)]
    df = docs(spark, rows).repartition(5)
    p = exact_substrings.Params(hot=hot, piece=250_000 if hot > 3 else 700, passage=passage, passage_words=20)
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passages) for r in exact_substrings.duplicates(df, p).collect())
    texts = [r[1] for r in rows]
    passages = brute_passages(texts, passage, 20) if passage else [0] * len(rows)
    expected = sorted((r[0] if r[0] is not None else -1, *x, y) for r, x, y in zip(rows, brute_substrings(texts, 400), passages, strict=True))
    assert found == expected


def test_multikey_order_is_the_order_of_bytes():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 2, (500, 40)).astype(np.uint8) * 255
    rows[rng.integers(0, 500, 100)] = rows[0]
    order = exact_substrings.multikey_order(exact_substrings._tokens(rows))
    ordered = [rows[i].tobytes() for i in order]
    assert ordered == sorted(ordered)
    shared = exact_substrings.common_prefixes(rows, order)
    for k in range(1, 500):
        a, b = ordered[k - 1 : k + 1]
        assert shared[k] == next((i for i in range(40) if a[i] != b[i]), 40)


@pytest.mark.parametrize("hot", [4096, 2])
def test_structured_strings_equal_brute_force(spark, hot):
    """Strings on which polynomial hashes modulo a power of two agree, alternating blocks, and zero bytes."""
    thue = "a"
    for _ in range(12):
        thue += thue.translate(str.maketrans("ab", "ba"))
    other = thue.translate(str.maketrans("ab", "ba"))
    texts = [thue[:1500], other[:1500], thue[2048:3300] + "\0" * 500, "\0" * 430 + other[100:900], "xy" * 300 + thue[5:700], "y" + "xy" * 250 + other[5:700], "abba" * 200, "baab" * 130]
    found = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in exact_substrings.duplicates(docs(spark, list(enumerate(texts))).repartition(3), exact_substrings.Params(hot=hot)).collect())
    assert found == [(i, *x) for i, x in enumerate(brute_substrings(texts, 400))]


def test_many_copies_of_a_text_are_marked_without_a_shuffle(spark):
    text = prose(4, 200)
    df = docs(spark, [(i, text) for i in range(40)] + [(50, text[:450] + "x"), (51, prose(5, 100))])
    found = {r.doc_id: r.n_removed for r in exact_substrings.duplicates(df).collect()}
    assert all(found[i] == len(text) for i in range(40)) and found[50] == 450 and found[51] == 0


def test_shorter_passages_by_bytes_and_words(spark):
    long, short = prose(21, 52), prose(22, 45)
    df = docs(spark, [(i, f"{prose(100 + i, 80)} {long} {prose(200 + i, 30)} {short} {prose(300 + i, 40)}") for i in range(3)])
    p = exact_substrings.Params(length=200, span=64, words=51)
    for r in exact_substrings.remove(df, p).collect():
        assert long not in r.text and short in r.text and prose(300 + r.doc_id, 40) in r.text and r.n_chars == len(r.text)


def test_substring_removal_keeps_rows_and_columns(spark):
    shared = prose(9, 120)
    df = docs(spark, [(1, "é" + shared + " tail"), (2, shared), (3, None), (4, "short")])
    out = {r.doc_id: r for r in exact_substrings.remove(df).collect()}
    assert (out[1].text, out[2].text, out[3].text, out[4].text) == ("é tail", "", None, "short")
    assert out[1].n_chars == 6 and (out[1].rkey, out[1].starts) == (1, 2)
    assert exact_substrings.duplicates(df.limit(0)).count() == 0


# -- 4 URL filter


def test_url_parts_and_rules(spark):
    urls = {
        1: ("HTTP://WWW.Example.COM/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        2: ("http://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        3: ("http://b.com/z", "b.com", "/z", "com/", "allow"),
        4: ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
        5: ("http://b.com", "b.com", "", None, None),
        6: ("http://notcom/", "notcom", "/", None, None),
        7: (None, "", "", None, "block"),
        8: ("no mark", "", "", None, "block"),
        9: ("http://?q", "", "", None, None),
        10: ("http://", "", "", None, "block"),
        11: ("http://b.com/a://c/d", "b.com", "/a://c/d", "com/", "allow"),
    }
    df = spark.createDataFrame([(i, u[0], "e", "f") for i, u in urls.items()], "page_id long, url string, norm string, rule string")
    for r in url_filter.judge(df).collect():
        _, host, path, rule, verdict = urls[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_model_equals_brute_force(spark):
    order = 2
    rows = [("good/aa", 3, 0), ("good/ab", 2, 0), ("bad/xx", 0, 4), ("bad/xa", 0, 1), ("goxx", 0, 0)]
    df = spark.createDataFrame(rows, "norm string, allow long, block long")
    found = {r.gram: r.weight for r in url_filter.ratios(df, order).collect()}
    counts = [Counter(), Counter()]
    grams = set()
    for norm, a, b in rows:
        padded = "\x02" * order + norm
        for i in range(len(norm)):
            g = padded[i : i + order + 1]
            grams.add(g)
            for k in range(order + 1):
                counts[0][g[order - k :]] += a
                counts[1][g[order - k :]] += b
    letters = {g[-1] for g in grams}

    def p(c, g):
        value = 1 / (len(letters) + 1)
        for k in range(order + 1):
            gram = g[order - k :]
            after = [counts[c][x] for x in counts[c] if len(x) == k + 1 and x[:-1] == gram[:-1]]
            n, kinds = sum(after), sum(x > 0 for x in after)
            if n:
                value = (counts[c][gram] + kinds * value) / (n + kinds)
        return value

    assert set(found) == grams
    for g in grams:
        assert found[g] == pytest.approx(np.log(p(0, g)) - np.log(p(1, g)))


# -- 5 language-model scores


def test_lm_learns_and_scores(spark):
    rng = np.random.default_rng(0)
    make = lambda i: " ".join(f"{'a' if i % 2 else 'b'}{x}" for x in rng.integers(0, 20, 200))
    df = docs(spark, [(i, make(i)) for i in range(200)]).repartition(3)
    plain, trained = (lm_score.score(df, lm_score.train(df, p), p).agg(F.avg("mean_log_prob")).first()[0] for p in (lm_score.Params(rounds=0), lm_score.Params(group_tokens=5000, batch=512)))
    assert plain == pytest.approx(-np.log(40), abs=0.05)  # unigrams
    assert trained > plain + 0.4  # both sides tell which half of the words it is: log 2 at best
    odd = {r.doc_id: r for r in lm_score.score(docs(spark, ODD), lm_score.train(docs(spark, ODD))).collect()}
    assert odd[1].n_tokens == odd[5].n_tokens == 0 and odd[1].log_prob == 0 and odd[1].perplexity is None
    empty = docs(spark, ODD).limit(0)
    assert lm_score.score(empty, lm_score.train(empty)).count() == 0


def test_lm_probabilities_sum_to_one():
    p = lm_score.Params()
    net = lm_score.Network.fresh(p, np.arange(p.size - p.hashed, dtype=np.uint64), np.ones(p.size))
    total = 0.0
    for c in range(p.size):
        total += np.exp(net.log_prob(np.array([3, c, 5]), np.array([0, 3]))[1])
    assert total == pytest.approx(1, abs=1e-4)


@pytest.mark.parametrize("often_words", [0, 500, 100_000])
def test_lm_words_outside_the_vocabulary_have_their_own_probability(spark, often_words):
    often, rare = [f"often{i}" for i in range(1100)], [f"rare{i}" for i in range(1000)]
    corpus = docs(spark, [(i, " ".join(often)) for i in range(40)] + [(100, " ".join(rare))])
    p = lm_score.Params(rounds=0, often=often_words)
    model = lm_score.train(corpus, p)
    asked = [*often, *rare, *(f"unseen{i}" for i in range(50))]
    rows = [*enumerate(asked), (9000, " ".join(asked[1090:])), (9000, " ".join(asked[1090:]))]
    found = lm_score.score(docs(spark, rows), model, p).collect()
    one = {asked[r.doc_id]: np.exp(r.log_prob) for r in found if r.doc_id < 9000}
    assert 0.9 < sum(one[w] for w in often + rare) <= 1
    low = max(one[w] for w in rare)
    assert min(one[w] for w in often) > 5 * low
    assert max(one[w] for w in asked[-50:]) < low
    long = [r for r in found if r.doc_id == 9000]
    assert len(long) == 2 and all(r.log_prob == pytest.approx(sum(np.log(one[w]) for w in asked[1090:])) for r in long)


def test_lm_trains_on_every_token_once(spark, tmp_path, monkeypatch):
    """Each round leaves its tokens in a file; over all rounds they are all tokens, once each."""
    p = lm_score.Params(group_tokens=200)
    texts = [f"head line {prose(i, 40 + i)}" for i in range(30)] + ["", "one", "one"]
    df = docs(spark, list(enumerate(texts))).repartition(4)
    plain, folder = lm_score._descend, str(tmp_path)

    def noted(batches, shared, p):
        batches = list(batches)
        got = sum(len(words(b.column("text").to_pylist())[0]) for b in batches)
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(got))
        yield from plain(batches, shared, p)

    monkeypatch.setattr(lm_score, "_descend", noted)
    lm_score.train(df, p)
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) == len(words(texts)[0])
    assert len(list(tmp_path.iterdir())) > 4


def test_lm_scores_do_not_depend_on_the_layout(spark):
    p = lm_score.Params(group_tokens=300)
    df = docs(spark, [(i, prose(i, 60 + i, 50)) for i in range(60)])
    found = [sorted((r.doc_id, round(r.log_prob, 3)) for r in lm_score.score(x, lm_score.train(x, p), p).collect()) for x in (df.repartition(1), df.repartition(5, "text"), df.coalesce(2))]
    assert found[0] == found[1] == found[2]


def test_lm_score_equals_brute_force(spark):
    """A document's score is the sum over its words of a plain forward pass and a plain softmax over all ids."""
    p = lm_score.Params()
    texts = ["the cat sat on the mat", "a cat", "", "mat " * 30, prose(3, 50, 20)]
    df = docs(spark, list(enumerate(texts)))
    model = lm_score.train(df, p)
    net, counts = lm_score.Network(p, model.vocabulary, model.flat), {r.word: r.n for r in model.counts.collect()}
    for r in lm_score.score(df, model, p).collect():
        word, _ = words([texts[r.doc_id]])
        ids = [int(x) for x in net.ids(word)]
        total = 0.0
        for i, t in enumerate(ids):
            near = [ids[i + d] if 0 <= i + d < len(ids) else p.size for d in (-2, -1, 1, 2)]
            h = np.tanh(net.shift + sum(net.embed[k] @ m for k, m in zip(near, net.mixer, strict=True)))
            by_class = h @ net.by_class + net.class_bias
            logits = np.concatenate([by_class[c] - np.log(np.exp(by_class).sum()) + (s := h @ net.by_member[c] + net.member_bias[c]) - np.log(np.exp(s).sum()) for c in range(p.classes)])
            total += logits[t]
            if t >= p.size - p.hashed:
                total += model.unseen[t - p.size + p.hashed] + np.log(counts.get(int(word[i].view(np.int64)), 0) + 1)
        assert r.log_prob == pytest.approx(total, rel=1e-4, abs=1e-4) and r.n_tokens == len(ids)


def test_lm_gradient_points_downhill():
    p = lm_score.Params(step=0.01)
    rng = np.random.default_rng(1)
    net = lm_score.Network.fresh(p, np.zeros(0, np.uint64), np.ones(p.size))
    ids = rng.integers(0, 50, 400)
    bounds = np.array([0, 400])
    before = net.log_prob(ids, bounds).mean()
    for _ in range(5):
        net.learn(net.around(ids, bounds), ids)
    assert net.log_prob(ids, bounds).mean() > before


# -- 6 sharding


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 17, 1000, 4097])
def test_permutation(n):
    out = sharding.permute(np.arange(n), n)
    assert sorted(out.tolist()) == list(range(n))
    assert n < 1000 or (out != np.arange(n)).mean() > 0.9


def test_permutation_equals_a_network_row_by_row():
    """Integers of any size, one number at a time."""
    full = (1 << 64) - 1

    def scramble(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
        return x ^ (x >> 31)

    for total, seed in ((5, 17), (1000, 17), (70_000, 3)):
        half = 0
        while 4**half < total:
            half += 1
        half = max(1, half)
        found = sharding.permute(np.arange(total), total, seed)
        for i in range(0, total, max(1, total // 200)):
            x = i
            while True:
                left, right = x >> half, x & (2**half - 1)
                for r in range(1, 7):
                    left, right = right, left ^ (scramble(right + scramble(r + (seed << 32))) & (2**half - 1))
                x = left << half | right
                if x < total:
                    break
            assert found[i] == x


def test_shards_follow_global_row_numbers(spark):
    rows = [(int(i), prose(int(i), 3)) for i in np.random.default_rng(1).permutation(500)]
    found = sharding.shard_rows(docs(spark, rows).repartition(7)).collect()
    number = {r.doc_id: i for i, r in enumerate(sorted(found, key=lambda r: (r.doc_id, r.text_crc32, r.size)))}
    place = sharding.permute(np.arange(500), 500)
    assert all((r.row_number, r.shard, r.slot) == (number[r.doc_id], place[number[r.doc_id]] % 16, place[number[r.doc_id]] // 16) for r in found)


@pytest.fixture
def spread(spark):
    """Shuffles have 40 partitions each, and stay so; gives a function that counts the files in checkpoints since it was last asked."""
    put = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in put}
    for k, v in put.items():
        spark.conf.set(k, v)
    folder, seen = shared_folder(spark).removeprefix("file:"), set()

    def files() -> int:
        new = set(Path(folder).glob("rdd-*/part-*")) - seen
        seen.update(new)
        return len(new)

    files()
    yield files
    for k, v in was.items():
        spark.conf.set(k, v)


def test_row_numbers_of_few_rows_are_kept_in_few_files(spark, spread):
    rows = [(i, prose(i, 3)) for i in range(300)]
    found = sharding.shard_rows(docs(spark, rows)).collect()
    assert spread() == 1
    assert [r.row_number for r in sorted(found, key=lambda r: r.doc_id)] == list(range(300))
    shards = Counter(r.shard for r in found)
    assert max(shards.values()) - min(shards.values()) <= 1


def test_shards(spark):
    rows = [*ODD, *[(i, prose(i, 5)) for i in range(100, 170)]]
    found = sharding.shard_rows(docs(spark, rows)).collect()
    again = sharding.shard_rows(docs(spark, rows).repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text_crc32, r.shard, r.slot)
    assert sorted(found, key=key) == sorted(again, key=key)
    shards = Counter(r.shard for r in found)
    assert len(found) == len(rows) and max(shards.values()) - min(shards.values()) <= 1
    assert all(sorted(r.slot for r in found if r.shard == s) == list(range(n)) for s, n in shards.items())
    by = {r.doc_id: r for r in found}
    assert (by[1].size, by[1].text_crc32) == (1, 0) and by[6].size == 7 and by[6].text_crc32 == zlib.crc32(("é" * 3).encode())
    assert sharding.shard_rows(docs(spark, []).limit(0)).count() == 0


# -- 7 top-k


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(400)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(60)]  # ties
    vectors += [(2000, None), (2050, [1.0, None, 0.0]), (2100, [float("nan")] * 6), (2150, []), (None, [1.0] * 6), (50, vectors[50][1])]
    df = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<double>, cell string").repartition(5)
    ok = [(i, v, np.floor(256 * np.array([*e, *[0.0] * (6 - len(e))]))) for i, (v, e) in enumerate(vectors) if v is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    expected = []
    for i, v, q in ok:
        if v % 50 == 0:
            best = sorted((-int(q @ d), w) for j, w, d in ok if j != i)[:5]
            expected += [(v, r + 1, w, -s) for r, (s, w) in enumerate(best)]
    for size in (dict(), dict(group_rows=3, block_rows=64, pivots=(8, 8))):
        assert sorted(tuple(r) for r in topk.top_k(df, topk.Params(**size)).collect()) == sorted(expected)
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id in (100, 101)")).count() == 1


def test_data_go_only_to_groups_that_can_need_them(spark):
    """Rows in clusters: the bounds keep most data from most groups, and the result is still exact."""
    rng = np.random.default_rng(8)
    middle = rng.normal(0, 1, (40, 16))
    x = middle[np.arange(4000) % 40] + rng.normal(0, 0.02, (4000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    p = topk.Params(every=20, group_rows=16, block_rows=1000)
    sent, _, groups = topk.sent_rows(df, p)
    assert groups >= 10
    assert sent.where("not as_query").count() < 0.5 * groups * len(x)
    whole = np.floor(256 * x.astype(np.float32).astype(float)).astype(np.int64)
    for r in topk.top_k(df, p).collect():
        score = whole @ whole[r.query_id]
        score[r.query_id] = -(10**12)
        best = np.lexsort((np.arange(len(x)), -score))[r.rank - 1]
        assert (r.vec_id, r.score) == (best, score[best])


# -- 8 decontamination


def test_containment_equals_brute_force(spark):
    items = [(i, prose(100 + i, n)) for i, n in enumerate([3, 5, 8, 20, 45, 80, 200])] + [(50, None), (51, ""), (3, prose(103, 20))]
    hide = lambda seed, item: f"{prose(seed, 3000, 10**6)} {item} {prose(seed + 1, 2500, 10**6)}"
    rows = [(200 + i, hide(500 + 2 * i, t)) for i, t in items if t]
    rows += [(60, hide(600, " ".join(items[4][1].split()[:40]))), (61, hide(610, " ".join(items[4][1].split()[:30]))), (62, items[5][1].upper()), *ODD]
    bench = spark.createDataFrame([(*x, "t") for x in items], "item_id long, text string, doc_id string")
    sets = decontaminate.item_shingles([t or "" for _, t in items], 5)
    texts = decontaminate.item_shingles([r[1] or "" for r in rows], 5)
    expected = Counter()
    for r, d in zip(rows, texts, strict=True):
        for (item, t), s in zip(items, sets, strict=True):
            n = len(np.intersect1d(s, d))
            if t is not None and len(s) and n >= 0.8 * len(s):
                expected[r[0], item, len(s), n] += 1
    for p in (decontaminate.Params(), decontaminate.Params(block_items=3)):
        found = Counter((r.doc_id, r.item_id, r.item_shingles, r.shared) for r in decontaminate.contained(docs(spark, rows), bench, p).collect())
        assert found == expected
    clean = decontaminate.keep_clean(docs(spark, rows), bench)
    assert Counter(r.doc_id for r in clean.collect()) == Counter(r[0] for r in rows if not any(k[0] == r[0] for k in expected))
    assert decontaminate.contained(docs(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.contained(docs(spark, rows).limit(0), bench).count() == 0


# -- 9 packing


def check_packing(rows, found, limits):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    whole = {}
    for r in found:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length > 0 and r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        whole.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, pieces in whole.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == len(ids[i])
    assert set(whole) == set(ids)
    for seq in {r.sequence_id for r in found}:
        own = sorted((r.offset, r.length, r.segment, r.loss_tokens) for r in found if r.sequence_id == seq)
        assert [o for o, *_ in own] == [sum(x[1] for x in own[:k]) for k in range(len(own))]
        assert sum(x[1] for x in own) <= limits.tokens and len(own) <= limits.segments and sum(x[3] for x in own) <= limits.loss_tokens


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(tokens=64, segments=3, loss_tokens=40, pool=5)])
def test_packing(spark, limits):
    rows = [(1, None), (2, ""), (3, "a <|endoftext|> b"), (4, "ünïcode 漢字 🙂\n\n  x"), *[(10 + i, prose(i, n)) for i, n in enumerate([1, 2, 5, 9, 30, 100, 400, 1500])]]
    found = packing.pack(docs(spark, rows).coalesce(1), tokenizer_path(), limits).collect()
    check_packing(rows, found, limits)
    if limits.tokens == 2048:
        sizes = Counter()
        for r in found:
            sizes[r.sequence_id] += r.length
        assert all(n & (n - 1) == 0 for n in sizes.values())  # no padding
    assert packing.pack(docs(spark, rows).limit(0), tokenizer_path(), limits).count() == 0
    repeated = packing.pack(docs(spark, [(4, "one"), (4, "one")]).coalesce(1), tokenizer_path(), limits).collect()
    assert len(repeated) == 2


def test_the_limits_bind_each_in_turn(spark):
    """Prompts and answers: short texts fill the segments, long answers the loss-bearing tokens, long prompts the tokens."""
    rng = np.random.default_rng(2)
    rows = [(i, prose(i, int(rng.choice([1, 2, 40, 90]))), "assistant" if i % 2 else "user") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, role string").coalesce(1)
    limits = packing.Limits(tokens=500, segments=6, loss_tokens=250, pool=24)
    found = packing.pack(df, tokenizer_path(), limits, bears=F.col("role") == "assistant").collect()
    check_packing([(i, t) for i, t, _ in rows], found, limits)
    role = {i: r for i, _, r in rows}
    assert all(r.loss_tokens == (r.length - 1 if role[r.doc_id] == "assistant" else 0) for r in found)
    sums = {}
    for r in found:
        x = sums.setdefault(r.sequence_id, [0, 0, 0])
        x[0], x[1], x[2] = x[0] + r.length, x[1] + 1, x[2] + r.loss_tokens
    full = Counter(tuple(a >= b for a, b in zip(x, (limits.tokens, limits.segments, limits.loss_tokens), strict=True)) for x in sums.values())
    assert all(sum(n for k, n in full.items() if k[d]) > 0 for d in range(3)), full


def test_sequences_equal_a_plain_packer():
    """The sequences of one task against the rule, said plainly."""
    rng = np.random.default_rng(5)
    limits = packing.Limits(tokens=50, segments=4, loss_tokens=35, pool=9)
    examples = [(i, int(rng.integers(1, 140)), bool(rng.integers(0, 2))) for i in range(150)]
    packer = packing.Packer(limits, 0)
    waiting, sequences = [], []

    def loss(n, bears):
        return n - 1 if bears else 0

    def fill(tokens):
        cap, free, sequence = (tokens, 4, 35), [1.0, 1.0, 1.0], []
        needs = [[a / c for a, c in zip((n, 1, loss(n, b)), cap, strict=True)] for _, _, n, b in waiting]
        weight = [sum(x[k] for x in needs) / len(needs) for k in range(3)]
        todo = list(range(len(waiting)))
        while fits := [i for i in todo if all(needs[i][k] <= free[k] + 1e-9 for k in range(3))]:
            best = max(fits, key=lambda i: (round(sum(needs[i][k] * weight[k] * free[k] for k in range(3)), 12), -i))
            sequence.append((*waiting[best][:2], waiting[best][2]))
            free = [free[k] - needs[best][k] for k in range(3)]
            todo.remove(best)
        rest = [waiting[i] for i in todo]
        used = sum(x[2] for x in sequence)
        room = {True: min(tokens - used, round(free[2] * 35) + 1), False: tokens - used}
        if len(sequence) < 4 and (cut := [i for i, x in enumerate(rest) if room[x[3]] > 0]):
            at = max(cut, key=lambda i: min(rest[i][2], room[rest[i][3]]))
            doc, start, n, bears = rest[at]
            k = min(n, room[bears])
            sequence.append((doc, start, k))
            rest[at : at + 1] = [(doc, start + k, n - k, bears)] if n > k else []
        waiting[:] = rest
        sequences.append(sequence)

    for doc, n, bears in examples:
        packer.add(doc, np.zeros(n, "<u4").tobytes(), bears)
        start, full = 0, 36 if bears else 50
        while n - start >= full:
            sequences.append([(doc, start, full)])
            start += full
        if n > start:
            waiting.append((doc, start, n - start, bears))
            while len(waiting) >= 9:
                fill(50)
    packer.finish()
    while waiting:
        left = sum(x[2] for x in waiting)
        fill(50 if left >= 50 else 1 << (left.bit_length() - 1))
    got = {}
    for r in packer.rows:
        got.setdefault(r[5], []).append((r[6], r[0], r[1], r[2]))
    assert [[x[1:] for x in sorted(got[k])] for k in sorted(got)] == sequences


def test_both_libraries_give_the_same_ids():
    """The merges go by rank (a proof over all tokens), and every code point is split alike, beside letters, digits, spaces and marks."""
    assert packing.merges_by_rank(tokenizer_path())
    fast, plain = packing.encoder(tokenizer_path(), True), packing.encoder(tokenizer_path(), False)
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for begin in range(0, len(points), 64):
        if begin < 0x3000 or begin % 512 == 0 or 0x1F000 <= begin < 0x32000:
            part = points[begin : begin + 64]
            texts = ["".join(f"a{c}b1{c}2 {c}!{c}\n{c}" for c in part)]
            assert fast(texts) == plain(texts), hex(begin)
    texts = ["don't I'LL 's\u2019s", "\u0300\u0301x", "\u3000\u3000x", "a\x85b\u2028c", " " * 40 + "x", "\n\n \n", "e\u0301\u200d\ufe0f", "٣٤٥ ௧", "", "\0\0a"]
    assert fast(texts) == plain(texts)


def test_a_very_long_text_is_cut_in_linear_time():
    def seconds(n):
        packer, begin = packing.Packer(packing.Limits(), 0), time.perf_counter()
        packer.add(1, bytes(4 * n))
        packer.finish()
        return time.perf_counter() - begin

    seconds(10_000)
    assert seconds(10_000_000) < 1.5


# -- 10 near duplicates


def test_signature_agreement_estimates_similarity():
    a = prose(1, 400).split()
    texts = [" ".join(a), " ".join([*a[:380], *prose(2, 20).split()])]
    cell, bounds = near_dup.cells(texts, 5)
    sig = near_dup.signatures(cell, bounds, 2000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(near_dup.similarity(texts[:1], texts[1:], 5)[0], abs=0.04)
    assert (sig != 0).all()
    one = near_dup.signatures(*near_dup.cells(["a b", "", "a b c d e f"], 5), 80)
    assert (one[0] != 0).all() and (one[1] == 0).all()


def brute_classes(rows):
    bags = []
    for _, t in rows:
        v, _ = near_dup.cells([t or ""], 5)
        bags.append(set(v.tolist()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and len(bags[i] & bags[j]) >= 0.8 * len(bags[i] | bags[j]):
                parent[find(i)] = find(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(rows[i][0])
    return sorted(sorted(-1 if x is None else x for x in g) for g in out.values())


def test_near_duplicates_equal_brute_force(spark):
    rows = list(ODD)
    for g in range(25):
        base = prose(g, 300).split()
        rng = np.random.default_rng(g)
        for k in range(1 + g % 5):
            text = list(base)
            for at in rng.integers(0, 300, k * 2):
                text[at] = f"n{rng.integers(0, 10**6)}"
            rows.append((100 + 10 * g + k, " ".join(text)))
    rows += [(800 + i, rows[20][1]) for i in range(30)] + [(900, rows[20][1].upper())]
    found = {}
    for r in near_dup.near_duplicates(docs(spark, rows).repartition(4)).collect():
        found.setdefault(("alone", r.doc_id) if r.class_id is None or r.doc_id in (1, 2, 3, 5) else r.class_id, []).append(-1 if r.doc_id is None else r.doc_id)
    assert sorted(sorted(g) for g in found.values()) == brute_classes(rows)
    kept = near_dup.keep_one(docs(spark, rows)).collect()
    assert len(kept) == len(brute_classes(rows)) and kept[0].rkey == 1
    assert near_dup.near_duplicates(docs(spark, rows).limit(0)).count() == 0
    assert near_dup.keep_one(docs(spark, rows).limit(0)).count() == 0


def test_a_large_group_of_near_copies_is_one_class(spark):
    base = prose(77, 200).split()
    rng = np.random.default_rng(7)
    rows = []
    for i in range(400):
        text = list(base)
        for at in rng.integers(0, 200, 4):
            text[at] = f"m{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(text)))
    rows.append((1000, " ".join(base)))
    found = {}
    for r in near_dup.near_duplicates(docs(spark, rows)).collect():
        found.setdefault(r.class_id, []).append(r.doc_id)
    assert sorted(sorted(g) for g in found.values()) == brute_classes(rows)
    assert max(map(len, found.values())) > 300


def test_near_duplicates_of_few_rows_are_kept_in_few_files(spark, spread):
    rows = [(10 * g + k, prose(g, 60) + " end" * (k % 2)) for g in range(20) for k in range(8)]
    kept = near_dup.keep_one(docs(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == [min(g) for g in brute_classes(rows)]
    assert 0 < spread() < 200


def test_pairs_in_a_large_family_are_found(spark):
    rng = np.random.default_rng(11)
    part = lambda n: " ".join(f"x{x}" for x in rng.integers(0, 10**9, n))
    template, rows = part(800), []
    for i in range(150):
        shared = f"{template} {part(18)}"
        rows += [(2 * i, f"{shared} {part(90)}"), (2 * i + 1, f"{shared} {part(90)}")]
    found = {}
    for r in near_dup.near_duplicates(docs(spark, rows)).collect():
        found.setdefault(r.class_id, []).append(r.doc_id)
    assert sorted(sorted(g) for g in found.values()) == brute_classes(rows)
    assert len(found) == 150


def test_hot_cores_are_counted_alone(spark, monkeypatch):
    """Whether contexts are moved to meet the hot cores goes by the number of these, not of all cores."""
    rng = np.random.default_rng(3)
    draw = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    common, pairs = draw(300), [draw(300) for _ in range(30)]
    texts = [draw(50) + common + draw(50) for _ in range(20)] + [draw(50) + x + draw(50) for x in pairs * 2]
    asked, limited = [], exact_substrings.limited
    monkeypatch.setattr(exact_substrings, "limited", lambda df, n, most: asked.append((df.columns, n, df.count())) or limited(df, n, most))
    docs = exact_substrings.text_keys(spark.createDataFrame([(x,) for x in texts], "text string"))
    found, _ = exact_substrings.repeated_starts(docs, exact_substrings.Params(length=200, hot=4))
    assert found.count() == 80
    cores = [(n, rows) for columns, n, rows in asked if columns == ["core"]]
    assert len(cores) == 2 and all(n == rows for n, rows in cores) and cores[1][0] < cores[0][0]
