"""The training-data operators against brute force, exact round trips and held-out accuracy, and on edge cases."""

import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodeweave.llm import byte_bpe, chat, html_text, language_id, mixing, near_dup, quality, token_counts, vector_dup
from lodeweave.llm._common import components

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "a", "é" * 9, "x" * 5000, "Hello world  \t and more 123's 'll", "<|endoftext|> end <|endoftext|>", "日本語 テキスト", "a b " * 3000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string"


def docs_of(spark, texts, **columns):
    rows = [(i, t, columns.get("lang", {}).get(i, "en"), columns.get("source", {}).get(i, "s"), len(t or ""), "own", "own") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- op1


def test_features_count_tokens_and_pairs():
    data = "The the cat!! sat".encode()
    both = np.frombuffer(data + b"the cat", np.uint8)
    buckets, owner = quality.features(both, np.array([len(data), len(data) + 7]))
    counts = Counter(owner.tolist())
    assert counts == {0: 5 + 4, 1: 2 + 1}
    first, second = set(buckets[owner == 0].tolist()), set(buckets[owner == 1].tolist())
    assert second <= first  # lower case: "the", "cat" and "the cat" are in both


def test_gumbel_top_k_equals_a_sort(spark):
    rng = random.Random(1)
    rows = [(i, None if i % 17 == 0 else rng.random() / 100) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, score double")
    for k in (0, 1, 137, 499, 500, 900):
        got = {r.doc_id for r in quality.gumbel_top_k(df, k).where("kept").collect()}
        assert len(got) == min(k, 500)
    noise = spark.createDataFrame(rows, "doc_id long, score double").select("doc_id", ((F.pmod(F.xxhash64("doc_id", F.lit(quality.SEED)), F.lit(1 << 52)) + 0.5) / float(1 << 52)).alias("u")).collect()
    key = {r.doc_id: -math.log(-math.log(r.u)) for r in noise}
    order = sorted(rows, key=lambda r: -((-1e9 if r[1] is None else quality.SHARPNESS * r[1]) + key[r[0]]))
    assert {r.doc_id for r in quality.gumbel_top_k(df, 100).where("kept").collect()} == {r[0] for r in order[:100]}


def test_quality_keeps_clean_and_drops_junk(spark):
    clean = [f"the {a} of {b} was {c} in that house" for a, b, c in itertools.product("ale bee cat dog".split(), "ink jam".split(), "red old new".split())] * 4
    junk = ["$$$ ### !!! %%% $$$ ### !!! buy"] * 20
    docs = docs_of(spark, clean + junk + ODD)
    labels = spark.createDataFrame([(i, 1 if i < len(clean) else 0, 0) for i in range(len(clean) + len(junk))], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.kept for r in quality.resample(docs, labels).collect()}
    assert len(out) == len(clean) + len(junk) + len(ODD)
    assert all(out[i] for i in range(len(clean))) and not any(out[i] for i in range(len(clean), len(clean) + len(junk)))
    kept = quality.select_quality(docs, labels)
    assert kept.columns[:5] == docs.columns[:5] and "kept" not in kept.columns
    assert quality.resample(docs.limit(0), labels).count() == 0
    assert quality.resample(docs, labels.limit(0)).where("kept").count() == docs.count()


# ---- op2


def test_vector_links_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:25] + rng.normal(size=(25, 16)) * 0.15, base[:5]]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None] * 8), (904, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n_links", F.lit("clash"))
    got = {r.vec_id: r for r in vector_dup.link_classes(df).collect()}
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    near = y @ y.T >= 0.9
    assert [got[i].n_links for i in range(len(x))] == (near.sum(1) - 1).tolist()
    for i in range(len(x)):
        reach, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]).tolist():
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        assert got[i].component_id == min(reach) and got[i].kept == (min(reach) == i)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (900, 901, 902, 903, 904))
    assert vector_dup.link_classes(df.limit(0)).count() == 0


def test_vector_links_of_extreme_and_nameless_vectors(spark):
    rows = [(1, [1e200, 0.0]), (2, [1e-200, 1e-200]), (3, [5e-324, 0.0]), (4, [1e200, 1e199]), (None, [3.0, 3.1]), (None, [0.0, -2.0]), (None, [0.01, -2.0]), (9, [-1.0, 0.0]), (9, [0.0, 1.0]), (9, [0.1, 1.0])]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dup.link_classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    want = [(1, 2, 1, True), (3, 2, 1, False), (4, 2, 1, False), (2, 1, 2, True), (None, 1, 2, False), (None, 1, None, False), (None, 1, None, False), (9, 0, 9, True), (9, 1, 9, True), (9, 1, 9, True)]
    assert got == sorted(want, key=str)
    named = vector_dup.link_classes(spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0])], "vec_id string, embedding array<double>")).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in named} == {("a", 1, "a", True), ("b", 1, "a", False)}


def test_vector_links_through_many_cells_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(700, 32))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.42, base[:200] + rng.normal(size=(200, 32)) * 0.3])
    y = x / np.linalg.norm(x, axis=1)[:, None]
    want = np.argwhere(np.triu(y @ y.T >= 0.9, 1))
    assert len(want) > 500
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, embedding array<double>").cache()
    for cell, block in ((400, 1024), (6, 1024), (400, 100)):  # 2 signs, 8 signs, cells in pairs of blocks
        monkeypatch.setattr(vector_dup, "CELL", cell)
        monkeypatch.setattr(vector_dup, "BLOCK", block)
        got = {(r.a, r.b) for r in vector_dup.alike(vector_dup.candidates(df), df).collect()}
        assert got <= {tuple(p) for p in want.tolist()} and len(got) >= 0.99 * len(want)


def test_collisions_equal_counting_all():
    rng = np.random.default_rng(0)
    v, w = rng.integers(-60, 60, (300, 32)).astype(np.int16), rng.integers(-60, 60, (70, 32)).astype(np.int16)
    i, j = vector_dup.colliding(v, w, 20.0, 13)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {tuple(p) for p in np.argwhere((np.abs(v[:, None] - w[None]) <= 20).sum(2) >= 13).tolist()}


# ---- op3


def test_snapshots_collapse_to_maximal_conversations(spark):
    talks = {1: ["a", "b"], 2: ["a", "b", "c"], 3: ["a", "b", "c"], 4: ["a", "x"], 5: ["b"], 6: [None], 7: [""]}
    rows = [(c, t, "user" if t % 2 == 0 else "bot", x) for c, xs in talks.items() for t, x in enumerate(xs)] + [(4, 1, "bot", "x"), (None, 0, None, "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit("clash"))
    got = {r.conv_id: r for r in chat.collapse_and_render(df).collect()}
    assert set(got) == {2, 4, 5, 6, None}
    assert got[2].n_copies == 2 and got[6].n_copies == 2 and got[4].n_turns == 2
    assert got[4].text == "<|im_start|>user\na<|im_end|>\n<|im_start|>bot\nx<|im_end|>\n"
    assert chat.collapse_and_render(df.limit(0)).count() == 0


# ---- op4


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    docs = docs_of(spark, ODD)
    got = {r.doc_id: r for r in token_counts.token_counts(docs, chunk_chars=64, overlap_chars=8).collect()}
    for i, t in enumerate(ODD):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 512)
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_spliced_ids_equal_whole_ids(documents):
    counter = token_counts.Counter(public_tokenizers.path(token_counts.VOCABULARY), 100, 10)
    for t in [r.text for r in documents.limit(40).collect()] + [x for x in ODD if x]:
        for chunk, overlap in ((50, 5), (300, 20), (1000, 100)):
            assert token_counts.spliced_ids(t, counter.encode, chunk, overlap) == counter.encode(t)[0]


# ---- op5


def brute_classes(texts, idf):
    sets = {i: near_dup.weighted(t, idf) for i, t in enumerate(texts)}
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if texts[a] is not None and (texts[a] == texts[b] or near_dup.jaccard(sets[a], sets[b]) >= 0.8):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in range(len(texts))}


def test_near_duplicate_classes_equal_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [" ".join(word() for _ in range(120)) for _ in range(25)]
    for i in range(15):
        near = texts[i].split()
        for _ in range(rng.choice((1, 2, 3, 8))):
            near[rng.randrange(120)] = "new"
        texts += [" ".join(near), texts[i]]
    texts += ODD + ["two words", "two words", None, ""]
    docs = docs_of(spark, texts)
    idf = near_dup.idf_table(docs.select("text"))
    got = {r.doc_id: r.class_id for r in near_dup.classes(docs).collect()}
    assert got == brute_classes(texts, idf)
    kept = near_dup.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(got.values()))
    assert near_dup.classes(docs.limit(0)).count() == 0


def test_null_and_repeated_ids_lose_no_text(spark):
    rng = random.Random(3)
    text = lambda: ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(150)]
    a, c, d, e, f, g, h = (text() for _ in range(7))
    # near b and c, but a and c are further apart
    b, c = [*c[:6], *a[6:]], [*c[:6], *a[6:-13], *c[6:19]]
    e_near, g_near = [*e[:-1], "new"], [*g[:-1], "new"]
    rows = [(1, a), (None, b), (2, c), (None, d), (None, e), (None, e_near), (7, f), (7, g), (8, g_near), (7, h), (7, h), (None, d)]
    rows = [(i, " ".join(t)) for i, t in rows] + [(None, None), (None, None), (9, None), (9, "one"), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("more", F.lit(1)).repartition(3)
    idf = near_dup.idf_table(docs.select("text"))
    sim = lambda x, y: near_dup.jaccard(near_dup.weighted(" ".join(x), idf), near_dup.weighted(" ".join(y), idf))
    assert sim(a, b) >= 0.8 and sim(b, c) >= 0.8 and sim(a, c) < 0.8
    got = near_dup.classes(docs).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == Counter([(1, 1), (None, 1), (2, 1), (None, None), (None, None), (None, None), (None, None), (7, 7), (7, 7), (8, 7), (7, 7), (7, 7), (None, None), (None, None), (9, 9), (9, 9), (None, None)])
    # a b c; d d; e, its near; f; g, its near; h h; three without text; "one"; ""
    assert sum(r.kept for r in got) == 6 + 3 + 2
    kept = near_dup.one_of_each(docs)
    assert kept.columns == docs.columns
    out = Counter((r.doc_id, r.text) for r in kept.collect())
    first_e = min((" ".join(x) for x in (e, e_near)), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    assert out == Counter([(1, " ".join(a)), (None, " ".join(d)), (None, first_e), (7, " ".join(f)), (7, " ".join(g)), (7, " ".join(h)), (None, None), (None, None), (9, None), (9, "one"), (None, "")])


def test_shingles_are_runs_of_five_words():
    assert len(near_dup.shingles(" a b\tc d\ne f ")) == 2 and len(near_dup.shingles("a b")) == 1 and len(near_dup.shingles(" ")) == 0
    assert (near_dup.shingles("a b c d e") == near_dup.shingles("  a  b c d\n\ne ")).all()


def test_samples_agree_as_often_as_the_similarity_says():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    w = rng.uniform(0.5, 2, 300)
    a, b = (h[:240], w[:240]), (np.concatenate([h[:200], h[240:]]), np.concatenate([w[:200], w[240:]]))
    sampler = near_dup.Sampler(4000)
    order = [np.argsort(x[0]) for x in (a, b)]
    a, b = (tuple(v[o] for v in x) for x, o in zip((a, b), order, strict=True))
    agree = (sampler.samples(*a) == sampler.samples(*b)).mean()
    assert abs(agree - near_dup.jaccard(a, b)) < 0.03


# ---- op6


def test_language_of_held_out_documents(spark, documents):
    docs = documents.unionByName(spark.createDataFrame([(10_000 + i, t, "en", "s", 0) for i, t in enumerate([None, "", "123 !!", "\n"])], documents.schema))
    out = language_id.identify(docs).join(docs, "doc_id").collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in out if r.doc_id >= 10_000)
    long = [r for r in out if r.held_out and r.doc_id < 10_000 and len(r.text) > 100]
    assert sum(r.lang == r.lang_pred for r in long) >= 0.95 * len(long)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert all(0 <= r.score <= 1 for r in out)


def test_language_without_labels_or_rows(spark):
    docs = docs_of(spark, ["some text", None], lang={0: None, 1: None})
    assert {r.lang_pred for r in language_id.identify(docs).collect()} == {"und"}
    assert language_id.identify(docs.limit(0)).count() == 0
    assert language_id.known_language(docs).count() == 0


def test_windows_cover_the_text():
    data = bytes(range(1, 251)) * 5
    windows, held = language_id.cut(data)
    step = windows.shape[1] - max(language_id.WIDTHS) + 1
    whole = np.concatenate([w[:step] for w in windows[:-1]] + [windows[-1]]).tobytes()
    assert whole[: len(data)] == data and held.sum() >= len(data) - 3
    assert language_id.cut(b"")[0].shape == (1, language_id.WINDOW)


# ---- op8


def page(body, head="<title>T</title><style>p{}</style>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body><nav><ul><li><a href=/>Home page</a></li></ul></nav>{body}<footer>&copy; all</footer></body></html>"


def test_main_text_by_consensus(spark):
    article = "<div class='post-1'><h1>Head &amp; line</h1><p>One <b>bold</b>  text.<br>Next sentence here. And more words.<p>Two &lt;tags&gt;.</div>"
    noise = "<div class=ad>Buy now. Best.</div><aside>side</aside><section id='comments'><p>I liked it. Very much.</p></section><form>f<input></form>"
    weird = page("<div class='post-2'><p>Short.</p></div><div class=box><p>Long text outside of it. With sentences. And more of them, many more of them.</p></div>")
    rows = [(i, "http://h.org/a", page(noise + article + "<script>var x='</p>';</script>")) for i in range(5)]
    rows += [(5, "http://h.org/b", weird), (6, None, None), (7, "nohost", ""), (8, "http://x.org", "plain text &amp; no tags"), (9, "http://x.org", "<p>open <div>x")]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))).collect()}
    want = "Head & line One bold text. Next sentence here. And more words. Two <tags>."
    assert got[0].text == want and got[0].n_chars == len(want)
    assert got[5].text == "Short."  # the host's path, not the page's own
    assert got[6].text == "" and got[7].n_chars == 0 and got[8].text == "plain text & no tags"
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def texts_of(spark, bodies, host="http://w.org/"):
    rows = [(i, f"{host}{i}", page(b)) for i, b in enumerate(bodies)]
    return [r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_main_text_is_the_whole_article(spark):
    items = "".join(f"<li>Item {i} of a long list. It says much.</li>" for i in range(20))
    listed = " ".join(f"Item {i} of a long list. It says much." for i in range(20))
    for tag in ("ul", "ol"):
        assert texts_of(spark, [f"<article><h1>Head</h1><p>Intro.</p><{tag}>{items}</{tag}><p>End.</p></article>"] * 3) == [f"Head Intro. {listed} End."] * 3
    for tag in ("dl", "table", "figure"):
        assert texts_of(spark, [f"<article><h1>Head</h1><{tag}>Long words of it. {'More of them. ' * 30}</{tag}></article>"])[0].startswith("Head Long words")
    # all the worth is in a list: still the article, with its linked headline
    assert texts_of(spark, [f"<article><h1><a href=/x>Head</a></h1><ul>{items}</ul></article>"]) == [f"Head {listed}"]
    long = "A sentence of the body. " * 20
    assert texts_of(spark, [f"<article><h1>Head</h1><p>Lead.</p><div class=body>{long}</div></article>"]) == [f"Head Lead. {long.strip()}"]
    assert texts_of(spark, [f"<main><div class=body>{long}</div><div class=rest>Its end.</div></main>"]) == [f"{long.strip()} Its end."]


def test_noise_is_told_by_whole_names(spark):
    text = "<h1>Head</h1><p>Words of it. And more.</p>"
    want = "Head Words of it. And more."
    bodies = [f"<main class='content with-sidebar'>{text}</main>", f"<article class='entry share-enabled'>{text}</article>", f"<article id=share-1>{text}</article>", f"<article><div class=article-header><h1>Head</h1></div><p>Words of it. And more.</p></article>", f"<div class=nav-open><main>{text}</main></div>", f"<div data-hidden='false'>{text}</div>", f"<div data-title='A hidden valley'>{text}</div>", f"<div data-id=nav data-style='display:none'>{text}</div>", f"<div title='class=ad'>{text}</div>"]
    assert [texts_of(spark, [b], f"http://n{i}.org/")[0] for i, b in enumerate(bodies)] == [want] * len(bodies)
    wrapped = [f"<html><body class='no-sidebar nav' style='visibility:hidden'><div>{text}</div></body></html>", f"<body><form>{text}</form></body>", f"<div class=sidebar>{text}</div>", f"<div class=banner-1>{text}</div><div hidden>Not this. No.</div>"]
    assert [" ".join(t for _, t, _ in html_text.blocks(h)) for h in wrapped] == [want] * len(wrapped)
    noise = "".join(f"<div {a}>Noise of it. Much.</div>" for a in ("class=ad", "class='x ad-slot'", "id=commentsList", "class='SideBar sidebar_left'", "role=banner", "hidden", "style='display: none'", "aria-hidden=true"))
    assert [t for _, t, _ in html_text.blocks(f"{noise}<div>{text}</div>")] == ["Head", "Words of it. And more."]


def test_layouts_of_one_host_keep_their_own_paths(spark):
    short, long = "<div class=teaser>Short.</div>", "<div class=story>Long text of it. With sentences. And more.</div>"
    got = texts_of(spark, [short] * 6 + [short + long] * 2)
    assert got == ["Short."] * 6 + ["Short. Long text of it. With sentences. And more."] * 2
    # a winning path without worth on the page
    assert texts_of(spark, [short] * 6 + [f"<div class=teaser><a href=/>More here</a></div>{long}"])[6] == "Long text of it. With sentences. And more."


def test_a_tag_without_an_end_is_read_once():
    import time

    began = time.process_time()
    for run in ("<" + "a" * 1_000_000, "<a " + "b=c " * 250_000, "<a href='" + "x" * 1_000_000):
        found = html_text.blocks(f"<p>Words of it. And more.</p>{run}")
        assert found[0][1] == "Words of it. And more."
    assert time.process_time() - began < 20


# ---- op9


def library():
    import tiktoken

    ranks = byte_bpe.ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_and_decodes(spark, documents):
    texts = ODD + [r.text for r in documents.limit(60).collect()]
    docs = docs_of(spark, texts)
    own = library()
    ids = {r.doc_id: r.ids for r in byte_bpe.encode(docs, chunk_bytes=20_000).collect()}
    back = {r.doc_id: r for r in byte_bpe.digests(docs).collect()}
    for i, t in enumerate(texts):
        want = own.encode_ordinary(t or "")
        assert ids[i] == want
        assert back[i].n_tokens == len(want)
        assert back[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert back[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.encode(docs.limit(0)).count() == 0


def test_bpe_of_huge_words_and_empty_chunks(spark):
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("etaoinshrdlu") for _ in range(n))
    own = library()
    texts = [letters(20_000), "ab" * 5000, "é" * 3000, letters(byte_bpe.LONG), letters(byte_bpe.LONG + 1), "z " + letters(4000)]
    got = {r.doc_id: r.ids for r in byte_bpe.encode(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [own.encode_ordinary(t) for t in texts]
    huge = letters(200_000)
    back = byte_bpe.digests(docs_of(spark, [huge])).first()
    assert back.decoded_sha256 == hashlib.sha256(huge.encode()).hexdigest()
    none = byte_bpe.encode(spark.createDataFrame([("a", ""), (None, None), ("a", "")], "doc_id string, text string")).collect()
    assert Counter((r.doc_id, r.n_bytes, tuple(r.ids)) for r in none) == Counter([("a", 0, ()), ("a", 0, ()), (None, 0, ())])


def test_heap_and_pieces_equal_the_library():
    own, known = library(), byte_bpe.ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    rng = random.Random(2)
    for _ in range(300):
        word = "".join(rng.choice("abehilnorst") for _ in range(rng.randrange(1, 40)))
        assert byte_bpe.merged_word(word.encode(), known) == own.encode_ordinary(word)


def test_white_space_falls_into_the_same_words(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "bc", " ", " ", "\n", "\t", "\u00a0", "'s", "1", "!?", "\u2003", "\r"]) for _ in range(30)) for _ in range(300)]
    texts += ["a\nb c", "a \nb", "a\n b", "a\n\nb", " a", "\na", "a ", "a\n", "\n", "a b\nc\n"]
    own = library()
    got = {r.doc_id: r.ids for r in byte_bpe.encode(docs_of(spark, texts), chunk_bytes=500).collect()}
    assert [got[i] for i in range(len(texts))] == [own.encode_ordinary(t) for t in texts]


# ---- op10


def targets_by_loop(sizes):
    names = sorted((k for k in sizes if k is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}
    total = 1.5 * sum(sizes.values())
    full, left = {}, dict(weight)
    while True:
        rest = total - sum(full.values())
        share = {k: rest * w / sum(left.values()) for k, w in left.items()}
        over = [k for k in left if share[k] > 2 * sizes[k]]
        if not over:
            return full | share
        for k in over:
            full[k] = 2.0 * sizes[k]
            del left[k]


def test_mix_meets_targets(spark, documents):
    docs = documents.unionByName(spark.createDataFrame([(5000, None, "en", None, 0), (5001, "one two\x0bthree", "en", None, 0), (5002, " ", "en", "zz", 0), (5003, "a " * 3000, "en", "só", 0), (5003, "a " * 3000, "en", "só", 0)], documents.schema))
    rows = mixing.mix_counts(docs.withColumn("size", F.lit("clash")), block_words=32).join(docs.select("doc_id", "source").distinct(), "doc_id").collect()
    assert len(rows) == docs.count()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    want = targets_by_loop(sizes)
    for k in sizes:
        assert target[k] == pytest.approx(want[k]) and abs(taken[k] - target[k]) <= 32
    again = mixing.mix_counts(docs.repartition(7), block_words=32).collect()
    assert Counter((r.doc_id, r["size"], r.taken) for r in again) == Counter((r.doc_id, r["size"], r.taken) for r in rows)
    assert mixing.mix_counts(docs.limit(0)).count() == 0


def test_mixed_texts_hold_the_words_taken(spark, documents):
    counts = {r.doc_id: r.taken for r in mixing.mix_counts(documents).collect()}
    mixed = mixing.mix(documents)
    assert mixed.columns == documents.columns
    got = {r.doc_id: len(r.text.split()) for r in mixed.collect()}
    assert got == {k: n for k, n in counts.items() if n}


def test_permutation_is_one(spark):
    for n in (1, 2, 5, 16, 17, 300):
        side = mixing.feistel_side(F.lit(n).cast("long"))
        out = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), side, F.lit(3))).collect()]
        assert sorted(out) == list(range(n))


# ---- op7


def test_search_equals_scoring_all(spark, documents):
    from lodeweave.llm import search

    texts = [r.text for r in documents.orderBy("doc_id").collect()] + [None, "", "the the the"]
    docs = docs_of(spark, texts)
    queries = docs.where("doc_id % 50 = 0 OR doc_id >= 200").select(F.col("doc_id").alias("query_id"), "text", "score")
    got = {}
    for r in search.search(docs, queries, k=7, shard_bytes=60_000, at_once=2).collect():
        got.setdefault(r.query_id, {})[r.place] = (r.doc_id, r.score)
    bags = [Counter(search.terms(t)) for t in texts]
    df = Counter(t for b in bags for t in b)
    mean = sum(sum(b.values()) for b in bags) / len(bags)
    for q in [r.query_id for r in queries.collect()]:
        score = []
        for d, bag in enumerate(bags):
            norm = search.K1 * (1 - search.B + search.B * sum(bag.values()) / mean)
            s = sum(n * math.log(1 + (len(bags) - df[t] + 0.5) / (df[t] + 0.5)) * bag[t] * (search.K1 + 1) / (bag[t] + norm) for t, n in sorted(bags[q].items()) if bag[t])
            score.append((-s, d))
        want = [(d, -s) for s, d in sorted(score)[:7] if s < 0]
        mine = [got.get(q, {}).get(p) for p in range(1, len(want) + 1)]
        assert len(got.get(q, {})) == len(want)
        assert [round(x[1], 9) for x in mine] == [round(x[1], 9) for x in want]
        assert {x[0] for x, w in zip(mine, want, strict=True) if want.count(w) == 1} <= {d for d, s in want} | {x[0] for x in mine}
        # the documents too: those of a score that is not tied, and on ties (of scores equal to the last bit) the smaller ids
        for x, y in zip(mine, want, strict=True):
            assert x[0] == y[0] or abs(x[1] - y[1]) < 1e-9
    assert search.search(docs.limit(0), queries).count() == 0


def test_search_gives_ties_to_smaller_ids(spark):
    from lodeweave.llm import search

    docs = spark.createDataFrame([(i, "red fox" if i % 2 else "blue whale") for i in range(40, 0, -1)] + [(None, "red fox"), (7, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "fox fox"), (2, "whale red"), (3, "none"), (4, None)], "query_id long, text string")
    got = sorted((r.query_id, r.place, r.doc_id) for r in search.search(docs, asked, k=4, shard_bytes=40).collect())
    assert got == [(1, p, d) for p, d in enumerate((1, 3, 5, 7), 1)] + [(2, p, d) for p, d in enumerate((1, 2, 3, 4), 1)]


def test_an_index_holds_what_a_loop_counts():
    from lodeweave.llm import search

    texts = ["b a a", None, "c b", "a " * 9]
    own = search.Index.load(search.Index.build([5, 1, 9, 3], texts, 4.0).dump())
    assert own.ids.tolist() == [1, 3, 5, 9] and list(own.term) == ["a", "b", "c"]
    norm = {1: 0, 3: 9, 5: 3, 9: 2}
    want = {"a": {3: 9, 5: 2}, "b": {5: 1, 9: 1}, "c": {9: 1}}
    for t, i in own.term.items():
        some = slice(own.begin[i], own.begin[i + 1])
        got = dict(zip(own.ids[own.at[some]].tolist(), own.impact[some].tolist(), strict=True))
        assert got == {d: pytest.approx(n * 2.2 / (n + 1.2 * (0.25 + 0.75 * norm[d] / 4))) for d, n in want[t].items()}


# ---- pipeline


def test_stages_equal_plain_loops(spark, documents):
    """Each stage on its own input, with clashing columns: what it keeps follows from the operator's results row by row."""
    import corpus_pipeline

    (_, identified), (_, good), (_, unlike), (_, mixed), (_, encoded) = corpus_pipeline.STAGES
    docs = documents.withColumn("Score", F.lit("own")).withColumn("kept", F.lit("own")).withColumn("lang_pred", F.lit("own"))
    rows = {r.doc_id: r for r in docs.collect()}

    def same(df, without=()):
        own = [c for c in docs.columns if c not in without]
        assert df.columns == own
        out = df.collect()
        assert all(all(rows[r.doc_id][c] == r[c] for c in own) for r in out)
        return sorted(r.doc_id for r in out)

    told = language_id.identify(documents).collect()
    assert same(identified(spark, docs, SF)) == sorted(r.doc_id for r in told if r.lang_pred != "und" and r.score >= 0.4)
    judged = quality.resample(documents, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert same(good(spark, docs, SF), without=("Score", "kept")) == sorted(r.doc_id for r in judged if r.kept)
    texts = [rows[i].text for i in sorted(rows)]
    classes = brute_classes(texts, near_dup.idf_table(documents.select("text")))
    firsts = sorted({sorted(rows)[c] for c in classes.values()})
    assert same(unlike(spark, docs, SF)) == firsts
    taken = {r.doc_id: r.taken for r in mixing.mix_counts(documents).collect()}
    for r in mixed(spark, docs, SF).collect():
        words, own = r.text.split(), rows[r.doc_id].text.split()
        assert len(words) == taken.pop(r.doc_id) and set(words) <= set(own) and r.n_chars == len(r.text)
    assert not any(taken.values())
    library_of = library()
    for r in encoded(spark, docs, SF).collect():
        assert r.n_tokens == len(library_of.encode_ordinary(rows[r.doc_id].text))


def test_pipeline_runs_whole(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert set(out.columns) >= {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} and 0 < out.count() <= 200
