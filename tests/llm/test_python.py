"""Kneser-Ney, language ID, recurrent scoring, n-gram join, HTML extraction and packing."""

import ast
import math
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry import scratch
from docquarry.llm import common, components, gru_lm, html_extract, kneser_ney, langid, ngram_join, packing, queries


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


# Packing


def reference_ids(texts):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(packing.default_tokenizer())
    return [tool.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def test_word_ids_equal_the_tokenizer(odd):
    texts = [r["text"] or "" for r in odd.collect()] + ["don't stop, 5. (a), 'tis É. K. a\x85b\xa0c. J\u030c. e\u0301, ς Σ. a,b .c ... x.y.", "Á É ß ÿ ñandú, ñ."]
    tool = packing.WordIds(packing.default_tokenizer(), limit=8)
    for t, want in zip(texts, reference_ids(texts), strict=True):
        assert np.frombuffer(tool(t), dtype="<u4").tolist() == want[:-1]


def test_other_tokenizers_give_their_own_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tool = Tokenizer.from_file(path)
    for t in ("", "Don't stop, 5. (a)", "  two  spaces\n", "Ünï 😀"):
        assert np.frombuffer(packing.word_ids(path)(t), dtype="<u4").tolist() == tool.encode(t, add_special_tokens=False).ids
    assert isinstance(packing.word_ids(packing.default_tokenizer()), packing.WordIds)


def check_packing(rows, texts, capacity):
    bins = {}
    for doc, ids in texts:
        own = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(own):
            part = np.array(ids[at : at + capacity], dtype="<u4")
            assert (r["piece"], r["start"], r["length"], r["ids_crc32"]) == (k, at, len(part), zlib.crc32(part.tobytes()))
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            at += len(part)
        assert at == len(ids)
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity", [4096, 50])
def test_packing_by_round_trip(spark, data, capacity):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    rows, texts = packing.pack(docs, capacity=capacity).collect(), docs.select("doc_id", "text").collect()
    ids = reference_ids([r["text"] for r in texts])
    n = check_packing(rows, [(r["doc_id"], i) for r, i in zip(texts, ids, strict=True)], capacity)
    assert n <= math.ceil(sum(map(len, ids)) / capacity) * 1.03 + 1


def test_packing_odd_rows(odd, none):
    rows = packing.pack(odd, capacity=64).collect()
    assert sum(r["length"] for r in rows) == sum(map(len, reference_ids([r["text"] for r in odd.collect()])))
    assert packing.pack(none).count() == 0


def test_plan_places_everything_once():
    rng = random.Random(4)
    for _ in range(30):
        counts = Counter(rng.randint(1, 40) for _ in range(rng.randint(1, 300)))
        fill, ranks = Counter(), {}
        for length, first, n, uses, base, offset in packing.plan(counts, 40):
            assert ranks.get(length, 0) == first
            ranks[length] = first + n
            for k in range(n):
                fill[base + k // uses] += length
        assert ranks == dict(counts)
        assert max(fill.values()) <= 40 and sorted(fill) == list(range(len(fill)))
        assert len(fill) <= math.ceil(sum(k * v for k, v in counts.items()) / 40) * 1.25 + 1


# N-gram join


def brute_classes(rows, n=5):
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    ids = sorted(sets)
    root, links = {d: d for d in ids}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (find(d), links[d]) for d in ids}


def near_rows(seed, groups=12, copies=14):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, copies)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [256, 3])
def test_join_by_brute_force(spark, block):
    rows = near_rows(block)
    got = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == brute_classes(rows)


def test_join_odd_rows(odd, none):
    got = {}
    for r in ngram_join.classes(odd).collect():
        got.setdefault(r["doc_id"], []).append((r["class_id"], r["n_links"]))
    assert got[1] == [(1, 1)] and got[4] == [(1, 1)] and got[7] == [(7, 1), (7, 1)]
    assert got[2] == [(2, 0)] and got[3] == [(3, 0)] and got[5] == [(5, 0)] and got[6] == [(6, 0)]
    kept = ngram_join.keep_first(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 5, 6, 7, 7, 8]
    assert ngram_join.classes(none).count() == 0


def test_bands_reach_the_recall():
    bands, rows = ngram_join.bands_and_rows(0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= ngram_join.RECALL and bands * rows <= ngram_join.MAX_HASHES


def noised(rng, words, rate):
    return [w if rng.random() > rate else f"n{rng.randrange(1 << 40)}" for w in words]


def test_join_finds_pairs_just_above_the_threshold(spark):
    rng = random.Random(3)
    sets = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    rows, above, below = [], [], []
    while len(above) < 400:
        a = [f"w{rng.randrange(1 << 40)}" for _ in range(150)]
        b = noised(rng, a, 0.02)
        x, y = sets(a), sets(b)
        similar = len(x & y) / len(x | y)
        if 0.74 <= similar <= 0.86:
            (above if similar >= 0.8 else below).append(len(rows))
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[k + 1] == (k, 1) for k in above) >= 399
    assert below and all(got[k + 1] == (k + 1, 0) for k in below)


def test_boilerplate_sends_no_text(spark):
    """Documents that share half of their words are compared by signatures only."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(1 << 40)}"
    shared = [word() for _ in range(60)]
    rows = [(k, " ".join(shared + [word() for _ in range(60)])) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bands, per = ngram_join.bands_and_rows(0.8)
    signed = ngram_join.signatures(docs, 5, bands * per)
    keys = signed.select(F.explode(ngram_join.band_keys(F.col("sig"), bands, per)).alias("key")).groupBy("key").count().where("count > 1")
    assert keys.count() > 0
    assert ngram_join.candidates(signed.withColumnRenamed("doc_id", "node"), bands, per, (4, 5)).count() == 0
    assert ngram_join.classes(docs).where("n_links > 0 or class_id <> doc_id").count() == 0


def test_agreement_limit():
    least = ngram_join.least_agreement(0.8, 192)
    tail = lambda k: sum(math.comb(192, j) * 0.8**j * 0.2 ** (192 - j) for j in range(k))
    assert tail(least) <= ngram_join.AGREEMENT_LOSS < tail(least + 1)


def test_scratch_folder_is_never_local_on_a_cluster(spark, monkeypatch):
    class Unset:
        def __init__(self, master):
            self.conf = {}
            self.sparkContext = type("Context", (), {"master": master})()

    assert common.scratch_dir(Unset("local[2]")).startswith("file://")
    assert common.scratch_dir(Unset("local[2]")) == common.scratch_dir(Unset("local[2]"))
    with pytest.raises(ValueError, match="checkpoint.dir"):
        common.scratch_dir(Unset("spark://host:7077"))


def test_scratch_is_deleted_since_a_mark(spark):
    first = common.materialise(spark.range(3))
    mark = common.scratch_mark()
    second = common.materialise(spark.range(4))
    common.release(mark)
    assert first.count() == 3
    with pytest.raises(Exception):
        second.count()


def test_components(spark):
    rng = random.Random(6)
    links = [(k, k + 1) for k in range(60)] + [(100, 101 + k) for k in range(50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_words_hash_alike_wherever_they_stand():
    tool = ngram_join.Shingler()
    a, _ = tool.words(b"ab cd\xc3\xa9 ab")
    b, _ = tool.words(b"  cd\xc3\xa9\tab")
    assert a[0] == a[2] == b[1] and a[1] == b[0] and a[0] != a[1]


# HTML


def test_article_of_every_page(spark, data):
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in queries.op8_html_extraction(spark, data).collect():
        body = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>only this &amp; that", "only this & that"),
        ('<div id="header">S</div><div class="content"><h1>T</h1><p>a &nbsp; b<p>c <a href=x>link</a> d</div><div class="comments"><p>nice</p></div>', "T\na b\nc link d"),
        ("<article><p>One</p><form><p>Find</p></form><p>Two<script>if(a<b){'</p>'}</script></p><aside>x</aside></article><footer>f</footer>", "One\nTwo"),
        ("<ul><li><a href=1>Home</a><li><a href=2>About</a></ul><h1>Head</h1><p>" + "word " * 40 + "</p><p>Short.</p><p>" + "more " * 40 + "</p><div><a href=9>Next</a></div>", "Head\n" + ("word " * 40).strip() + "\nShort.\n" + ("more " * 40).strip()),
        ("<article><p>a &lt;b&gt; &#233;&#x1F600;</p></article>", "a <b> é😀"),
    ],
)
def test_pages(page, text):
    assert html_extract.article_text(page) == text


LONG = ("word " * 40).strip()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<div class="post-meta">By X</div><div class="text"><p>{LONG}</p></div>', f"By X\n{LONG}"),
        (f'<div class="main-image">I</div><p>{LONG}</p><article class="teaser">T</article><p>{LONG}</p>', f"I\n{LONG}\nT\n{LONG}"),
        (f'<article><h2 id="related-work">Related work</h2><p>{LONG}</p><section id="discussion"><p>{LONG}</p></section><p class="legal">Law</p></article>', f"Related work\n{LONG}\n{LONG}\nLaw"),
        (f"<p>{LONG}</p><ul>" + "<li><a href=x>more</a>" * 9 + f"</ul><p>{LONG} end</p>", f"{LONG}\n{LONG} end"),
        (f'<div class="content"><p>{LONG}</p><div class="cookie-banner"><p>{LONG}</p></div></div><p>After</p>', LONG),
    ],
)
def test_marks_lose_no_article_text(page, text):
    assert html_extract.article_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><div>Home | About</div><div><h1>Title</h1><p>{LONG}</p><p>short</p><p>{LONG}</p><p>end</p></div><div>Copyright 2020</div></body>", f"Title\n{LONG}\nshort\n{LONG}\nend"),
        (f"<body><div>Site name</div><h1>Title</h1><p>{LONG}</p><p>x</p><div>(c) 2020</div></body>", f"Title\n{LONG}\nx"),
        (f"<div id=wrap><div>Site</div><div><a href=/>Home</a> <a href=/b>B</a></div><h1>T</h1><div class=byline>By me</div><p>{LONG}</p><ul><li>a<li>b</ul><p>{LONG}</p><div>All rights reserved.</div></div>", f"T\nBy me\n{LONG}\na\nb\n{LONG}"),
        (f"<div><div>{LONG}</div><div class=ad>{LONG} ad</div><div>{LONG} 2</div></div>", f"{LONG}\n{LONG} 2"),
        (f"<article><h1>T</h1><p>{LONG}</p></article><article class='teaser'><p>Read this too</p></article>", f"T\n{LONG}"),
        (f"<main><h1>T</h1><div>By me</div><div>{LONG}</div></main><div>{LONG[:90]}</div>", f"T\nBy me\n{LONG}"),
        ("<article><h1>Hi</h1><p>Short.</p></article><div>Site name here is long</div>", "Hi\nShort."),
        ("<article><p><a href=x>Only a link</a></p></article><div><a href=1>b</a></div>", "Only a link"),
    ],
)
def test_density_finds_the_article(page, text):
    assert html_extract.article_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><div class='article-header'><h1>T</h1></div><p>a <span class='comment'># note</span> b</p><p class='share-price'>9</p><div class='legal'>L</div><p><math><mi>x</mi></math></p><p>{LONG}</p></article>", f"T\na # note b\n9\nL\nx\n{LONG}"),
        (f"<article><p>{LONG}</p><script>var x=1;", LONG),
        (f"<article><p>{LONG}</p><!-- x", LONG),
        (f"<p title='a > b'>{LONG}</p>", LONG),
        (f"<article><p>{LONG}</p><section id='comments'><p>{LONG} me</p></section><div role='complementary'>{LONG}</div><p style='display: none'>x</p><section id='discussion'>y</section></article>", f"{LONG}\ny"),
        (f"<p>{LONG} 1 < 2 and 3 > 2</p>", f"{LONG} 1 < 2 and 3 > 2"),
        (f"<article><div><div><p>{LONG}</div></div></div></div><p>x</article><p>out", f"{LONG}\nx"),
    ],
)
def test_markup_inside_articles(page, text):
    assert html_extract.article_text(page) == text


def test_pages_without_marks_give_the_same_text(data):
    import pyarrow.parquet as pq

    for r in pq.read_table(f"{data}/pages.parquet").to_pylist():
        assert html_extract.article_text(re.sub("</?article>", "", r["html"])) == html_extract.article_text(r["html"])


@pytest.mark.parametrize("part", ["<script>x", "<nav><p>x", "<a '", "<", "<div>", "<p>ab cd</p>", "<section></div></p>", "<!-- ", "&", "<a title=\"x' >", "<svg>", "<div class=ad><li>x"])
def test_reading_is_linear(part):
    began = time.process_time()
    html_extract.article_text(part * (500_000 // len(part)))
    assert time.process_time() - began < 3


# Language ID


def test_language_accuracy(spark, data):
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.op4_language_id(spark, data).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"] and len(truth[r["doc_id"]][1] or "") > 200]
    assert sum(r["lang_pred"] == truth[r["doc_id"]][0] for r in held) >= 0.95 * len(held)
    assert all(r["held_out"] == (fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in rows)


def test_short_texts(spark):
    """Held-out texts of at most 200 characters."""
    where = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{where}/documents.parquet").collect()}
    short = [r for r in queries.op4_language_id(spark, where).collect() if r["held_out"] and r["lang_pred"] != "und" and len(truth[r["doc_id"]][1] or "") <= 200]
    assert short and sum(r["lang_pred"] == truth[r["doc_id"]][0] for r in short) >= 0.9 * len(short)


def test_sizes_by_a_plain_loop(spark, data):
    import zstandard

    docs = spark.read.parquet(f"{data}/documents.parquet")
    content = langid.dictionaries(docs, F.lit(True))
    tools = {}
    for lang, c in content.items():
        tools[lang] = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in langid.predict(docs, content).collect():
        data = langid.letters(text[r["doc_id"]] or "")
        sizes = {lang: sum(len(t.compress(data[k : k + langid.CHUNK])) for k in range(0, len(data), langid.CHUNK)) for lang, t in tools.items()}
        assert r["lang_pred"] == (min(sorted(sizes), key=sizes.get) if data.strip() else "und")


def test_letters_keep_their_marks():
    assert langid.letters("हिन्दी में 7 Cafe\u0301 x_y") == " हिन्दी में café x y ".encode()
    assert langid.letters("\u0301 12") == b"  "


def test_dictionaries_know_the_bodies(spark):
    words = {"xx": "kala vesi talo", "yy": "brot wasser haus"}
    rows = [(k, lang, "copyright notice all rights reserved " * 60 + f"{words[lang]} " * 300) for k in range(400) for lang in words]
    content = langid.dictionaries(spark.createDataFrame(rows, "doc_id long, lang string, text string"), F.lit(True))
    assert all(part.encode() in content[lang] and b"rights reserved" in content[lang] for lang, said in words.items() for part in said.split())
    assert all(len(c) <= langid.DICTIONARY for c in content.values())
    judge = langid.Judge(content)
    assert all(judge(f"{said} " * 20)[0] == lang for lang, said in words.items())


def test_language_odd_rows(odd, none):
    content = langid.dictionaries(odd, F.lit(True))
    assert {"en", "de"} <= set(content)
    got = {r["doc_id"]: r for r in langid.predict(odd, content).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 and got[k]["rejected"] for k in (2, 3, 5))
    assert got[6]["lang_pred"] in content
    assert langid.predict(none, content).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, {}).collect()} == {"und"}


# Kneser-Ney


def brute_kneser_ney(texts):
    """Interpolated modified Kneser-Ney from its definition, over tokens <s> <s> words </s>."""
    tri = Counter()
    for t in texts:
        line = ["<s>", "<s>", *t.lower().split(), "</s>"]
        tri.update(zip(line, line[1:], line[2:], strict=False))
    bi, uni = Counter(), Counter()
    for a, b, c in tri:
        bi[b, c] += tri[a, b, c] if b == "<s>" else 1
    for b, c in bi:
        uni[c] += 1

    def discounts(counts):
        n = [max(1, sum(v == k for v in counts.values())) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n[1] / n[0]), (2, 2 - 3 * y * n[2] / n[1]), (3, 3 - 4 * y * n[3] / n[2]))]

    d3, d2, d1 = discounts(tri), discounts(bi), discounts(uni)
    cut = lambda d, n: d[min(n, 3) - 1]

    def level(counts, d, gram, lower):
        context = [(k, n) for k, n in counts.items() if k[:-1] == gram[:-1]]
        total = sum(n for _, n in context)
        if not total:
            return lower
        n = counts.get(gram, 0)
        return (n - cut(d, n) if n else 0) / total + sum(cut(d, m) for _, m in context) / total * lower

    total = sum(uni.values())
    base = sum(cut(d1, n) for n in uni.values()) / total / (len(uni) + 1)

    def log10(t):
        line, out = ["<s>", "<s>", *t.lower().split(), "</s>"], 0.0
        for a, b, c in zip(line, line[1:], line[2:], strict=False):
            one = (uni[c] - cut(d1, uni[c]) if c in uni else 0) / total + base
            out += math.log10(level(tri, d3, (a, b, c), level(bi, d2, (b, c), one)))
        return out

    return log10


@pytest.mark.parametrize("most", [kneser_ney.MODEL_ROWS, 0])
def test_perplexity_by_brute_force(spark, most):
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice(["a", "b", "C", "dd", "e"]) for _ in range(rng.randint(1, 12)))
    texts = [text() for _ in range(30)]
    model = kneser_ney.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    log10 = brute_kneser_ney(texts)
    rows = [(k, "x", t) for k, t in enumerate([*texts[:5], text(), "unseen words a b", "a"])]
    for r in kneser_ney.scored(spark.createDataFrame(rows, "doc_id long, lang string, text string"), model, most).collect():
        t = rows[r["doc_id"]][2]
        assert r["n_tokens"] == len(t.split())
        assert r["perplexity"] == pytest.approx(10 ** (-log10(t) / (r["n_tokens"] + 1)), rel=1e-4)


def test_classifier_tells_labels_apart(spark, data):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    kept = {r["doc_id"]: r["kept"] for r in queries.op2_kneser_ney(spark, data).collect()}
    good = [kept[d] for d, q in labels.items() if q == 1]
    bad = [kept[d] for d, q in labels.items() if q == 0]
    assert sum(good) >= 0.9 * len(good) and sum(bad) <= 0.4 * len(bad)


def test_classifier_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (6, 1, 0), (7, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in kneser_ney.classify(odd, labels).collect()}
    assert all(got[k]["perplexity"] is None and not got[k]["kept"] for k in (2, 3, 5))
    assert kneser_ney.classify(none, labels).count() == 0
    assert kneser_ney.classify(odd, labels.limit(0)).where("kept").count() == 6


def test_each_language_has_its_sample_and_quantile(spark):
    rng = random.Random(9)
    text = lambda letters: " ".join(rng.choice(letters) for _ in range(rng.randint(3, 12)))
    rows = [(k, "en", text("abcdef")) for k in range(400)] + [(k, "fi", text("uvwxyz")) for k in range(400, 430)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = docs.selectExpr("doc_id", "1 as quality", "0 as toxic")
    learnt = {r["good_id"] for r in kneser_ney.sample(docs, kneser_ney.trusted(labels), 30).collect()}
    assert Counter("en" if k < 400 else "fi" for k in learnt) == {"en": 15, "fi": 15}
    assert not any(fold(k, kneser_ney.HELD_BACK) == 0 for k in learnt)
    got = kneser_ney.classify(docs, labels, most=30).collect()
    for lang in ("en", "fi"):
        unseen = sorted(r["perplexity"] for r in got if r["lang"] == lang and r["doc_id"] not in learnt)
        want = unseen[math.ceil(kneser_ney.QUANTILE * len(unseen)) - 1]
        assert all(r["threshold"] == pytest.approx(want) for r in got if r["lang"] == lang)


def test_every_trusted_document_trains(spark):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, "en", " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))) for k in range(4200)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    labels = docs.where("doc_id < 4100").selectExpr("doc_id", "1 as quality", "0 as toxic")
    log10 = brute_kneser_ney([t for k, _, t in rows if k < 4100 and fold(k, kneser_ney.HELD_BACK) != 0])
    got = {r["doc_id"]: r["perplexity"] for r in kneser_ney.classify(docs, labels).collect()}
    for k, _, t in rows[4000:]:
        assert got[k] == pytest.approx(10 ** (-log10(t) / (len(t.split()) + 1)), rel=1e-4)


def test_buckets_and_turns_leave_perplexities_alone(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    one = kneser_ney.fit(docs.select("text"))
    want = sorted(kneser_ney.scored(docs, one).collect())
    monkeypatch.setattr(kneser_ney, "BUCKET_BYTES", 30_000)
    monkeypatch.setattr(kneser_ney, "SLICE_BYTES", 60_000)
    many = kneser_ney.fit(docs.select("text"))
    assert many.buckets > 4 and (many.rows, many.total) == (one.rows, one.total)
    for a, b in zip(want, sorted(kneser_ney.scored(docs, many, 0).collect()), strict=True):
        assert a[:3] == b[:3] and (a[3] is None) == (b[3] is None)
        assert a[3] is None or a[3] == pytest.approx(b[3], rel=1e-4)


def test_parts_of_bigrams_go_turn_by_turn(spark, data, monkeypatch):
    """Training texts and parts that are summed hold no disk while the rest is counted."""
    monkeypatch.setattr(kneser_ney, "BUCKET_BYTES", 30_000)
    monkeypatch.setattr(kneser_ney, "SLICE_BYTES", 60_000)
    mark, left = len(scratch._scratch), []

    def look(_):
        files = [f for _, path in scratch._scratch[mark:] for f in Path(path.removeprefix("file://")).rglob("*.parquet")]
        left.append(sum(f.stat().st_size for f in files if f.parent.name not in ("kind=0", "kind=3", "kind=4", "kind=5")))

    monkeypatch.setattr(kneser_ney, "_forget_shuffles", look)
    kneser_ney.fit(spark.read.parquet(f"{data}/documents.parquet").select("text"))
    assert left[-1] == 0 and all(a > b for a, b in zip(left[-4:], left[-3:], strict=False))


def test_portions_ask_for_all_their_ngrams():
    texts = [b"", b"a b a b c", b"Zz", b"", b"a b", b" "]
    shingler = ngram_join.Shingler()
    word, n = kneser_ney._words(texts, shingler)
    names, place = np.unique(word, return_inverse=True)
    got = kneser_ney._decoded(len(texts), kneser_ney._pack("p", np.concatenate([n, place])), kneser_ney._pack("d", names))
    owner, a, b, c = kneser_ney._tokens(texts, shingler)
    bi = set(got.asked()[1].tolist())
    assert got.owner.tolist() == owner.tolist() and got.tri.tolist() == kneser_ney._key3(a, b, c).tolist()
    assert got.bi.tolist() == kneser_ney._key2(b, c).tolist() and bi >= set(kneser_ney._key2(a, b).tolist())
    assert got.every[got.before].tolist() == b.tolist() and got.every[got.word].tolist() == c.tolist()
    for keys in (got.tri, got.bi[:0], got.bi[:1]):
        assert kneser_ney._distinct(keys).tolist() == np.unique(keys).tolist()


# Recurrent scoring


def test_no_function_of_the_network_is_defined_twice():
    """A later definition would silently replace an earlier one, as a slower softmax once did."""
    tree = ast.parse(Path(gru_lm.__file__).read_text())
    names = Counter(f.name for f in tree.body if isinstance(f, ast.FunctionDef))
    assert [n for n, k in names.items() if k > 1] == []


@pytest.mark.parametrize("shift", [0, 500, -500])
def test_softmax_keeps_its_range(shift):
    x = np.random.default_rng(4).standard_normal((50, 9)).astype(np.float32) * 5
    want = np.exp(x.astype(np.float64))
    assert gru_lm._softmax(x + np.float32(shift)) == pytest.approx(want / want.sum(axis=1, keepdims=True), abs=1e-4)



def test_scores_equal_step_by_step():
    rng = np.random.default_rng(0)
    docs = [np.append(rng.integers(0, gru_lm.REST + 1, rng.integers(0, 60)), 0) for _ in range(15)]
    w = gru_lm.start_weights(np.bincount(np.concatenate(docs), minlength=80)[: gru_lm.VOCABULARY].astype(float), 3.0)
    for d, got in zip(docs, gru_lm.document_scores(w, docs), strict=True):
        h, before, want = np.zeros((1, gru_lm.HIDDEN), dtype=np.float32), gru_lm.BEGIN, 0.0
        for t in d:
            h = gru_lm._step(w, (w["wx"][before] + w["bx"])[None], h)[0]
            want += gru_lm.log_probabilities(w, h, np.array([t]))[0]
            before = t
        assert got == pytest.approx(want, rel=1e-5)


def test_probabilities_sum_to_one():
    w = gru_lm.start_weights(np.ones(gru_lm.VOCABULARY), 10.0)
    h = np.random.default_rng(1).standard_normal((1, gru_lm.HIDDEN)).astype(np.float32)
    every = np.arange(gru_lm.REST + 1)
    assert np.exp(gru_lm.log_probabilities(w, np.repeat(h, len(every), 0), every)).sum() == pytest.approx(1, abs=1e-3)


def test_training_gradients():
    """One step of training follows the numerical gradient of the loss."""
    rng = np.random.default_rng(2)
    docs = [np.append(rng.integers(0, 30, 12), 0)]
    w = gru_lm.start_weights(np.ones(40), 1.0)
    before = {k: v.copy() for k, v in w.items()}
    gru_lm.train(w, docs)
    lower = gru_lm.document_scores(w, docs)[0]
    assert lower > gru_lm.document_scores(before, docs)[0]


def test_recurrent_model_learns():
    rng = np.random.default_rng(3)

    def chain():
        x = [1]
        for _ in range(150):
            x.append((x[-1] * 3 + int(rng.random() < 0.2)) % 40 + 1)
        return np.append(x, 0)

    docs = [chain() for _ in range(120)]
    w = gru_lm.start_weights(np.bincount(np.concatenate(docs), minlength=50).astype(float), 0.0)
    before = gru_lm.document_scores(w, docs[:20]).sum()
    gru_lm.train(w, docs)
    assert gru_lm.document_scores(w, docs[:20]).sum() > 0.5 * before


def test_every_training_document_is_trained_on(spark):
    rows = [(k, "a b " * (k % 7 + 1), False) for k in range(200)] + [(None, "a b c", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    coded = gru_lm.encode(docs, [b"a", b"b"], np.array([1, 2]), np.array([9, 5, 5]), {}, 1.0, np.zeros(gru_lm.ENDINGS))
    _, seen = gru_lm.fit(coded, 2000, gru_lm.start_weights(np.ones(4), np.ones(gru_lm.ENDINGS)))
    assert seen == sum(len(t.split()) + 1 for _, t, _ in rows)


def test_scores_are_those_of_one_machine(spark, data):
    """With one shard, the query's scores are those of plain loops over the same documents in the same order."""
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    held = {d for d, _ in rows if fold(d, 5) == 1}
    tokens = {d: gru_lm.words_of(t) for d, t in rows}
    counts = Counter(w for d, _ in rows if d not in held for w in tokens[d])
    ends = sum(d not in held for d, _ in rows)
    names = sorted(counts, key=lambda w: (-counts[w], w))
    listed, tail = names[: gru_lm.VOCABULARY - 1], names[gru_lm.VOCABULARY - 1 :]
    by_ending = Counter()
    for w in tail:
        by_ending[w.decode()[-2:]] += counts[w]
    chosen = sorted(by_ending, key=lambda e: (-by_ending[e], e))[: gru_lm.ENDINGS - 1]
    code = {w: k for k, w in enumerate(listed, 1)}
    kind = lambda w: gru_lm.VOCABULARY + (chosen.index(w.decode()[-2:]) if w.decode()[-2:] in chosen else gru_lm.ENDINGS - 1)
    total, kinds = np.zeros(gru_lm.ENDINGS), np.zeros(gru_lm.ENDINGS)
    for w in tail:
        total[kind(w) - gru_lm.VOCABULARY] += counts[w]
        kinds[kind(w) - gru_lm.VOCABULARY] += 1
    number = lambda d: np.array([code[w] if w in code else kind(w) for w in tokens[d]] + [0])
    w = gru_lm.start_weights(np.array([ends] + [counts[x] for x in listed]), total)
    learn = [(d, t) for d, t in rows if d not in held]  # one file, so one shard
    turn = {r["doc_id"]: r["t"] for r in spark.createDataFrame([(d,) for d, _ in learn], "doc_id long").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(gru_lm.ROUNDS)).alias("t")).collect()}
    for k in range(gru_lm.ROUNDS):
        gru_lm.train(w, [number(d) for d, _ in learn if turn[d] == k])
    got = {r["doc_id"]: r["score"] for r in gru_lm.score(spark.read.parquet(f"{data}/documents.parquet"), langid.fold(F.col("doc_id"), 5) == 1).collect()}
    for d, _ in rows:
        logp = gru_lm.document_scores(w, [number(d)])[0] / math.log(10)
        logp += sum(math.log10((counts[x] + 0.5) / (total[kind(x) - gru_lm.VOCABULARY] + 0.5 * (kinds[kind(x) - gru_lm.VOCABULARY] + 1))) for x in tokens[d] if x not in code)
        assert got[d] == pytest.approx(logp, rel=1e-3)


def test_held_out_texts_score_above_the_base(spark, data):
    got = gru_lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), langid.fold(F.col("doc_id"), 5) == 1)
    r = got.where("held_out").agg((F.sum("score") / F.sum("n_tokens")).alias("score"), (F.sum("base_score") / F.sum("n_tokens")).alias("base")).first()
    assert r["score"] > r["base"] + 0.2


def test_base_scores_by_brute_force(spark, odd, none):
    rows = odd.select("doc_id", "text").collect()
    held = lambda d: fold(d, 5) == 1
    tokens = lambda t: [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in words(t)] + [None]
    counts = Counter(w for r in rows if not held(r["doc_id"]) for w in tokens(r["text"]))
    n, v = sum(counts.values()), len(counts)
    got = gru_lm.score(odd, langid.fold(F.col("doc_id"), 5) == 1).collect()
    want = sorted((r["doc_id"], held(r["doc_id"]), len(tokens(r["text"])), sum(counts[w] > 0 for w in tokens(r["text"])), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(r["text"])), 4)) for r in rows)
    assert sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] <= 0 for r in got)
    assert gru_lm.score(none, F.lit(False)).count() == 0
