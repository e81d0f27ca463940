"""SimHash, sharding, quality, Brown LM, token output, HTML and the pipeline against brute force, round trips and held-out accuracy."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quire.llm import brown, html_text, quality, sharding, simhash, simple8b, tokens, wordcache

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp bigint, row string, shard int, id int"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def docs_table(spark, rows):
    """rows of (doc_id, text); the further columns carry names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "r", 2, 3) for i, t in rows], DOC)


def corpus(n=150, seed=5, length=40):
    r = random.Random(seed)
    vocab = ["The", "of", "über", "É", "data", "row", "42", "été", "Zoë"] + [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(1, length)))) for i in range(n)]
    for i in range(n, n + n // 3):  # near and exact copies
        words = rows[r.randrange(n // 4)][1].split(" ")
        if i % 2:
            words[r.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    return rows


ODD = [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "one two"), (905, "One TWO"), (906, "ÉTÉ été"), (None, "one two"), (None, None), (907, "dup"), (907, "dup"), (907, "other text here now"),
       (908, "long " * 40_000)]


# ---------------------------------------------------------------- op 2


def fingerprint_by_hand(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(fps, bits=3):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    fps = sorted(set(fps))
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                root[find(b)] = find(a)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("bucket_rows", [1024, 2])
def test_near_duplicates_against_all_pairs(spark, bucket_rows):
    rows = corpus() + ODD
    fps = [fingerprint_by_hand(t) for _, t in rows]
    root = components_by_hand(fps)
    first = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            first[root[f]] = min(first.get(root[f], i), i)
    want = sorted(((i, f"{f:016x}", first.get(root[f])) for (i, _), f in zip(rows, fps, strict=True)), key=str)
    got = simhash.near_duplicates(docs_table(spark, rows), bucket_rows=bucket_rows).collect()
    assert sorted(map(tuple, got), key=str) == want


@pytest.mark.parametrize("bucket_rows", [1024, 3])
def test_links_find_every_pair_within_three_bits(spark, bucket_rows):
    r = random.Random(8)
    fps = set()
    for _ in range(30):
        base = r.getrandbits(64)
        fps.add(base)
        for _ in range(12):
            x = base
            for b in r.sample(range(64), r.randint(1, 5)):
                x ^= 1 << b
            fps.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), bucket_rows=bucket_rows).collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(1, 60)] + [(100, 101), (101, 102), (100, 100)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 102: 100}


def test_keep_one_and_empty(spark):
    rows = corpus(60) + ODD
    docs = docs_table(spark, rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    fps = [fingerprint_by_hand(t) for _, t in rows]
    root = components_by_hand(fps)
    want = {}
    for (i, _), f in zip(rows, fps, strict=True):
        want[root[f]] = min(want.get(root[f], math.inf), math.inf if i is None else i)
    got = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(got) == sorted(want.values())
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- op 4


def test_shards(spark):
    rows = corpus(200) + ODD
    docs = docs_table(spark, rows)
    table = sharding.shard(docs, bucket_bytes=2_000)
    back = table.select("row.*")
    key = lambda r: str(tuple(r))
    assert sorted(map(key, back.collect())) == sorted(map(key, docs.collect()))
    got = sharding.shard_report(docs, bucket_bytes=2_000).collect()
    shards = {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert set(shards) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    want = Counter((i, len((t or "").encode()) + 16, None if t is None else zlib.crc32(t.encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard_report(docs, bucket_bytes=2_000).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in got}
    assert sharding.shard_report(docs.limit(0)).count() == 0


def test_shards_mix_the_order(spark):
    docs = docs_table(spark, [(i, "x") for i in range(4_000)])
    got = sharding.shard_report(docs).toPandas()
    mean = got.groupby("shard")["doc_id"].mean()
    assert (abs(mean - 2_000) < 600).all()  # 100 of 4,000 uniform draws: six standard errors are 690


# ---------------------------------------------------------------- op 5


def labelled(n=400, seed=2):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = r.random() < 0.3
        words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(r.randint(5, 300))]
        if bad:  # junk in one part of the text only
            at = r.randrange(len(words))
            words[at:at + 60] = [w + r.choice(["***", "$$$", "%%%"]) for w in words[at:at + 60]]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_quality_held_out_accuracy(spark):
    rows, labels = labelled()
    rows += ODD
    docs = docs_table(spark, rows)
    model = quality.train(docs, spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0), (77_777, 0, 0)], "doc_id bigint, quality int, toxic int"))
    got = quality.quality_scores(docs, model).collect()
    assert len(got) == len(rows)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if r["predicted"])


def test_quality_gradients():
    rng = np.random.default_rng(0)
    bags = [quality.passages(("ab, " * k).encode()) for k in (3, 200, 400)]
    model = quality.Model(np.vstack(bags).mean(axis=0), np.ones(quality.FEATURES), rng)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, starts, y, w = np.vstack(bags), np.cumsum([0, *[len(b) for b in bags[:-1]]]), np.array([0.0, 1.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        z = model.forward(x, starts)[0]
        return float(np.mean(w * (np.logaddexp(0, z) - y * z)))

    for name, grad in model.gradients(x, starts, y, w).items():
        at = np.unravel_index(np.argmax(abs(grad)), grad.shape)
        before = model.p[name][at]
        model.p[name][at] = before + 1e-5
        up = loss()
        model.p[name][at] = before - 1e-5
        down = loss()
        model.p[name][at] = before
        assert abs((up - down) / 2e-5 - grad[at]) < 1e-5


def test_quality_constants_and_empty(spark):
    docs = docs_table(spark, [(1, "a"), (2, "b")])
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [r["score"] for r in quality.quality_scores(docs, quality.train(docs, none)).collect()] == [1.0, 1.0]
    zero = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "doc_id bigint, quality int")
    assert quality.keep_good(docs, quality.train(docs, zero)).count() == 0
    rows, labels = labelled(60)
    model = quality.train(docs_table(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert quality.quality_scores(docs.limit(0), model).count() == 0 and quality.keep_good(docs.limit(0), model).count() == 0


# ---------------------------------------------------------------- op 6


def lm_by_hand(rows, of, words, classes):
    """Scores from the seeds' classes, everything else counted and placed anew, word by word."""
    toks = lambda t: (t or "").encode().lower().split()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    train = [t for i, t in rows if not held(i)]
    counts = Counter(w for t in train for w in toks(t))
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    seed = dict(zip(words, of, strict=False))
    other, end, width = classes, classes + 1, classes + 2
    pair, left, right = Counter(), {}, {}
    for t in train:
        ws = toks(t)
        cls = [end, *[seed.get(w, other) for w in ws], end]
        pair.update(zip(cls, cls[1:], strict=False))
        for i, w in enumerate(ws):
            if w not in seed:
                left.setdefault(w, Counter())[cls[i]] += 1
                right.setdefault(w, Counter())[cls[i + 2]] += 1
    cell = lambda x, y: pair[x, y] + 0.1
    rowsum = [sum(cell(x, y) for y in range(width)) for x in range(width)]
    colsum = [sum(cell(x, y) for x in range(width)) for y in range(width)]
    cls_of = dict(seed)
    for w in left:
        gain = [round(sum(c * math.log(cell(x, k) / colsum[k]) for x, c in left[w].items()) + sum(c * math.log(cell(k, y) / rowsum[k]) for y, c in right[w].items()), 6)
                for k in range(classes)]
        cls_of[w] = gain.index(max(gain))
    assert set(cls_of) == set(counts)
    once = Counter(cls_of[w] for w, c in counts.items() if c == 1)
    unseen = min(range(classes), key=lambda k: (-once[k], k))
    within = Counter()
    for w, c in counts.items():
        within[cls_of[w]] += c + 0.1
    within[unseen] += 0.1
    pair, after = Counter(), Counter()
    path = lambda ws: [classes, *[cls_of.get(w, unseen) for w in ws], classes]
    for t in train:
        p = path(toks(t))
        pair.update(zip(p, p[1:], strict=False))
        after.update(p[:-1])
    out = []
    for i, t in rows:
        ws, base, score = toks(t), 0.0, 0.0
        for w in [*ws, None]:
            c = len(train) if w is None else counts[w]
            base += math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
        p = path(ws)
        for x, y in zip(p, p[1:], strict=False):
            score += math.log10((pair[x, y] + 0.1) / (after[x] + 0.1 * (classes + 1)))
        for w in ws:
            score += math.log10((counts[w] + 0.1) / within[cls_of.get(w, unseen)])
        out.append((i, held(i), len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, n, round(base, 6), round(score, 6)))
    return sorted(out, key=str), cls_of


@pytest.mark.parametrize("lookup", [40, 200_000])
def test_brown_scores(spark, monkeypatch, lookup):
    rows = corpus(120, length=30) + ODD + [(909, "x" * 100 + " of data"), (910, "seen once " + "y" * 100)]
    monkeypatch.setattr(brown, "LOOKUP", lookup)
    monkeypatch.setattr(brown, "WORDS", 20)
    monkeypatch.setattr(brown, "HELD_TOKENS", 100)
    found = {}
    exchange = brown.exchange
    monkeypatch.setattr(brown, "exchange", lambda b, c, kept: found.setdefault("of", exchange(b, c, kept=kept)))
    bigrams = brown.unit_bigrams
    monkeypatch.setattr(brown, "unit_bigrams", lambda t, w: bigrams(t, found.setdefault("words", w)))
    classes_of = brown.classes_of
    monkeypatch.setattr(brown, "classes_of", lambda *a: found.setdefault("classes", classes_of(*a)))
    got = brown.scores(docs_table(spark, rows), classes=6).collect()
    counts = Counter(w for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10 for w in (t or "").encode().lower().split())
    assert found["words"] == [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:len(found["words"])]] and len(found["words"]) > 5
    want, cls_of = lm_by_hand(rows, found["of"].tolist(), found["words"], 6)
    assert {bytes(r["word"]): (r["c"], r["cls"]) for r in found["classes"].collect()} == {w: (c, cls_of[w]) for w, c in counts.items()}
    mine = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got), key=str)
    assert len(mine) == len(want)
    for a, b in zip(mine, want, strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-4 and abs(a[6] - b[6]) < 1e-4


def test_brown_clusters_words_of_equal_count_whatever_the_lookup_holds(spark, monkeypatch):
    r = random.Random(6)
    texts = [" ".join(r.sample([f"w{i}" for i in range(60)], 60)) for _ in range(12)]  # all words equally often
    docs = docs_table(spark, enumerate(texts, 1))
    monkeypatch.setattr(brown, "WORDS", 20)
    seen = []
    bigrams = brown.unit_bigrams
    monkeypatch.setattr(brown, "unit_bigrams", lambda t, w: bigrams(t, seen.append(w) or w))
    want = sorted((r["doc_id"], round(r["score"], 6)) for r in brown.scores(docs, classes=6).collect())
    monkeypatch.setattr(brown, "LOOKUP", 40)
    assert sorted((r["doc_id"], round(r["score"], 6)) for r in brown.scores(docs, classes=6).collect()) == want
    assert seen[0] == seen[1] == sorted(f"w{i}".encode() for i in range(60))[:20]


def test_brown_places_words_by_their_neighbours(spark, monkeypatch):
    """Words outside the seeds join the class whose neighbours they share, whatever their letters."""
    r = random.Random(9)
    texts = []
    for _ in range(400):
        kind = r.randrange(2)
        rare = f"{'ab'[kind]}{r.randrange(40)}{r.choice(['tion', 'ing'])}"
        ws = ["el", r.choice(["perro", "gato"]), "corre"] if kind else ["muy", r.choice(["bien", "mal"]), "hecho"]
        texts.append(" ".join([*ws, ws[0], rare, ws[2]]))
    monkeypatch.setattr(brown, "WORDS", 8)
    found = {}
    classes_of = brown.classes_of
    monkeypatch.setattr(brown, "classes_of", lambda *a: found.setdefault("classes", classes_of(*a)))
    brown.scores(docs_table(spark, enumerate(texts, 1)), classes=6)
    cls = {bytes(r["word"]).decode(): r["cls"] for r in found["classes"].collect()}
    for kind, seeds in (("a", {"bien", "mal"}), ("b", {"perro", "gato"})):
        placed = Counter(k for w, k in cls.items() if w[0] == kind and w not in seeds and w[1].isdigit())
        assert len(placed) == 1 and set(placed) <= {cls[w] for w in seeds}  # the two seeds themselves may be in two classes


def test_exchange_finds_alternating_classes():
    rng = np.random.default_rng(4)
    n = 24
    kinds = np.arange(n) % 3
    big = np.zeros((n + 1, n + 1))
    for _ in range(20_000):
        a = rng.integers(n)
        b = rng.choice(np.flatnonzero(kinds == (kinds[a] + 1) % 3))
        big[a, b] += 1
    shuffled = rng.permutation(n)
    big[:n, :n] = big[:n, :n][np.ix_(shuffled, shuffled)]
    of = brown.exchange(big, 3)
    for k in range(3):
        assert len({of[i] for i in range(n) if kinds[shuffled[i]] == k}) == 1


def test_brown_held_out_beats_base(spark, sf):
    got = brown.scores(spark.read.parquet(f"{sf}/documents.parquet")).filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert got[1] > got[0]


def test_brown_without_training_texts(spark):
    got = brown.scores(docs_table(spark, [(1, "a b"), (2, None)]), train=F.lit(False)).collect()
    assert all(math.isfinite(r["score"]) and r["train_tokens"] == 0 and r["n_known"] == 0 for r in got)
    assert brown.scores(docs_table(spark, []).limit(0)).count() == 0


# ---------------------------------------------------------------- op 7


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 300), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=400))
def test_simple8b_round_trip(ids):
    a = np.array(ids, np.uint64)
    words, escapes = simple8b.encode(a)
    assert (simple8b.decode(words, escapes, len(a)) == a).all()
    assert len(words) <= len(a)


def test_simple8b_packs_small_ids():
    assert len(simple8b.encode(np.ones(600, np.uint64))[0]) == 10
    assert len(simple8b.encode(np.full(300, 50_000, np.uint64))[0]) == 100


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB é'ß,.\n\t  　\xa0\x1c12漢<|>_$"), max_size=30), min_size=1, max_size=6))
def test_word_encoder_equals_tokenizer(texts):
    import pyarrow as pa

    encoder = wordcache.word_encoder(PATH)
    assert encoder.by_word
    texts = [*texts, "x<|endoftext|> y", "don't 'S they're"]
    assert [x.tolist() for x in encoder.encode(pa.array(texts))] == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_token_files(spark):
    rows = corpus(150) + ODD
    blocks = tokens.write_tokens(docs_table(spark, rows), PATH, block_ids=500)
    assert blocks.count() > 5
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokens.token_report(blocks).collect())
    assert [r[1] for r in got] == sorted([i for i, _ in rows], key=lambda i: -1 if i is None else i)
    t = Tokenizer.from_file(PATH)
    want = Counter()
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter(r[1:] for r in got) == want
    start = 0
    for r in got:
        assert r[0] == start
        start += r[2]
    empty = tokens.write_tokens(docs_table(spark, rows).limit(0), PATH)
    assert tokens.token_report(empty).count() == 0


# ---------------------------------------------------------------- op 9


PAGES = [
    ("<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><article><h1>Title &amp; more</h1><p>The first\n  paragraph of the article is long enough to be decided by its words.</p>"
     "<p>Short.</p></article><footer>&copy; x</footer></body></html>", "Title & more\n\nThe first paragraph of the article is long enough to be decided by its words.\n\nShort."),
    (None, ""), ("", ""), ("   ", ""), ("<p>", ""), ("<!-- never closed <p>x</p>", ""), ("<script>var a = '<p>x</p>'", ""),
    ("<article><p class='cookie notice'>We use cookies</p><p>Text of it.</p><div id=comments><p>Reader says</p></div></article>", "Text of it."),
    ("<article><p><b>Bold<br><p>Next one</article><aside>side</aside>", "Bold\n\nNext one"),
    ("<main><header><h1>Head</h1></header><p>Body&nbsp;text &lt;ok&gt; &#233;</p><form><p>Name</p><input></form></main>", "Head\n\nBody text <ok> é"),
    ("<div class='ad'>Buy</div><div><p>Plain text here.</p></div>", "Plain text here."),
    ("<article>a<ul><li>one</li><li>two <a href=y>b</a> and more words</li></ul><br>c<br><br>d</article>", "a\n\none\n\ntwo b and more words\n\nc\n\nd"),
    ("<article><p>x</p><div hidden>no</div><div role=complementary>no</div><div data-x=hidden>yes</div></article>", "x\n\nyes"),
]


def test_html_blocks(spark):
    pages = spark.createDataFrame([(i, f"u{i}", h, "t") for i, (h, _) in enumerate(PAGES)] + [(None, None, PAGES[0][0], "t"), (0, "u0", PAGES[0][0], "t")], "page_id bigint, url string, html string, text string")
    got = html_text.main_text(pages).collect()
    assert len(got) == len(PAGES) + 2
    by = {r["page_id"]: r for r in got}
    for i, (_, want) in enumerate(PAGES):
        assert by[i]["text"] == want, PAGES[i]
        assert by[i]["n_chars"] == len(want) and by[i]["url"] == f"u{i}"
    assert by[None]["text"] == PAGES[0][1]
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_html_second_pass():
    labels = [True, None, None, False, None]
    assert html_text._inherit(labels, [0, 0, 0, 0, 0], ["page"] * 5) == [True, True, False, False, False]
    assert html_text._inherit([False, None, True], [0, 0, 0], ["page"] * 3) == [False, True, True]
    assert html_text._inherit([False, None], [0, 1], ["bad", "main"]) == [False, True]
    links = "<div><p>" + "".join(f"<a href=#>link {i}</a> " for i in range(9)) + "</p><p>tiny</p></div><div><p>" + "The text of the page is here and it goes on for a while, as texts do. " * 3 + "</p><p>end</p></div>"
    assert html_text.extract(links).endswith("end") and "link" not in html_text.extract(links)


def test_html_long_broken_page():
    page = "<article>" + "<p>word <b>" * 20_000 + '<a href="x' + "y" * 100_000
    assert html_text.extract(page).count("word") == 20_000


def test_html_articles_of_the_test_pages(sf):
    """The test pages' articles hold h1 and p only."""
    import re
    from html import unescape

    for r in pd.read_parquet(f"{sf}/pages.parquet").itertuples():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert html_text.extract(r.html) == "\n\n".join(p for p in parts if p)


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {"all": docs.toPandas()}
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, at, sf), "test-stage")
        kept[name] = out.toPandas()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        at = out
    good, distinct, clean, mix, ids = (kept[n] for n, _ in corpus_pipeline.STAGES)
    labels = pd.read_parquet(f"{sf}/labels.parquet").set_index("doc_id")["quality"]
    assert (labels.reindex(good["doc_id"]).dropna() == 1).mean() > 0.95
    assert len(set(labels.index[labels == 1]) - set(good["doc_id"])) <= 0.03 * (labels == 1).sum()
    fps = {i: fingerprint_by_hand(t) for i, t in zip(good["doc_id"], good["text"], strict=True)}
    root = components_by_hand(list(fps.values()))
    first = {}
    for i, f in fps.items():
        first[root[f]] = min(first.get(root[f], i), i)
    assert sorted(distinct["doc_id"]) == sorted(first.values())
    items = pd.read_parquet(f"{sf}/benchmark.parquet")
    from test_filters import contamination_by_hand

    hit = {r[0]: r[-1] for r in contamination_by_hand(list(zip(distinct["doc_id"], distinct["text"], strict=True)), list(zip(items["item_id"], items["text"], strict=True)), 10)}
    assert sorted(clean["doc_id"]) == sorted(i for i, h in hit.items() if not h)
    assert set(mix["doc_id"]) <= set(clean["doc_id"]) and mix["doc_id"].value_counts().max() <= 2
    assert sorted(ids["doc_id"]) == sorted(mix["doc_id"])
    assert corpus_pipeline.run(spark, sf).count() == len(ids)


def test_pipeline_of_an_empty_table(spark, sf):
    at = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        at = corpus_pipeline.written(stage(spark, at, sf), "test-empty")
    assert at.count() == 0


def test_training_takes_whole_documents_within_its_bound(spark, monkeypatch):
    """Documents are learnt from with all their passages; those that would pass the bound are left out."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda bags, *a: seen.append(sorted(len(b) for b in bags)))
    rows = [(i, "x" * (quality.PASSAGE * (1 + i % 5))) for i in range(60)] + [(1000, "y" * (quality.PASSAGE * 500))]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, *_ in rows], "doc_id bigint, quality int, toxic int")
    use = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    quality.train(docs_table(spark, rows), labels)
    assert seen[-1] == sorted(-(-len(t) // quality.PASSAGE) for i, t in rows if i in use)
    quality.train(docs_table(spark, rows), labels, train_passages=40)
    assert 30 <= sum(seen[-1]) <= 40 and set(seen[-1]) <= {1, 2, 3, 4, 5}
