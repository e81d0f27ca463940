"""URL filter, decontamination, mixing and I-Match fingerprints against brute force on small tables."""

import hashlib
import random
import re

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from quire.llm import decontaminate, imatch, mixing, urls

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, hit int, w string, bucket int, score double"
LOWER = {i: i + 32 for i in range(65, 91)}


def docs_table(spark, rows):
    """rows of (doc_id, text, source); the further columns carry names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "x", 2, 0.5) for i, t, s in rows], DOC)


def sample_rows(n=120, seed=3):
    r = random.Random(seed)
    vocab = ["The", "of", "über", "É", "a1", "x-y", "don't", "data", "row", "42", "été", "Zoë"]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(0, 60))) + r.choice(["", ".", "\n", " \t"]), r.choice(["s1", "s2", "ä", None, "S1"])) for i in range(n)]
    return rows + [(n, None, "s1"), (n + 1, "", None), (None, "The data", "s2"), (None, None, "s2"), (5, "The data", "s2"), (5, "The data", "s2"),
                   (n + 2, "word " * 30_000, "s2")]


# ---------------------------------------------------------------- op 1


def rule_by_hand(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    host = host.translate(LOWER)
    fits = [r for _, r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
    return host, path, max(fits, key=len, default=None)


URLS = ["http://A.net/", "http://a.net", "http://net/x", "https://x.example.net/en/1", "https://example.net/en", "http://example.com/de/?q", "http://m.org/fr/a?b=1&c=2#t",
        "http://m.org/FR/a", "no scheme", "", None, "://", "http://", "a://b://c.net/d", "http://notnet/", "http://x.casino-win.example.com/en/1", "http://x.org?u=/fr/",
        "http://x.example.com#/de/", "http://h/" + "a" * 50_000, "http://A.net/"]


def test_rules_host_and_path(spark):
    pages = spark.createDataFrame([(i, u, "h", 1.0) for i, u in enumerate(URLS)], "page_id bigint, url string, host string, score double")
    got = {r["page_id"]: r for r in urls.judge(pages).collect()}
    assert len(got) == len(URLS)
    verdicts = {r: v for v, r in urls.RULES}
    for i, u in enumerate(URLS):
        host, path, rule = rule_by_hand(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == verdicts[rule] if rule else got[i]["verdict"] in ("allow", "block")
        assert 0 <= got[i]["score"] <= 1


def test_trees_learn_from_labelled_urls(spark):
    r = random.Random(1)
    rows = []
    for i in range(1200):
        bad = i % 4 == 0
        host = ("win-%d-bonus.example.com" if bad else "news%d.example.com") % r.randint(0, 40)
        rows.append((i, f"https://{host}/en/{r.randint(1, 999)}" + ("?a=1&b=2&c=3" if bad and i % 8 else ""), int(bad)))
    labelled = spark.createDataFrame(rows, "page_id bigint, url string, label int")
    got = urls.judge(labelled, labelled=labelled.filter("page_id % 3 > 0").select("url", "label"), rules=(), trees=5).join(labelled.select("page_id", "label"), "page_id")
    held = got.filter("page_id % 3 = 0").select(F.avg(((F.col("verdict") == "block").cast("int") == F.col("label")).cast("int")).alias("a")).first()["a"]
    assert held > 0.95


class ShowSuffixes:
    """Stands for the trees: the probability shows the suffix statistics."""

    def __init__(self, stages):
        pass

    def fit(self, sample):
        return self

    def transform(self, df):
        shown = F.col("suffix1") + 10 * F.col("suffix2") + 100 * F.col("suffix3")
        return df.withColumn("probability", array_to_vector(F.array(F.lit(0.0), shown)))


@pytest.mark.parametrize("broadcast_bytes", [8 << 20, 0])
def test_suffix_statistics_of_many_hosts_are_exact(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(urls, "Pipeline", ShowSuffixes)
    monkeypatch.setattr(urls, "BROADCAST_BYTES", broadcast_bytes, raising=False)
    hosts = [f"h{i}.d{i % 3001}.t{i % 7}" for i in range(12_000)] + ["hot.d0.t0"] * 500
    rows = [(i, f"http://{h}/", int(i % 3 == 0)) for i, h in enumerate(hosts)]
    pages = spark.createDataFrame([*rows, (-1, "http://new.d1.t1/", None), (-2, None, None)], "page_id bigint, url string, label int")
    got = {r["page_id"]: r["score"] for r in urls.judge(pages, labelled=pages.select("url", "label"), rules=()).collect()}
    count = {}
    for h, (_, _, label) in zip(hosts, rows, strict=True):
        for k in urls.LEVELS:
            n, s = count.get((k, ".".join(h.split(".")[-k:])), (0, 0))
            count[k, ".".join(h.split(".")[-k:])] = n + 1, s + label
    prior = sum(r[2] for r in rows) / len(rows)
    assert len(got) == len(rows) + 2
    for i, h in [*enumerate(hosts), (-1, "new.d1.t1"), (-2, "")]:
        seen = [count.get((k, ".".join(h.split(".")[-k:])), (0, 0)) for k in urls.LEVELS]
        assert abs(got[i] - sum(w * (s + prior * urls.SMOOTHING) / (n + urls.SMOOTHING) for w, (n, s) in zip((1, 10, 100), seen, strict=True))) < 1e-9


def test_url_constant_models_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://x.org/")], "page_id bigint, url string")
    assert urls.judge(pages, labelled=pages.select("url", F.lit(1).alias("label"))).first()["verdict"] == "block"
    assert urls.judge(pages, labelled=pages.select("url", F.lit(None).cast("int").alias("label"))).first()["verdict"] == "allow"
    assert urls.judge(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- op 3


def words_by_hand(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if w]


def contamination_by_hand(rows, items, n):
    wins = {}
    for item, text in items:
        w = words_by_hand(text)
        for p in range(max(1, len(w) - n + 1)):
            if w:
                wins.setdefault(tuple(w[p:p + n]), set()).add("" if item is None else str(item))
    out = []
    for i, text, *_ in rows:
        w, hit, found = words_by_hand(text), set(), set()
        for size in {len(x) for x in wins}:
            for p in range(len(w) - size + 1):
                if tuple(w[p:p + size]) in wins:
                    hit.update(range(p, p + size))
                    found |= wins[tuple(w[p:p + size])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [64 << 20, 0])
@pytest.mark.parametrize("n", [2, 3])
def test_contamination(spark, n, limit):
    rows = sample_rows(60)
    items = [(1, "The of über"), (2, "row 42"), (3, "ROW—42 data"), (10, "été"), (4, None), (5, ""), (6, "Zoë Zoë zoë a1"), (None, "data data data"), (2, "row 42")]
    bench = spark.createDataFrame([(*x, 7) for x in items], "item_id bigint, text string, p int")
    got = decontaminate.contamination(docs_table(spark, rows), bench, n=n, max_broadcast_bytes=limit)
    assert sorted(map(tuple, got.collect()), key=str) == contamination_by_hand(rows, items, n)


def test_decontaminate_documents_and_spans(spark):
    rows = sample_rows(40)
    docs = docs_table(spark, rows)
    bench = spark.createDataFrame([(1, "The of über"), (2, "row 42 data")], "item_id bigint, text string")
    hit = {r[0:2] for r, c in zip(rows, contamination_by_hand_rows(rows, [(1, "The of über"), (2, "row 42 data")], 2), strict=True) if c}
    kept = decontaminate.decontaminate(docs, bench, n=2)
    assert kept.columns == docs.columns
    assert sorted(map(str, [(r["doc_id"], r["text"]) for r in kept.collect()])) == sorted(str(r[0:2]) for r in rows if r[0:2] not in hit)
    cut = decontaminate.decontaminate(docs, bench, mode="spans", n=2)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    one = spark.createDataFrame([(1, "Start, the OF end. Tail!", "s")], "doc_id bigint, text string, source string")
    assert decontaminate.decontaminate(one, bench, mode="spans", n=2).first()["text"] == "Start end. Tail!"


def contamination_by_hand_rows(rows, items, n):
    return [contamination_by_hand([r], items, n)[0][-1] for r in rows]


def test_contamination_empty_tables(spark):
    docs, bench = docs_table(spark, sample_rows(3)), spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(docs, bench).filter("contaminated").count() == 0
    assert decontaminate.contamination(docs, bench).count() == docs.count()
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


# ---------------------------------------------------------------- op 8


def targets_by_hand(sizes):
    order = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(sizes), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mixing_targets_and_taken(spark):
    rows = sample_rows(400) + [(1000 + i, "tiny words here", "tiny") for i in range(3)]
    docs = docs_table(spark, rows)
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = targets_by_hand(sizes)
    full = mixing.mix(docs).collect()
    for s, target in want.items():
        mine = [r for r in full if r["source"] == s]
        assert {r["source_size"] for r in mine} == {sizes[s]}
        assert all(abs(r["target"] - target) < 1e-6 * max(1, target) for r in mine)
        taken = sum(r["size"] * r["copies"] for r in mine)
        assert abs(taken - target) <= max([r["size"] for r in mine])
        assert all(0 <= r["copies"] <= 2 for r in mine)
    again = mixing.mix_report(docs).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(got, key=key) == sorted(again, key=key)


def test_mixing_small_cells_agree(spark, monkeypatch):
    rows = [(i, "w " * (i % 17 + 1), "hot" if i % 3 else f"s{i % 7}") for i in range(900)]
    monkeypatch.setattr(mixing, "CELL_ROWS", 10)
    full = mixing.mix(docs_table(spark, rows)).collect()
    for s in {r["source"] for r in full}:
        mine = [r for r in full if r["source"] == s]
        assert abs(sum(r["size"] * r["copies"] for r in mine) - mine[0]["target"]) <= 17


def test_mixed_rows(spark):
    rows = sample_rows(150)
    docs = docs_table(spark, rows)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    want = {(r["doc_id"], r["size"]): r["copies"] for r in mixing.mix(docs).collect() if r["doc_id"] is not None and r["doc_id"] != 5}
    got = {}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert all(got.get(i, 0) == n for (i, _), n in want.items())
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.mix_report(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- op 10


def terms_by_hand(text):
    return {w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if w}


def test_lexicon_is_the_idf_band(spark):
    rows = sample_rows(200)
    lex = imatch.lexicon(docs_table(spark, rows), 0.3, 0.6)
    df = {}
    for _, t, _ in rows:
        for w in terms_by_hand(t):
            df[w] = df.get(w, 0) + 1
    assert lex == sorted(w for w, n in df.items() if 0.3 * len(rows) <= n <= 0.6 * len(rows))


@pytest.mark.parametrize("range_rows", [2_000, 7, 1])
def test_near_report(spark, range_rows):
    rows = [r for r in sample_rows(90) if r[0] is not None]
    rows = [r for i, r in enumerate(rows) if r[0] != 5 or i == 5]
    docs = docs_table(spark, rows)
    got = {r["doc_id"]: r for r in imatch.near_report(docs, 0.2, 0.7, range_rows=range_rows).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -r[0])
    text_of = {}
    for (i, t, _), (j, u, _) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        k = len(t) // 2
        edited = t[:len(t) - k] + u[:k]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        fp, next_fp = got[i]["fingerprint"], got[j]["fingerprint"]
        parts = lambda f: [f[x:x + 8] for x in range(0, len(f), 8)]
        either = [(a, b) for a, b in zip(parts(fp), parts(next_fp), strict=True) if a != imatch.EMPTY or b != imatch.EMPTY]
        like = 1.0 if fp == next_fp else sum(a == b for a, b in either) / len(either) if either else 0.0
        assert abs(got[i]["near_next"] - like) < 1e-12
        assert 0 <= got[i]["near_edited"] <= 1
        for f, x in ((fp, t), (got[i]["edited_fingerprint"], edited)):
            assert text_of.setdefault(frozenset(terms_by_hand(x)), f) == f  # equal terms, equal fingerprint


def test_unlike_terms_have_unlike_fingerprints(spark):
    texts = ["", "...", *(f"w{i}" for i in range(60)), *(f"w{i} v{i}" for i in range(60)), *(f"w0 v{i}" for i in range(1, 60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for lex in ([], [f"w{i}" for i in range(60)], [f"{c}{i}" for c in "vw" for i in range(60)]):
        got = {r["i"]: r["f"] for r in docs.select("i", imatch.fingerprint("text", lex).alias("f")).collect()}
        assert got[0] == got[1] == imatch.EMPTY * imatch.SUBSETS
        assert len(set(got.values())) == len(texts) - 1


def test_near_report_hot_and_null_ids(spark):
    rows = [(7, f"same id {i}", "s") for i in range(60)] + [(None, f"none {i % 5}", "s") for i in range(50)] + [(i, f"t {i}", "s") for i in range(20, 40)]
    got = imatch.near_report(docs_table(spark, rows), range_rows=5)
    assert got.count() == len(rows)
    assert imatch.near_report(docs_table(spark, rows).limit(0)).count() == 0
    one = imatch.near_report(docs_table(spark, [(1, "only one text", "s")])).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"only ononly o").hexdigest()


def test_lexicon_as_a_table_gives_the_same_fingerprints(spark, monkeypatch):
    docs = docs_table(spark, sample_rows(60))
    want = sorted(map(str, imatch.near_report(docs, 0.2, 0.7).collect()))
    monkeypatch.setattr(imatch, "MAX_LEXICON", 3)
    assert sorted(map(str, imatch.near_report(docs, 0.2, 0.7).collect())) == want


# ---------------------------------------------------------------- columns of the stages


def test_stages_keep_columns_of_any_name(spark):
    """Names the stages use inside, and one with a dot, come back with their values."""
    from quire.llm import simhash
    extra = ["_text_md5", "_text_null", "_copies", "_draw", "_id", "_md5", "row", "hit", "items", "a.b", "_hit", "_found_id", "_keep_id", "size", "copies"]
    rows = [(i, f"text number {i} of many words that differ {i * 7}", "s", *[f"{c}{i}" for c in extra]) for i in range(12)]
    names = ["doc_id", "text", "source", *extra]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {'bigint' if n == 'doc_id' else 'string'}" for n in names))
    bench = spark.createDataFrame([(1, "text number 3 of many words that differ 21")], "item_id bigint, text string")
    want = {tuple(r) for r in rows}
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == names and {tuple(r) for r in kept.collect()} == {r for r in want if r[0] != 3}
    cut = decontaminate.decontaminate(docs, bench, mode="spans")
    assert cut.columns == names and {tuple(r) for r in cut.collect()} == {(3, "", *r[2:]) if r[0] == 3 else r for r in want}
    one = simhash.keep_one(docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 100)))
    assert one.columns == names and {tuple(r) for r in one.collect()} <= want
    mix = mixing.mixed(docs)
    got = mix.collect()
    assert mix.columns == names and {tuple(r) for r in got} <= want and len(got) >= 12
