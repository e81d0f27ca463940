"""Hard negatives, the conversation trie and substring dedup against brute force, on rows with every awkward case."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm import negatives, substrings, trie


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def with_clashing_columns(df):
    """Extra columns whose names the operators use inside, and one with a dot."""
    for name in ("id", "block", "rid", "bid", "path", "seg", "p", "score", "slot", "a.b"):
        df = df.withColumn(name, F.lit("x"))
    return df


# --- op 11

def hard_negatives_by_hand(rows, k=5):
    valid = {(i, tuple(v), lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    valid = [(i, [math.floor(256.0 * x) for x in v], lab) for i, v, lab in valid]
    out = []
    for a, av, al in valid:
        if a % 100:
            continue
        scored = [(-max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(av, v, strict=True)))), i, lab) for i, v, lab in valid if len(v) == len(av) and i != a]
        positives = sorted((s, i) for s, i, lab in scored if lab == al)[:k]
        others = sorted((s, i) for s, i, lab in scored if lab != al)
        for p, pid in positives:
            window = [(-s, i) for s, i in others if 80 * -p <= 100 * -s <= 100 * -p][:k]
            out += [(a, pid, r + 1, i, -p, s) for r, (s, i) in enumerate(window)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def vectors():
    rnd = random.Random(1)
    rows = []
    for i in range(500):
        v = [rnd.choice([0.0, 0.5, 1.0, -0.5, rnd.random()]) for _ in range(3)]
        x = rnd.random()
        if x < 0.02:
            v = None
        elif x < 0.04:
            v[1] = None
        elif x < 0.06:
            v[1] = float(rnd.choice(["nan", "inf"]))
        elif x < 0.08:
            v = v[:2]
        elif x < 0.09:
            v = []
        elif x < 0.1:
            v = [3e9, 3e20, 1e300]
        rows.append((rnd.choice([None] + [i] * 20 + [i // 7 * 100]), v, rnd.choice([None, 1, 2, 2, 2, 3])))
    return rows + rows[:80]


@pytest.mark.parametrize("blocks", [{}, {"anchor_bytes": 200, "row_bytes": 3000}])
def test_hard_negatives(spark, vectors, blocks):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").repartition(4)
    got = negatives.hard_negatives(with_clashing_columns(df), F.col("vec_id") % 100 == 0, **blocks)
    assert rows_of(got) == hard_negatives_by_hand(vectors)


def test_hard_negatives_keep_k_of_identical_rows(spark):
    rows = [(i, [1.0, 1.0], i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert rows_of(negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, k=2)) == hard_negatives_by_hand(rows, 2)


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert rows_of(negatives.hard_negatives(df, F.col("vec_id") % 100 == 0)) == []


def test_lower_limit_is_the_least_whole_number():
    for u in range(-40, 60):
        assert negatives.lower(u) == min(n for n in range(-200, 200) if 80 * u <= 100 * n)


# --- op 12

def trie_by_hand(rows, rebuild=True):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        built[c] = tuple(own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + v[h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    for node in members:
        if node:
            kids[node[:-1]].add(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in kids[node]) if kids[node] else 1
        saved[node] = sum(saved[x] for x in kids[node]) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(node))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]), leaves[node], saved[node],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def conversations():
    rnd = random.Random(5)
    rows = []
    for i in range(120):
        c = rnd.choice([i, -i, None, i % 7, 10**12 + i, 2**63 - 1 - i % 3])
        for t in range(rnd.choice([1, 2, 3, 9, 12])):
            rows.append((c, rnd.choice([t, None, t // 2]), rnd.choice(["u", "a", None, ""]), rnd.choice(["x", "yé", "", None])))
    return rows + rows[:15]


@pytest.mark.parametrize("group_turns", [trie.GROUP_TURNS, 20])
def test_trie_of_rebuilt_conversations(spark, conversations, group_turns):
    df = spark.createDataFrame(conversations, "conv_id long, turn long, role string, text string").repartition(3)
    assert rows_of(trie.nodes(trie.rebuilt(with_clashing_columns(df)), group_turns)) == trie_by_hand(conversations)


def test_trie_of_crowded_prefixes(spark):
    """A greeting that all share, one long conversation, and copies: level by level above, in groups below."""
    rows = [(c, t, "u", text) for c in range(60) for t, text in enumerate(["hello", "a" * (c % 3), "b", str(c % 20)])]
    rows += [(1000, t, "u", "hello" if t == 0 else str(t)) for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert rows_of(trie.nodes(trie.paths(df), group_turns=50)) == trie_by_hand(rows, rebuild=False)


def test_ids_of_a_sequence_are_joined_across_blocks(spark):
    rows = [(c, 0, "u", "same") for c in (5, 70_000, -3, 2**40, 65_536)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert rows_of(trie.nodes(trie.paths(df))) == trie_by_hand(rows, rebuild=False)


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert rows_of(trie.rebuilt_nodes(df)) == []


# --- op 13

def repeats_by_hand(rows, window=13):
    first, out = {}, []
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in docs:
        for p in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[p:p + window])
            first[key] = min(first.get(key, i), i)
    for i, w in docs:
        gone = set()
        for p in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[p:p + window])] < i:
                gone |= set(range(p, p + window))
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def passages():
    rnd = random.Random(3)
    base = [[rnd.choice("abcdefg") + str(rnd.randint(0, 3)) for _ in range(rnd.randint(0, 60))] for _ in range(12)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rnd.randint(0, 4)):
            b = rnd.choice(base)
            at = rnd.randint(0, max(0, len(b) - 1))
            w += b[at:at + rnd.randint(0, 40)]
        rows.append((rnd.choice([None, i, i // 2, -i]), rnd.choice([" ", "  ", "\n", "  "]).join(w) if rnd.random() < 0.95 else None))
    rows.append((500, " ".join(base[0] * 300)))  # a long text that repeats itself
    return rows + rows[:20]


@pytest.mark.parametrize("sizes", [{}, {"hot": 2, "batch_bytes": 500, "shard_bytes": 800, "automaton_bytes": 100}, {"window": 3}, {"window": 1, "hot": 1}])
def test_substring_dedup(spark, passages, sizes):
    df = spark.createDataFrame(passages, "doc_id long, text string").repartition(3)
    assert rows_of(substrings.repeat_report(with_clashing_columns(df), **sizes)) == repeats_by_hand(passages, sizes.get("window", 13))


def test_kept_text(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, f"one {passage}\n end"), (2, f"two  words {passage} more"), (3, passage), (4, "w1 w2 w3")], "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in substrings.remove_repeats(df).collect()}
    assert got == {1: f"one {passage} end", 2: "two words more", 3: "", 4: "w1 w2 w3"}


def test_substring_dedup_of_nothing(spark):
    assert rows_of(substrings.repeat_report(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_suffix_automaton_finds_every_window():
    rnd = random.Random(7)
    for _ in range(60):
        seqs = [[rnd.choice("ab") for _ in range(rnd.randint(0, 12))] for _ in range(4)]
        text = [rnd.choice("abc") for _ in range(15)]
        automaton = substrings.SuffixAutomaton()
        for s in seqs:
            automaton.add(s)
        held = {tuple(s[i:i + 3]) for s in seqs for i in range(len(s) - 2)}
        assert automaton.matches(text, 3) == [i for i in range(len(text) - 2) if tuple(text[i:i + 3]) in held]


def test_word_hashes_in_slices(monkeypatch):
    joined, starts, ends, _ = substrings._word_places([b"a bb  ccc a", b"", b"\nbb " + b"x" * 700 + b" a"])
    whole = substrings._word_hashes(joined, starts, ends)
    monkeypatch.setattr(substrings, "SLICE", 4)
    assert whole.tolist() == substrings._word_hashes(joined, starts, ends).tolist()
    by_word = {}
    for s, e, h in zip(starts, ends, whole.tolist(), strict=True):
        assert by_word.setdefault(joined[s:e], h) == h
    assert len(set(by_word.values())) == len(by_word)
