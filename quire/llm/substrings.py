"""Substring dedup: matching statistics of every document against suffix automata of reference shards (op 13).

A word is removed when a window of ``window`` words that covers it also starts in a
document of a smaller id; windows are judged on the input texts.

The reference is the table itself, so its automata have no size bound and are not sent to
every task. They are cut by content instead, and every document meets only the shards that
can match it: two equal windows have the same minimizer (the least hash of their word
5-grams), so a run of windows that share a minimizer, with its words, goes to the shard
of that minimizer.

1. Documents are dealt by a hash into batches of bounded bytes. A batch sends its
   minimizers (8 bytes each), with the number of its documents that hold them, to their
   shards, which answer which of them occur in two documents or more.
2. A batch sends the words around those minimizers to the shards. A run that an earlier
   document of the same batch holds as well is settled there and sends no words.
3. A shard goes through its runs by ascending document id. Each run is streamed through
   the suffix automaton of the runs of smaller ids: where the matching statistic (length
   of the longest suffix read so far that the automaton holds) reaches ``window``, the
   window is a repeat. Then the run itself extends the automaton. Hashes only route:
   what is removed is decided on the words.
4. Repeats return to their batch as spans, and the documents are cut.

A minimizer in more than ``hot`` documents sends each of its windows alone, to the shard
of the window's own hash: a passage that a third of all documents share is then one
entry a batch and window, and the windows across its edges spread over all shards.

Rows without an id are returned whole and are no reference. A null or empty text has no
words. Rows that share an id are separate documents that remove nothing from each other.
Texts are whole. Extra columns are ignored, names with dots are allowed. An empty table
gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 13
#: Words of the grams that minimizers are chosen from.
GRAM = 5
#: Text bytes of a batch of documents, and of the texts a shard answers for, about.
BATCH_BYTES = 4 << 20
SHARD_BYTES = 8 << 20
#: Text bytes an automaton is built over, about: a shard's minimizers are taken in groups of this size.
AUTOMATON_BYTES = 1 << 20
#: Documents from which on a minimizer's windows are dealt one by one.
HOT = 4096
#: Bytes hashed at once.
SLICE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(256, 0xD6E8FEB86659FD93, np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _word_places(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer of all texts, start and end of every word in it, text of every word)."""
    joined = b"\n".join(texts) + b"\n"
    space = _SPACE[np.frombuffer(joined, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.r_[0, edges]
    starts, ends = edges[::2], edges[1::2]
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return joined, starts, ends, np.searchsorted(begins, starts, side="right") - 1


def _word_hashes(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word; equal words have equal ones."""
    buf = np.frombuffer(joined, np.uint8)
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + SLICE, side="right")))
        base, s = starts[lo], starts[lo:hi] - starts[lo]
        size = ends[lo:hi] - starts[lo:hi]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)  # place of a byte in its word
        terms = (buf[base:ends[hi - 1]][np.repeat(s, size) + at].astype(np.uint64) + np.uint64(1)) * _POWERS[at & 255]
        out[lo:hi] = np.add.reduceat(terms, np.cumsum(size) - size)
        lo = hi
    return _mixed(out)


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive words."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n):
        out = out * _BASE + h[j:j + len(out)]
    return _mixed(out)


class _Runs:
    """Runs of consecutive windows of one text that share their minimizer."""

    def __init__(self, texts: list[bytes], window: int):
        self.joined, self.starts, self.ends, self.text = _word_places(texts)
        self.hashes = _word_hashes(self.joined, self.starts, self.ends)
        gram = min(GRAM, window)
        least, span, width = _rolled(self.hashes, gram), 1, window - gram + 1
        while span < width:  # least of `width` neighbours, by doubling
            step = min(span, width - span)
            least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
            span += step
        count = max(0, len(self.starts) - window + 1)
        inside = np.flatnonzero(self.text[:count] == self.text[window - 1:window - 1 + count])
        key, text = least[inside], self.text[inside]
        new = np.ones(len(inside), bool)
        new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        self.first, self.length = inside[first], np.diff(np.r_[first, len(inside)])  # first word; windows
        self.key, self.doc = key[first], text[first]


def _batch(table: pa.Table) -> tuple[list, list[bytes]]:
    """(ids, texts) of a batch, in the order of its row numbers."""
    order = np.argsort(table.column("rid").to_numpy(), kind="stable")
    table = table.select(["id", "text"]).take(pa.array(order))
    return table.column("id").to_pylist(), [t or b"" for t in table.column("text").to_pylist()]


def _bytes(a: np.ndarray, dtype) -> bytes:
    return np.ascontiguousarray(a, dtype).tobytes()


def _number(table: pa.Table, name: str = "bid") -> int:
    return table.column(name)[0].as_py()


class SuffixAutomaton:
    """Suffix automaton of several word sequences, extended one sequence at a time."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _copy(self, state: int, length: int) -> int:
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.length.append(length)
        return len(self.length) - 1

    def _redirect(self, p: int, word, old: int, new: int) -> None:
        nxt, link = self.next, self.link
        while p >= 0 and nxt[p].get(word) == old:
            nxt[p][word] = new
            p = link[p]

    def add(self, words: list) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            known = nxt[last].get(w)
            if known is not None:
                if length[known] != length[last] + 1:
                    copy = self._copy(known, length[last] + 1)
                    link[known] = copy
                    self._redirect(last, w, known, copy)
                    known = copy
                last = known
                continue
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            cur, p = len(length) - 1, last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                if length[q] != length[p] + 1:
                    copy = self._copy(q, length[p] + 1)
                    link[q] = copy
                    self._redirect(p, w, q, copy)
                    q = copy
                link[cur] = q
            last = cur

    def matches(self, words: list, least: int) -> list[int]:
        """Starts of the windows of ``least`` words that occur in an added sequence."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        out = []
        for i, w in enumerate(words):
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nxt[state].get(w)
            if to is None:
                size = 0
                continue
            state = to
            size += 1
            if size >= least:
                out.append(i - least + 1)
        return out


def _repeats(texts: list[bytes], ids: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(entry, first word, end) of the spans of each entry that an entry of a smaller id holds; entries by ascending id."""
    automaton, whole, found = SuffixAutomaton(), set(), []
    lo = 0
    while lo < len(texts):
        hi = lo + int(np.searchsorted(ids[lo:], ids[lo], side="right"))
        new = {}
        for e in range(lo, hi):
            text = texts[e]
            words = text.split()
            starts = range(len(words) - window + 1) if text in whole else automaton.matches(words, window)
            begin = end = None
            for s in starts:
                if begin is None:
                    begin = s
                elif s != last + 1:  # noqa: F821 - set with begin
                    found.append((e, begin, end))
                    begin = s
                last, end = s, s + window
            if begin is not None:
                found.append((e, begin, end))
            if len(starts) < len(words) - window + 1:
                new[text] = words
            else:
                whole.add(text)
        for text, words in new.items():
            automaton.add(words)
            whole.add(text)
        lo = hi
    return found


def _dealt(batches: DataFrame, window: int, shards: int) -> DataFrame:
    """Step 1: (shard, bid, keys, counts) of every batch's minimizers."""

    def run(table: pa.Table) -> pa.Table:
        ids, texts = _batch(table)
        runs = _Runs(texts, window)
        has_id = np.array([i is not None for i in ids], bool)[runs.doc]
        key, doc = runs.key[has_id], runs.doc[has_id]
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        once = np.ones(len(key), bool)
        once[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        key, counts = np.unique(key[once], return_counts=True)
        shard = (key % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        key, counts, shard = key[order], counts[order], shard[order]
        cut = np.searchsorted(shard, np.arange(shards + 1))
        some = np.flatnonzero(cut[1:] > cut[:-1])
        return pa.table({"shard": pa.array(some, pa.int32()), "bid": pa.array(np.full(len(some), _number(table)), pa.int64()),
                         "keys": pa.array([_bytes(key[cut[s]:cut[s + 1]], "<u8") for s in some], pa.binary()),
                         "counts": pa.array([_bytes(counts[cut[s]:cut[s + 1]], "<u4") for s in some], pa.binary())})

    return batches.groupBy("bid").applyInArrow(run, "shard int, bid bigint, keys binary, counts binary")


def _shared(dealt: DataFrame, hot: int) -> DataFrame:
    """Step 1, answers: (bid, keys, hot) of the minimizers that two documents or more hold."""

    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b, "<u8") for b in table.column("keys").to_pylist()]
        key = np.concatenate(parts)
        count = np.concatenate([np.frombuffer(b, "<u4") for b in table.column("counts").to_pylist()])
        _, place = np.unique(key, return_inverse=True)
        total = np.bincount(place, weights=count)[place]
        cut = np.cumsum([0] + [len(p) for p in parts])
        keep = [slice(cut[i], cut[i + 1]) for i in range(len(parts))]
        several = total >= 2
        return pa.table({"bid": table.column("bid"),
                         "keys": pa.array([_bytes(key[s][several[s]], "<u8") for s in keep], pa.binary()),
                         "hot": pa.array([_bytes(total[s][several[s]] > hot, "u1") for s in keep], pa.binary())})

    return dealt.groupBy("shard").applyInArrow(run, "bid bigint, keys binary, hot binary")


def _candidates(batches: DataFrame, shared: DataFrame, window: int, shards: int) -> DataFrame:
    """Step 2: (shard, bid, heads, words, settled): the runs of shared minimizers, and the spans settled inside their batch.

    ``heads`` holds five numbers a run (key, id, row, first word, bytes of text).
    """

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        empty = {"shard": pa.array([], pa.int32()), "bid": pa.array([], pa.int64()), "heads": pa.array([], pa.binary()),
                 "words": pa.array([], pa.binary()), "settled": pa.array([], pa.binary())}
        if not table.num_rows or not answers.num_rows:
            return pa.table(empty)
        ids, texts = _batch(table)
        known = np.concatenate([np.frombuffer(b, "<u8") for b in answers.column("keys").to_pylist()])
        hot = np.concatenate([np.frombuffer(b, "u1") for b in answers.column("hot").to_pylist()])
        if not len(known):
            return pa.table(empty)
        order = np.argsort(known)
        known, hot = known[order], hot[order].astype(bool)
        runs = _Runs(texts, window)
        at = np.minimum(np.searchsorted(known, runs.key), len(known) - 1)
        has_id = np.array([i is not None for i in ids], bool)
        take = (known[at] == runs.key) & has_id[runs.doc]
        alone = take & hot[at]
        take &= ~alone
        key, first, length, doc = (x[take] for x in (runs.key, runs.first, runs.length, runs.doc))
        if alone.any():
            n = runs.length[alone]
            single = np.repeat(runs.first[alone] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            key = np.r_[key, _rolled(runs.hashes, window)[single]]
            first, length, doc = np.r_[first, single], np.r_[length, np.ones(len(single), length.dtype)], np.r_[doc, np.repeat(runs.doc[alone], n)]
        number = np.array([i or 0 for i in ids], np.int64)[doc]
        before = np.searchsorted(runs.text, np.arange(len(texts)))  # words in front of each text
        order = np.lexsort((first, number))
        key, first, length, doc, number = (x[order] for x in (key, first, length, doc, number))
        begin, end, place = runs.starts[first], runs.ends[first + length + window - 2], first - before[doc]
        seen: dict[bytes, int] = {}
        settled, sent, words = [], [], []
        joined = runs.joined
        for e, (b, z, i) in enumerate(zip(begin.tolist(), end.tolist(), number.tolist(), strict=True)):
            text = joined[b:z]
            if seen.setdefault(text, i) < i:
                settled.append(e)
            else:
                sent.append(e)
                words.append(text)
        settled, sent = np.array(settled, np.int64), np.array(sent, np.int64)
        shard = (key[sent] % np.uint64(shards)).astype(np.int64)
        bid = _number(table)
        home = bid % shards
        parts = {s: np.flatnonzero(shard == s) for s in np.unique(shard).tolist()}
        parts.setdefault(home, np.array([], np.int64))
        spans = np.stack([doc[settled], place[settled], place[settled] + length[settled] + window - 1], 1)
        rows = [(s, _bytes(np.stack([key[sent[p]].view(np.int64), number[sent[p]], doc[sent[p]], place[sent[p]],
                                     np.array([len(words[x]) for x in p], np.int64)], 1), "<i8"),
                 b"".join([words[x] for x in p]), _bytes(spans, "<i8") if s == home else b"") for s, p in parts.items()]
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "bid": pa.array([bid] * len(rows), pa.int64()),
                         "heads": pa.array([r[1] for r in rows], pa.binary()), "words": pa.array([r[2] for r in rows], pa.binary()),
                         "settled": pa.array([r[3] for r in rows], pa.binary())})

    return (batches.groupBy("bid").cogroup(shared.groupBy("bid"))
            .applyInArrow(run, "shard int, bid bigint, heads binary, words binary, settled binary"))


def _spans(candidates: DataFrame, window: int, automaton_bytes: int) -> DataFrame:
    """Step 3: (bid, spans): three numbers a repeat (row, first word, end)."""

    def run(table: pa.Table) -> pa.Table:
        bids = table.column("bid").to_pylist()
        out: dict[int, list] = {}
        heads, texts, owner = [], [], []
        for bid, head, words, settled in zip(bids, *(table.column(c).to_pylist() for c in ("heads", "words", "settled")), strict=True):
            h = np.frombuffer(head, "<i8").reshape(-1, 5)
            cut = np.cumsum(np.r_[0, h[:, 4]]).tolist()
            texts += [words[a:b] for a, b in zip(cut, cut[1:])]
            heads.append(h)
            owner += [bid] * len(h)
            out.setdefault(bid, []).append(np.frombuffer(settled, "<i8").reshape(-1, 3))
        head, owner = np.concatenate(heads), np.array(owner, np.int64)
        order = np.lexsort((head[:, 1], head[:, 0]))
        key, number = head[order, 0], head[order, 1]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.array([], np.int64)
        last = np.r_[first[1:], len(key)].astype(np.int64)
        found = []
        several = number[first] < number[last - 1]  # keys that documents of two ids hold
        chunk: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            rows = np.concatenate(chunk)
            rows = rows[np.argsort(head[rows, 1], kind="stable")]
            for e, a, z in _repeats([texts[r] for r in rows.tolist()], head[rows, 1], window):
                found.append((rows[e], a, z))

        for a, z in zip(first[several].tolist(), last[several].tolist(), strict=True):
            chunk.append(order[a:z])
            size += int(head[order[a:z], 4].sum())
            if size >= automaton_bytes:
                flush()
                chunk, size = [], 0
        if chunk:
            flush()
        if found:
            f = np.array(found, np.int64)
            spans = np.stack([head[f[:, 0], 2], head[f[:, 0], 3] + f[:, 1], head[f[:, 0], 3] + f[:, 2]], 1)
            to = owner[f[:, 0]]
            for bid in np.unique(to).tolist():
                out[bid].append(spans[to == bid])
        out = {bid: np.concatenate(s) for bid, s in out.items()}
        return pa.table({"bid": pa.array(list(out), pa.int64()), "spans": pa.array([_bytes(s, "<i8") for s in out.values()], pa.binary())})

    return candidates.groupBy("shard").applyInArrow(run, "bid bigint, spans binary")


def _cut(batches: DataFrame, spans: DataFrame) -> DataFrame:
    """Step 4: (id, n_words, n_removed, kept) of every row."""

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        ids, texts = _batch(table)
        s = np.concatenate([np.frombuffer(b, "<i8").reshape(-1, 3) for b in found.column("spans").to_pylist()] or [np.zeros((0, 3), np.int64)])
        s = s[np.argsort(s[:, 0], kind="stable")]
        cut = np.searchsorted(s[:, 0], np.arange(len(texts) + 1))
        n_words, n_removed, kept = [], [], []
        for i, text in enumerate(texts):
            words = text.split()
            n_words.append(len(words))
            mine = s[cut[i]:cut[i + 1]]
            if len(mine):
                depth = np.zeros(len(words) + 1, np.int64)
                np.add.at(depth, mine[:, 1], 1)
                np.add.at(depth, mine[:, 2], -1)
                stay = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
                n_removed.append(len(words) - len(stay))
                words = [words[j] for j in stay.tolist()]
            else:
                n_removed.append(0)
            kept.append(b" ".join(words))
        return pa.table({"id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()),
                         "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary())})

    return batches.groupBy("bid").cogroup(spans.groupBy("bid")).applyInArrow(run, "id bigint, n_words bigint, n_removed bigint, kept binary")


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES,
                   shard_bytes: int = SHARD_BYTES, automaton_bytes: int = AUTOMATON_BYTES, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: its id, n_words, n_removed and ``kept``, the words that stay, joined by one space.

    The documents are dealt into batches by one exchange, which all four steps read.
    """
    text, id_ = F.col(f"`{text_col}`"), F.col(f"`{id_col}`").cast("bigint")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n_batches, shards = max(1, -(-total // batch_bytes)), max(1, -(-total // shard_bytes))
    rows = docs.select(id_.alias("id"), text.cast("binary").alias("text"), F.monotonically_increasing_id().alias("rid"))
    # the row number spreads repeated rows and rows without an id
    batches = rows.select(F.pmod(F.xxhash64("id", "rid"), F.lit(n_batches)).alias("bid"), "rid", "id", "text")
    shared = _shared(_dealt(batches, window, shards), hot)
    spans = _spans(_candidates(batches, shared, window, shards), window, automaton_bytes)
    return _cut(batches, spans).select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))


def repeat_report(docs: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256."""
    return remove_repeats(docs, id_col=id_col, **kw).select(f"`{id_col}`", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
