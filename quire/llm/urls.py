"""URL filter: rule list, then gradient-boosted trees on lexical features (op 1).

Rules decide first (longest fitting rule). Every other URL is judged by a boosted
tree model (MLlib) over length, depth, digit ratio, entropy, parameter counts and
suffix statistics, trained from labelled URLs: any table of (url, label 0/1), or
those ``word_labels`` marks by whole host words of known categories. The model
itself never sees a word, only the lexical features. Suffix statistics are smoothed
shares of blocked URLs among all labelled URLs whose host ends in the same one, two
or three names, counted for each suffix and joined by it. A level of at most
``BROADCAST_BYTES`` is broadcast; of a larger one only the frequent suffixes are, and
the other rows are joined in a shuffle.

DataFrame functions and MLlib only. A null URL or one without ``://`` has an empty
host and path, fits no rule, and is judged by the model on the features of its text
(null: the empty text). With no labelled URL, or labels of one class only, the model
is that constant (none: allow). Extra columns are ignored; repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# Host words that mark a URL as one to block when no label table is given.
BLOCK_WORDS = ("ad", "ads", "adult", "bet", "bets", "casino", "pills", "poker", "porn", "spam", "track", "tracker", "viagra", "xxx")
LEVELS = (1, 2, 3)
#: Bytes up to which a level's suffixes are broadcast. Of a larger level, those with a ``HOT``-th of the labelled URLs are (at most HOT, of HOT_BYTES at most).
BROADCAST_BYTES = 8 << 20
HOT, HOT_BYTES = 1_000, 1_024
#: Places among which the rows of a suffix outside the broadcast part are dealt.
SALTS = 8
SMOOTHING = 5.0
#: Bound of the training sample (rows drawn by hash; suffix statistics use all labelled rows).
TRAIN_ROWS = 20_000
SEED = 7
BLOCK_AT = 0.5
FEATURES = ("length", "host_length", "depth", "digit_ratio", "entropy", "n_params", "n_values", "n_hyphens", "n_names", "longest_name",
            "fragment", "secure", *(f"suffix{k}" for k in LEVELS))


def host(url: str) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host_col: str, path_col: str, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, or null: its host or a subdomain of it, and a path that starts with the rule's."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest ends up outermost
        at = rule.index("/")
        name, prefix = rule[:at], rule[at:]
        fits = ((F.col(host_col) == name) | F.endswith(host_col, F.lit("." + name))) & F.startswith(path_col, F.lit(prefix))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def word_labels(pages: DataFrame, url_col: str = "url", block_words: Sequence[str] = BLOCK_WORDS) -> DataFrame:
    """(url, label): 1 if a whole word of the host is one of ``block_words``; rows without a host have no label."""
    h = pages.select(F.col(url_col).alias("url"), host(url_col).alias("h")).filter(F.length("h") > 0)
    return h.select("url", F.arrays_overlap(F.split("h", r"[.\-_]"), F.array(*[F.lit(w) for w in block_words])).cast("int").alias("label"))


def _lexical(df: DataFrame) -> DataFrame:
    """Adds the lexical features of ``_u`` (never null) and the suffixes ``_c1..``."""
    u, n = F.col("_u"), F.greatest(F.length("_u"), F.lit(1))
    df = df.withColumns({"_h": host("_u"), "_p": path("_u"), "_q": F.regexp_extract("_u", r"(?s)\?([^#]*)", 1)})
    names = F.split("_h", r"\.")
    chars = F.array_distinct(F.split(u, ""))
    share = lambda c: (F.length("_u") - F.length(F.replace(u, c, F.lit("")))) / n
    out = df.withColumns({
        "length": F.length("_u"), "host_length": F.length("_h"), "depth": F.size(F.filter(F.split("_p", "/"), lambda x: x != "")),
        "digit_ratio": (F.length("_u") - F.length(F.translate(u, "0123456789", ""))) / n,
        "entropy": F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c))),
        "n_params": F.when(F.col("_q") == "", 0).otherwise(F.size(F.split("_q", "&"))), "n_values": F.length("_q") - F.length(F.translate("_q", "=", "")),
        "n_hyphens": F.length("_h") - F.length(F.translate("_h", "-", "")), "n_names": F.size(names),
        "longest_name": F.array_max(F.transform(names, F.length)), "fragment": F.contains(u, F.lit("#")).cast("int"),
        "secure": F.startswith(u, F.lit("https")).cast("int"),
    })
    for k in LEVELS:
        out = out.withColumn(f"_c{k}", F.substring_index("_h", ".", -k))
    return out


def _suffix_stats(labelled: DataFrame) -> DataFrame:
    """(_k, _c, _n, _s): labelled URLs and blocked ones of each suffix."""
    suffix = F.explode(F.array(*[F.struct(F.lit(k).alias("_k"), F.col(f"_c{k}").alias("_c")) for k in LEVELS]))
    return labelled.select("label", suffix.alias("x")).groupBy("x._k", "x._c").agg(F.count("*").alias("_n"), F.sum("label").alias("_s"))


def _levels(stats: DataFrame) -> dict[int, tuple[DataFrame, DataFrame | None]]:
    """Per level the suffixes to broadcast, and the others where they are too many for that."""
    sizes = stats.groupBy("_k").agg(F.sum(F.octet_length("_c") + 32).alias("bytes"), F.sum("_n").alias("n")).collect()  # a row per level
    out = {}
    for r in sizes:
        one = stats.filter(F.col("_k") == r["_k"]).select("_c", "_n", "_s")
        hot = (F.col("_n") >= r["n"] / HOT) & (F.octet_length("_c") <= HOT_BYTES)
        out[r["_k"]] = (one, None) if r["bytes"] <= BROADCAST_BYTES else (one.filter(hot), one.filter(~hot))
    return out


def _with_suffixes(df: DataFrame, levels: dict[int, tuple[DataFrame, DataFrame | None]], prior: float, own: bool) -> DataFrame:
    """Adds suffix1..; ``own`` leaves a training row's own label out of its statistics."""
    for k, (first, rest) in sorted(levels.items()):
        df = df.join(F.broadcast(first.withColumnRenamed("_c", f"_c{k}")), f"_c{k}", "left")
        if rest is not None:
            # rows that have their counts already are dealt evenly and meet nothing
            draw, done = F.xxhash64("_u", F.monotonically_increasing_id()), F.col("_n").isNotNull()
            df = df.withColumns({"_at": F.when(~done, F.col(f"_c{k}")), "_salt": F.when(done, F.pmod(draw, F.lit(1 << 20)) + SALTS).otherwise(F.pmod(draw, F.lit(SALTS)))})
            salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
            rest = rest.select(F.col("_c").alias("_at"), F.col("_n").alias("_n2"), F.col("_s").alias("_s2"), salts.alias("_salt"))
            df = df.join(rest.hint("shuffle_merge"), ["_at", "_salt"], "left").withColumns({"_n": F.coalesce("_n", "_n2"), "_s": F.coalesce("_s", "_s2")})
            df = df.drop("_at", "_salt", "_n2", "_s2")
        n, s = F.coalesce("_n", F.lit(0)), F.coalesce("_s", F.lit(0))
        if own:
            n, s = n - 1, s - F.col("label")
        df = df.withColumn(f"suffix{k}", (s + prior * SMOOTHING) / (n + SMOOTHING)).drop("_n", "_s")
    return df


class UrlModel:
    """A trained filter: ``score(df, url_col)`` adds ``score``, the probability that the URL is one to block."""

    def __init__(self, levels: dict[int, tuple[DataFrame, DataFrame | None]] | None, prior: float, model):
        self.levels, self.prior, self.model = levels, prior, model

    def score(self, df: DataFrame, url_col: str = "url") -> DataFrame:
        if self.model is None:
            return df.withColumn("score", F.lit(self.prior))
        cols = [F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(df.columns)]
        x = _lexical(df.select(*cols, F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("_u")))
        x = self.model.transform(_with_suffixes(x, self.levels, self.prior, own=False))
        return x.select(*[F.col(f"_in{i}").alias(c) for i, c in enumerate(df.columns)], vector_to_array("probability")[1].alias("score"))


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS, trees: int = 10, depth: int = 4, seed: int = SEED) -> UrlModel:
    """Fits the filter on (url, label). Statistics use every labelled row, the trees at most about ``train_rows`` drawn by hash."""
    rows = _lexical(labelled.filter("label IS NOT NULL").select(F.coalesce("url", F.lit("")).alias("_u"), "label"))
    stats = written(_suffix_stats(rows), "suffix-stats")
    total = stats.filter(F.col("_k") == LEVELS[0]).agg(F.sum("_n"), F.sum("_s")).first()
    n, blocked = total[0] or 0, total[1] or 0
    if n == 0 or blocked in (0, n):
        return UrlModel(None, float(blocked > 0), None)
    prior = blocked / n
    levels = _levels(stats)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_u", F.monotonically_increasing_id()), 33) / F.lit(float(1 << 31))
    share = F.when(F.col("label") == 1, train_rows / 2 / blocked).otherwise(train_rows / 2 / (n - blocked))
    sample = _with_suffixes(rows.filter(draw < share), levels, prior, own=True).select("label", *FEATURES)
    sample = written(sample.repartition(8), "url-sample")
    gbt = GBTClassifier(featuresCol="_x", labelCol="label",
                        maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed, minInstancesPerNode=5)
    model = Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="_x"), gbt]).fit(sample)
    return UrlModel(levels, prior, model)


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: Sequence[tuple[str, str]] = RULES, block_at: float = BLOCK_AT,
          id_col: str = "page_id", url_col: str = "url", **fit) -> DataFrame:
    """Per page: id, host, path, rule (or null), verdict (the rule's, else the model's), score."""
    model = train(word_labels(pages, url_col) if labelled is None else labelled, **fit)
    p = pages.select(id_col, F.col(url_col).alias("_url"), host(url_col).alias("host"), path(url_col).alias("path"))
    p = model.score(p.withColumn("rule", rule_of("host", "path", rules)), "_url")
    verdict = F.when(F.col("score") >= block_at, "block").otherwise("allow")
    for v, rule in rules:
        verdict = F.when(F.col("rule") == rule, v).otherwise(verdict)
    return p.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "score")
