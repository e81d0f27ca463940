"""I-Match document fingerprints (op 10).

Terms whose inverse document frequency lies in a band (neither too common nor too
rare) form the lexicon. It is dealt at random, by a seeded hash of the term, into
``SUBSETS`` subsets, so every term is in one; a document's sorted distinct terms of
each subset are hashed, and the hashes in order are its fingerprint. The likeness of
two fingerprints is the share of equal hashes among the subsets in which either
document has a term.

Document frequencies cover all documents. The band's lower end is a share of the
documents, so the lexicon has at most (mean distinct terms) / (lower share) terms
whatever the size of the corpus; it is read by the driver and put into the
expression as a set of literals. Fingerprints then need no shuffle. A lexicon over
``MAX_LEXICON`` (very long texts) stays a written table, which the documents' terms
are joined with, for the same fingerprints.

DataFrame functions only. A null text counts as empty; a text with fewer than
``MIN_TERMS`` lexicon terms is fingerprinted by all its terms; texts without words
share one fingerprint, alike only with itself. Repeated rows are separate documents
of equal fingerprint; rows of equal or null id follow each other in the order of
their text's digest. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_ALNUM, words, written

MIN_SHARE, MAX_SHARE = 0.01, 0.3
SUBSETS = 32
MIN_TERMS = 2
SEED = 101
MAX_LEXICON = 200_000
#: Places among which the documents of a term are dealt when the lexicon is a table.
SALTS = 8
#: Rows of a range of the document order, about, and the most ranges whose boundaries are looked up.
RANGE_ROWS = 2_000
MAX_RANGES = 1 << 16
EMPTY = "--------"


def terms(text: Column | str) -> Column:
    """Distinct lower-case terms of a text."""
    return F.array_distinct(words(F.lower(text), NOT_ALNUM))


def lexicon(docs: DataFrame, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE, text_col: str = "text") -> list[str] | DataFrame:
    """Sorted terms that occur in ``min_share`` to ``max_share`` of all documents (an idf band); over ``MAX_LEXICON`` a table (term)."""
    df = docs.select(F.explode(terms(text_col)).alias("term")).groupBy("term").count()
    n = docs.count()
    band = df.filter((F.col("count") >= min_share * n) & (F.col("count") <= max_share * n)).select("term")
    found = [r["term"] for r in band.limit(MAX_LEXICON + 1).collect()]
    if len(found) > MAX_LEXICON:
        return written(band, "lexicon")
    return sorted(found)


def with_fingerprint(rows: DataFrame, name: str, text_col: str, lex: list[str] | DataFrame) -> DataFrame:
    """``rows`` with the fingerprint of column ``text_col`` as ``name``."""
    if isinstance(lex, list):
        return rows.withColumn(name, fingerprint(text_col, lex))
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "unmarked")  # written, so a row keeps its number
    found = rows.select("_row", F.pmod("_row", F.lit(SALTS)).alias("_salt"), F.explode(terms(text_col)).alias("term"))
    salted = lex.select("term", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("_salt"))
    band = found.join(salted, ["term", "_salt"]).groupBy("_row").agg(F.collect_list("term").alias("_band"))
    return rows.join(band, "_row", "left").withColumn(name, fingerprint(text_col, "_band")).drop("_row", "_band")


def fingerprint(text: str, lex: list[str] | str, subsets: int = SUBSETS, min_terms: int = MIN_TERMS, seed: int = SEED) -> Column:
    """Fingerprint of column ``text``: a hash (8 hex digits) per subset, ``EMPTY`` where the text has no term of it.

    SQL text, as a lexicon of thousands of terms is parsed at once this way. ``lex`` may
    also name a column with the text's distinct terms in the lexicon (null: none).
    """
    let = lambda name, value, use: f"element_at(transform(array({value}), {name} -> {use}), 1)"  # noqa: E731  value is computed once
    every = f"array_distinct(array_remove(split(lower({text}), '{NOT_ALNUM}'), ''))".replace("\\", "\\\\")
    # terms have no quotes or backslashes: all of ASCII but letters and digits separates them
    band = "filter(every, t -> t IN (" + ", ".join(f"'{t}'" for t in lex) + "))" if lex else "every"
    if isinstance(lex, str):
        band = f"coalesce({lex}, cast(array() AS array<string>))"
    chosen = let("band", band, f"if(size(band) >= {min_terms}, band, every)")
    # a term is led by a character for its subset; with one bare character per subset the sorted terms fall into the subsets
    first = 48
    dealt = f"transform(chosen, t -> concat(char({first} + pmod(xxhash64({seed}, t), {subsets})), t))"
    marks = f"transform(sequence({first}, {first + subsets - 1}), c -> char(c))"
    line = f"array_join(transform(sort_array(concat({marks}, {dealt})), x -> if(length(x) = 1, '\\t', substring(x, 2))), ' ')"
    digest = f"if(length(x) <= 1, '{EMPTY}', lpad(lower(hex(crc32(cast(trim(x) AS binary)))), 8, '0'))"
    joined = f"array_join(transform(slice(split({line}, '\\t'), 2, {subsets}), x -> {digest}), '')"
    return F.expr(let("every", every, let("chosen", chosen, joined)))


def likeness(a: Column | str, b: Column | str, subsets: int = SUBSETS) -> Column:
    """0 to 1; two fingerprints without any term are alike."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    at = lambda f, j: F.substring(f, j * 8 + 1, F.lit(8))
    js = F.sequence(F.lit(0), F.lit(subsets - 1))
    either = F.size(F.filter(js, lambda j: (at(a, j) != EMPTY) | (at(b, j) != EMPTY)))
    same = F.size(F.filter(js, lambda j: (at(a, j) != EMPTY) & (at(a, j) == at(b, j))))
    return F.when(a == b, 1.0).when(either == 0, 0.0).otherwise(same / either).cast("double")


def _range_of(ids: DataFrame, n: int) -> Column:
    """Range (0 up, ascending with ``_id``) of a row: approximate quantiles as boundaries, looked up in two levels.

    A value that several quantiles share gets a range of its own, so that it can be divided further.
    """
    cuts = ids.agg(F.percentile_approx("_id", [i / n for i in range(1, n)], max(10_000, 10 * n))).first()[0] if n > 1 else None
    cuts = cuts or []
    hot = {c for c, d in zip(cuts, cuts[1:], strict=False) if c == d}
    cuts = sorted({*cuts, *(c + 1 for c in hot)})
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    heads = F.array(*[F.lit(cuts[i]) for i in range(0, len(cuts), step)])
    rows = F.array(*[F.array(*[F.lit(c) for c in cuts[i:i + step]]) for i in range(0, len(cuts), step)])
    row = F.size(F.filter(heads, lambda c: c <= F.col("_id")))
    inside = F.size(F.filter(F.element_at(rows, F.greatest(row, F.lit(1))), lambda c: c <= F.col("_id")))
    return F.when(row == 0, 0).otherwise((row - 1) * step + inside)


def with_next(rows: DataFrame, range_rows: int = RANGE_ROWS, add: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``rows`` (an integer ``_id`` and more columns) with ``_next``, a struct of the next row's columns in descending ``_id``; the last row's next is the first row.

    Rows are dealt into ranges of ids. A row's successor is the next row of its range; the
    first row of the following range stands at the end of a range as a copy, for its last row.
    The ranges of one id (null ids among them) are divided by a hash, which is their order.
    ``add`` gives the rows, and those copies, further columns; ranges are made without them.
    """
    own = ["_r", "_sub", "_tie"]
    n = rows.select("_id").count()
    d = rows.withColumn("_r", F.when(F.col("_id").isNull(), -1).otherwise(_range_of(rows.select("_id"), min(MAX_RANGES, -(-n // range_rows)))).cast("bigint"))
    d = d.withColumn("_tie", F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.monotonically_increasing_id()), 33))
    sizes = d.groupBy("_r").agg(F.count("*").alias("rows"), (F.min("_id").eqNullSafe(F.max("_id"))).alias("one_id")).collect()  # a row per range
    split = {r["_r"]: -(-r["rows"] // range_rows) for r in sizes if r["one_id"] and r["rows"] > 2 * range_rows}
    sub = F.lit(0).cast("bigint")
    for r, k in split.items():
        sub = F.when(F.col("_r") == r, F.floor(F.col("_tie") / F.lit(float(1 << 31)) * k)).otherwise(sub)
    d = d.withColumn("_sub", sub)
    d = d.select(*own, *rows.columns)
    key = [F.col("_id").desc_nulls_last(), F.col("_tie").desc()]
    firsts = d.withColumn("_rn", F.row_number().over(Window.partitionBy("_r", "_sub").orderBy(*key))).filter("_rn = 1").drop("_rn")
    firsts = written(firsts, "range-heads")  # a row per range
    at = Window.orderBy(F.col("_r").desc(), F.col("_sub").desc())
    follows = firsts.select("_r", "_sub", F.lead(F.struct("_r", "_sub")).over(at).alias("to"), F.first(F.struct("_r", "_sub")).over(at).alias("top"))
    follows = follows.select(F.col("_r").alias("_to_end_r"), F.col("_sub").alias("_to_end_sub"), F.coalesce("to", "top").alias("_to"))
    ends = firsts.join(follows, (F.col("_to._r") == F.col("_r")) & (F.col("_to._sub") == F.col("_sub")))
    ends = ends.select(F.col("_to_end_r").alias("_r"), F.col("_to_end_sub").alias("_sub"), "_tie", *rows.columns)

    def packed(df: DataFrame, end: bool) -> DataFrame:
        df = add(df)
        return df.select(*own, F.lit(end).alias("_end"), F.struct(*[c for c in df.columns if c not in own]).alias("_payload"))

    w = Window.partitionBy("_r", "_sub").orderBy("_end", F.col("_payload._id").desc_nulls_last(), F.col("_tie").desc())
    out = packed(d, False).unionByName(packed(ends, True)).withColumn("_next", F.lead("_payload").over(w))
    return out.filter(~F.col("_end")).select("_payload.*", "_next")


def near_report(docs: DataFrame, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE, range_rows: int = RANGE_ROWS,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_chars, the edited text's digest, both fingerprints, their likeness, and the likeness to the next document's.

    The edited text is the text with its last floor(n/2) code points replaced by the first
    as many (or all) of the next document in descending id.
    """
    lex = lexicon(docs, min_share, max_share, text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    d = with_next(rows, range_rows, lambda df: with_fingerprint(df, "_fp", "_text", lex))
    n = F.length("_text")
    k = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), n - k), F.substring(F.col("_next._text"), F.lit(1), k))
    d = d.select("_id", "_fp", n.cast("bigint").alias("n_chars"), F.col("_next._fp").alias("_next_fp"), edited.alias("_edited"))
    d = with_fingerprint(d, "edited_fingerprint", "_edited", lex)
    d = d.select("_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), F.col("_fp").alias("fingerprint"), "_next_fp", "edited_fingerprint")
    return d.select(F.col("_id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                    likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "_next_fp").alias("near_next"))
