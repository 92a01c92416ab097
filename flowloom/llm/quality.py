"""Quality rules: distribution divergence from language references.

Each language's reference is the histogram of character classes and of common words over all of
its documents. A document is compared with the reference of its language, or with the nearest one
where its language is unknown, by the Jensen-Shannon distance. Short documents are not compared.
Everything is DataFrame expressions; array lambdas stand where a word list has to be walked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import GAP, GAP_CHARS, let, packed, query, sized, stored, table, words

#: Frequent function words of four languages.
COMMON_WORDS = (
    # English
    "the of and to in is that it for on with as by are was this be at from or "
    # French
    "le la les de des du et en un une est que qui dans pour par sur avec au ce "
    # German
    "der die das und in zu den von mit im ist nicht sich auf ein eine dem auch als es "
    # Spanish
    "el los las que y un una por con para del se no su al lo como es en "
).split()
COMMON = sorted(set(COMMON_WORDS))

#: Languages up to which the references are broadcast.
MOST_LANGUAGES = 10_000
#: Character classes, each counted on what the ones before it have left.
CLASSES = (
    ("lower", r"[a-z]+"), ("space", GAP), ("upper", r"[A-Z]+"), ("letter", r"\p{L}+"), ("digit", r"\p{Nd}+"),
    ("stop", r"[.,;:!?'\"()-]+"),
)


def _classes(df: DataFrame, text: str = "text") -> DataFrame:
    """``text`` replaced by its length, a count per character class, and what no class took."""
    left, out = F.col(text), df
    for name, pattern in CLASSES:
        out = out.withColumn(f"left_{name}", F.regexp_replace(left, pattern, ""))
        left = F.col(f"left_{name}")
    sizes, before = [], F.length(text)
    for name, _ in CLASSES:
        sizes.append((before - F.length(f"left_{name}")).cast("long"))
        before = F.length(f"left_{name}")
    return out.withColumn("classes", F.array(*sizes, before.cast("long"))).withColumn(
        "n_symbols", (before - F.length(F.translate(left, "#*$%&|<>", ""))).cast("long"))


def _repeated(ws: Column) -> Column:
    """Words in three-word windows found twice or more in the array.

    Windows are compared by a 64-bit hash within one text.
    """
    starts = F.sequence(F.lit(0), F.size(ws) - 3)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))

    def covered(hs: Column) -> Column:
        by_hash = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeats(s: Column) -> Column:
            same = lambda j, k: F.get(s, j).getField("h") == F.get(s, k).getField("h")
            places = F.filter(starts, lambda j: F.coalesce(same(j, j + 1), F.lit(False)) | F.coalesce(same(j, j - 1), F.lit(False)))
            return F.sort_array(F.transform(places, lambda j: F.get(s, j).getField("i")))

        total = lambda places: F.aggregate(
            places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda acc, p: F.struct((acc.getField("n") + F.least(F.lit(3), p - acc.getField("last"))).alias("n"), p.alias("last")),
            lambda acc: acc.getField("n"))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), 0).otherwise(let(let(by_hash, repeats), total))

    return F.when(F.size(ws) < 3, 0).otherwise(let(hashes, covered)).cast("long")


def _divergence(p: Column, q: Column) -> Column:
    """One term of the Jensen-Shannon divergence, in bits."""
    middle = (p + q) / 2
    term = lambda x: F.when(x > 0, x * F.log2(x / middle)).otherwise(0.0)
    return (term(p) + term(q)) / 2


def _distance(total: Column) -> Column:
    return F.sqrt(F.when(total > 0, total).when(total.isNotNull(), 0.0))


def _common(text: str) -> Column:
    """The common words of a text, sorted."""
    return F.sort_array(F.filter(words(F.lower(text)), lambda w: w.isin(COMMON)))


def language_references(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, ref_classes, ref_words``: shares of character classes, and of each common word.

    Covers every document with a language. Counts are added up before anything is shuffled.
    """
    source = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.col(f"`{lang}`").alias("lang")).where("lang is not null")
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES) + 1)]
    classes = _classes(source).groupBy("lang").agg(*sums)
    total = sum((F.col(f"c{i}") for i in range(len(CLASSES) + 1)), F.lit(0))
    classes = classes.select("lang", F.array(*[F.coalesce(F.try_divide(F.col(f"c{i}"), total), F.lit(0.0)) for i in range(len(CLASSES) + 1)]).alias("ref_classes"))
    each = source.select("lang", F.explode(words(F.lower("text"))).alias("word"))
    counts = each.groupBy("lang", F.when(F.col("word").isin(COMMON), F.col("word")).otherwise("").alias("word")).agg(F.count("*").alias("n"))
    shares = counts.groupBy("lang").agg(
        F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("word", F.col("n").cast("double")))).alias("n"))
    shares = shares.select("lang", F.transform_values("n", lambda k, v: v / F.col("all")).alias("ref_words"))
    return classes.join(shares, "lang", "left")


def quality(
    docs: DataFrame, references: DataFrame | None = None, max_class_distance: float = 0.25,
    max_word_distance: float = 0.3, min_chars: int = 200, min_words: int = 100,
    doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
) -> DataFrame:
    """The rows of ``docs`` in a struct ``row``, their counts, distances and verdict.

    Columns: ``row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    class_distance, word_distance, kept``. Null text counts as empty. A distance is null, and
    nobody is rejected for it, where the text has fewer than ``min_chars`` characters or ``min_words``
    words, or where no reference exists. A language that is null or has no reference is compared with
    the nearest reference. Every row of ``docs`` gives one row, repeated rows too.
    """
    if references is None:
        references = language_references(docs, text, lang)
    references = stored(references, "language-references")
    lists = references.agg(F.collect_list(F.struct("ref_classes", "ref_words")).alias("refs"))
    known = sized(references.select(F.col("lang").alias("of"), F.array(F.struct("ref_classes", "ref_words")).alias("own")), MOST_LANGUAGES)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.col(f"`{lang}`").alias("lang"))
    rows = rows.join(known, F.col("lang") == F.col("of"), "left").drop("of")
    nearest = lists.first()["refs"] or []
    rows = rows.withColumn("refs", F.coalesce("own", _literal(nearest)))
    line = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORDY))
    rows = _classes(rows).withColumns({
        "n_dup_lines": F.when(F.instr("text", "\n") == 0, 0).otherwise(let(line, lambda x: F.size(x) - F.size(F.array_distinct(x)))).cast("long"),
        "counts": let(words(F.col("text")), lambda ws: F.struct(F.size(ws).cast("long").alias("n"), _repeated(ws).alias("r"))),
        "common": F.when(F.length("text") >= min_words, _common("text")),
    })
    rows = rows.withColumns({
        "n_words": F.col("counts.n"), "n_repeat_words": F.col("counts.r"), "chars": F.length("text"),
        "word_chars": (F.length("text") - F.get("classes", F.lit(1))).cast("long"),
    })
    by_class = lambda ref: F.aggregate(F.zip_with(F.col("classes"), ref.getField("ref_classes"), lambda n, q: _divergence(n / F.col("chars"), q)), F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("class_distance", F.when(
        F.col("chars") >= min_chars, _distance(F.array_min(F.transform("refs", by_class)))))
    rows = rows.withColumn("ends", F.filter(F.sequence(F.lit(1), F.greatest(F.size("common"), F.lit(1))), lambda i: F.get("common", i - 1).isNotNull() & ~F.coalesce(F.get("common", i) == F.get("common", i - 1), F.lit(False))))
    rows = rows.withColumn("bins", F.transform("ends", lambda end, k: F.struct(
        F.get("common", end - 1).alias("word"), ((end - F.coalesce(F.get("ends", k - 1), F.lit(0))) / F.col("n_words")).alias("p"))))
    rows = rows.withColumn("other", 1 - F.size("common") / F.col("n_words"))

    def by_words(ref: Column) -> Column:
        share = lambda word: F.coalesce(F.element_at(ref.getField("ref_words"), word), F.lit(0.0))
        # A word that the document lacks adds half its share in the reference.
        return F.aggregate(
            "bins", _divergence(F.col("other"), share(F.lit(""))) + (1 - share(F.lit(""))) / 2,
            lambda acc, x: acc + _divergence(x.getField("p"), share(x.getField("word"))) - share(x.getField("word")) / 2)

    rows = rows.withColumn("word_distance", F.when(
        F.col("n_words") >= min_words, _distance(F.array_min(F.transform("refs", by_words)))))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    far = (F.coalesce("class_distance", F.lit(0.0)) > max_class_distance) | (F.coalesce("word_distance", F.lit(0.0)) > max_word_distance)
    # A filter on the verdict must not be pushed down: it would repeat every step before it, many times over.
    here = F.monotonically_increasing_id() >= 0
    return rows.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "class_distance", "word_distance", (~F.col("base_failed") & ~far & here).alias("kept"))


WORDY = r"[^\x20\x09-\x0D]"


def _literal(references: list) -> Column:
    """The references as a constant array: one entry per language, each of a fixed number of shares."""
    kind = "array<struct<ref_classes:array<double>,ref_words:map<string,double>>>"
    if not references:
        return F.lit(None).cast(kind)
    entry = lambda r: F.struct(
        F.array(*[F.lit(x) for x in r["ref_classes"]]).alias("ref_classes"),
        F.create_map(*[F.lit(x) for kv in sorted((r["ref_words"] or {"": 0.0}).items()) for x in kv]).alias("ref_words"))
    return F.array(*[entry(r) for r in references]).cast(kind)


def quality_filter(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged."""
    return quality(docs, **settings).where("kept").select("row.*")


@query("op1_divergence")
def op1_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
