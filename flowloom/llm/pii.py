"""Personal data: fixed patterns, and information-theoretic sanitisation of what surrounds them.

The patterns give the protected entities. A term discloses an entity as far as seeing the term tells
that the entity is near: their pointwise mutual information over the information content of the
entity, both from counts over the whole corpus. Terms over a threshold are masked in the documents
that hold the entity. Everything is DataFrame expressions.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import let, packed, query, running, sized, stored, table

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, written so that no start is tried inside a run that has failed already:
#: a match begins where the last one ended or where no run goes on, and runs are not given back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character without which a text has no match.
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}
IP_PARTS = r"^(?:0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"
#: Letters of scripts that part words, and of those that do not.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\u30FC\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
LETTER, UNSPACED = rf"[\p{{L}}\p{{M}}&&[^{UNSPACED}]]", f"[{UNSPACED}]"
#: What may become terms: words of three letters, or of two with a capital; every two letters of the other scripts.
TERM = rf"(?<!{LETTER})(?:{LETTER}{{3,}}+|\p{{Lu}}{LETTER})(?!{LETTER})"
PAIR = rf"(?=({UNSPACED}{{2}}))"
MARK, STAND_IN = "\x01", "\x02"
SPAN = "struct<start:int,end:int,value:string,near:string>"
#: Characters to a word, when the corpus is taken as places at which an entity could stand.
CHARS = 6
#: Candidate terms, and documents with terms to mask, up to which the tables are broadcast.
MOST_TERMS, MOST_DOCUMENTS = 200_000, 100_000


def _luhn(value: Column) -> Column:
    def passes(d: Column) -> Column:
        digit = lambda i: F.ascii(F.substring(d, F.length(d) - i + 1, F.lit(1))) - 48
        double = lambda n: n * 2 - F.when(n > 4, 9).otherwise(0)
        total = F.aggregate(
            F.sequence(F.lit(1), F.length(d)), F.lit(0),
            lambda acc, i: acc + F.when(i % 2 == 0, double(digit(i))).otherwise(digit(i)))
        return F.length(d).between(16, 19) & (total % 10 == 0)

    return let(F.regexp_replace(value, "[^0-9]", ""), passes)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(IP_PARTS)
    if kind == "card":
        return F.when(F.length(value) < 16, False).otherwise(_luhn(value))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _spans(text: Column, pattern: Column | str, needed: str | None, valid, width: int = 48) -> Column:
    """The matches of a pattern as ``start, end, value, near``, in order, code points counted from 0.

    The text is cut at marks put around each match. A mark that the text holds itself is first
    replaced by another control character; no pattern takes either.
    """
    safe = F.when(F.instr(text, MARK) > 0, F.replace(text, F.lit(MARK), F.lit(STAND_IN))).otherwise(text)
    cut = F.split(F.regexp_replace(safe, pattern, MARK + "$0" + MARK), MARK, -1)

    def located(parts: Column) -> Column:
        ends = running(F.transform(parts, F.length), "int", lambda a, b: a + b)

        def span(e: Column, i: Column) -> Column:
            before, after = F.get(parts, i - 1), F.get(parts, i + 1)
            # whole words only: what the cut has left of one is dropped
            left = F.when(F.length(before) > width, F.regexp_replace(F.right(before, F.lit(width)), f"^{LETTER}+", "")).otherwise(before)
            right = F.when(F.length(after) > width, F.regexp_replace(F.left(after, F.lit(width)), f"{LETTER}+$", "")).otherwise(after)
            return F.struct(
                F.get(e, i - 1).alias("start"), F.get(e, i).alias("end"), F.get(parts, i).alias("value"),
                F.concat(left, F.lit("\n"), right).alias("near"))

        places = F.filter(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), lambda i: valid(F.get(parts, i)))
        return let(ends, lambda e: F.transform(places, lambda i: span(e, i)))

    none = F.array().cast(f"array<{SPAN}>")
    spans = let(cut, lambda parts: F.when(F.size(parts) < 3, none).otherwise(located(parts)))
    return F.when(F.instr(text, needed) > 0, spans).otherwise(none) if needed else spans


def found(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row, doc_id, text`` and an array of spans per kind. Null text counts as empty."""
    out = packed(docs).select("row", F.col(f"row.`{doc_id}`").alias("doc_id"), F.coalesce(f"row.`{text}`", F.lit("")).alias("text"))
    return out.withColumns({k: _spans(F.col("text"), PATTERNS[k], NEEDED[k], partial(_valid, k)) for k in KINDS})


def _by_kind(kinds, of) -> Column:
    """``of(kind, span)`` of every span, kind after kind."""
    return F.concat(*[F.transform(k, (lambda k: lambda s: of(k, s))(k)) for k in kinds])


def _entities(spans: DataFrame) -> DataFrame:
    """``copy, long, entity, near``: one row per span; ``copy`` is a hash of the text, ``long`` its length. An entity is a kind and what is written, less case and separators."""
    plain = lambda k, v: F.lower(v) if k in ("email", "ip") else F.regexp_replace(v, "[^0-9]", "")
    each = _by_kind(KINDS, lambda k, s: F.struct(
        F.concat(F.lit(k + ":"), plain(k, s.getField("value"))).alias("entity"), s.getField("near").alias("near")))
    known = [F.xxhash64("text").alias("copy"), F.length("text").alias("long")]
    return spans.select(*known, F.explode(each).alias("e")).select("copy", "long", "e.entity", "e.near")


def _terms(text: Column) -> Column:
    """The candidate terms of a text as they are written, one for each occurrence."""
    pairs = F.when(text.rlike(UNSPACED), F.regexp_extract_all(text, F.lit(PAIR), F.lit(1))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), pairs)


def disclosing_terms(
    docs: DataFrame, threshold: float = 0.9, chance: float = 0.05, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``entity, term, disclosure``: terms that reveal an entity by ``threshold`` of its information or more.

    disclosure = PMI(entity; term) / IC(entity) = (log p(e | t) - log p(e)) / -log p(e), where p(e) is
    the share of the corpus's words that stand at e, and p(e | t) the share of t's occurrences that
    stand near e. Counts cover all documents. Copies are collapsed first: equal texts count once, and
    so do equal surroundings of an entity. Common words reveal nothing, however often they occur.

    A pair must not be one that chance brings about: of all terms as rare as t, fewer than ``chance``
    may be expected in as many surroundings of e as t is, if words stood at random places. How often
    e is seen is part of that: near an entity seen once, a term counts if the corpus has few words as
    rare; two surroundings do in nearly any corpus.
    """
    body = F.col(f"`{text}`")
    copies = docs.groupBy(F.xxhash64(F.coalesce(body, F.lit(""))).alias("of")).agg((1 / F.count("*")).alias("weight")).where("weight < 1")
    copies = sized(stored(copies, "pii-copies"), MOST_TERMS)
    weighted = lambda df: df.join(copies, F.col("copy") == F.col("of"), "left").withColumn("weight", F.coalesce("weight", F.lit(1.0))).drop("of")
    mentions = weighted(_entities(found(docs, doc_id, text))).withColumn("around", F.xxhash64("near"))
    mentions = stored(mentions.groupBy("entity", "around", "near").agg(F.sum("weight").alias("weight")), "pii-mentions")
    texts = weighted(docs.select(F.xxhash64(F.coalesce(body, F.lit(""))).alias("copy"), body.alias("text")))
    n_chars = texts.agg(F.sum(F.length("text") * F.col("weight"))).first()[0] or 0
    every = F.lit(float(max(n_chars // CHARS, 2)))
    # counted in each task before anything else, so that no later step sees single occurrences
    each = texts.select("weight", F.explode(_terms(F.col("text"))).alias("term"))
    counts = each.groupBy(F.xxhash64(F.lower("term")).alias("key")).agg(F.round(F.sum("weight")).cast("long").alias("n_term"))
    counts = stored(counts, "pii-counts")
    # what addresses themselves are made of stands at an entity, not near one
    parts = mentions.where("entity like 'email:%'").select("weight", F.explode(_terms(F.substring("entity", 7, 1 << 20))).alias("term"))
    inside = parts.groupBy(F.xxhash64("term").alias("key")).agg(F.round(F.sum("weight")).cast("long").alias("inside"))

    near = mentions.select("entity", "around", "weight", F.explode(_terms(F.col("near"))).alias("term")).withColumn("term", F.lower("term"))
    near = near.groupBy("entity", "term", "around").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    together = stored(near.groupBy("entity", "term").agg(
        F.sum("n").alias("together"), F.sum("weight").alias("copied"), F.count("*").alias("surroundings")), "pii-together")
    held = mentions.groupBy("entity").agg(F.log(F.least(F.lit(0.5), F.count("*") / every)).alias("alone"))
    held = held.join(together.groupBy("entity").agg(F.sum("together").alias("room")), "entity")
    disclosure = lambda given: (F.log(F.least(F.lit(1.0), given)) - F.col("alone")) / -F.col("alone")
    # Occurrences of the term, with equal surroundings of the entity as one.
    single = lambda n: F.greatest(F.col("together"), n - F.col("copied") + F.col("together"))
    # A term occurs at least half as often as it stands near entities, since one place has two at most
    # of a kind; pairs that could not reach the threshold even so need no count of the term.
    spread = together.groupBy("term").agg(F.sum("copied").alias("spread"))
    pairs = together.join(spread, "term").join(held, "entity").where(disclosure(F.col("together") / single(F.col("spread") / (2 * len(KINDS)))) >= threshold)
    pairs = stored(pairs.drop("spread").withColumn("key", F.xxhash64("term")), "pii-pairs")
    wanted = sized(pairs.select("key").distinct(), MOST_TERMS)
    outside = counts.join(wanted, "key", "left_semi").join(inside, "key", "left").withColumn("n_term", F.col("n_term") - F.coalesce("inside", F.lit(0)))
    out = pairs.join(outside, "key").withColumn("n_term", single(F.col("n_term")))
    # Occurrences of terms with up to 1, 2, 4, 8, ... of them.
    places, total = [], 0
    power = lambda n: F.ceil(F.log2(n)).cast("int")
    by_power = {r["power"]: r["n"] for r in counts.where("n_term > 0").groupBy(power(F.col("n_term")).alias("power")).agg(F.sum("n_term").alias("n")).collect()}
    for k in range(64):
        total += by_power.get(k, 0)
        places.append(float(max(total, 1)))
    k = F.col("surroundings")
    ways = F.greatest(F.log(F.factorial(F.least(k, F.lit(20)).cast("int"))), k * F.log(k) - k)
    # sum over the terms of (their occurrences * share of all terms that stand near e) ^ k / k!, which
    # is at least the expected number
    by_chance = F.log(F.get(F.lit(places), power("n_term"))) + (k - 1) * F.log("n_term") + k * F.log(F.col("room") / max(total, 1)) - ways
    out = out.withColumn("disclosure", disclosure(F.col("together") / F.col("n_term")))
    return out.where((F.col("disclosure") >= threshold) & (by_chance < F.log(F.lit(float(chance))))).select("entity", "term", "disclosure")


def personal_data(
    docs: DataFrame, threshold: float = 0.9, chance: float = 0.05, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` in a struct ``row``, with arrays of spans ``email, ip, card, phone, term``.

    Null and empty texts have no spans. Kinds may overlap each other; within a kind spans do not.
    Each row is masked by the entities of its own text, whatever its id: equal texts have the same
    terms. An empty table gives no rows.
    """
    spans = found(docs, doc_id, text)
    terms = stored(disclosing_terms(docs, threshold, chance, doc_id, text).select("entity", "term"), "pii-terms")
    none = F.array().cast(f"array<{SPAN}>")
    if terms.isEmpty():
        return spans.withColumn("term", none)
    # a text is known by a 64-bit hash and its length; few texts hold an entity that has terms
    held = _entities(spans).select("copy", "long", "entity").join(sized(terms, MOST_TERMS), "entity")
    by_text = held.groupBy(F.col("copy").alias("of"), F.col("long").alias("of_long")).agg(F.array_sort(F.collect_set("term")).alias("terms"))
    by_text = sized(stored(by_text, "pii-texts"), MOST_DOCUMENTS)
    same = (F.xxhash64("text") == F.col("of")) & (F.length("text") == F.col("of_long"))
    joined = spans.join(by_text, same, "left").drop("of", "of_long")
    # words as a whole; of the other scripts, all letters under a term
    one_of = lambda kind: F.array_join(F.filter("terms", lambda t: t.rlike(f"^{UNSPACED}") if kind else ~t.rlike(f"^{UNSPACED}")), "|")
    words = F.when(one_of(False) != "", F.concat(F.lit(f"(?<!{LETTER})(?:"), one_of(False), F.lit(f")(?!{LETTER})")))
    runs = F.when(one_of(True) != "", F.concat(F.lit("(?:(?="), one_of(True), F.lit(f"){UNSPACED})+{UNSPACED}")))
    pattern = F.concat(F.lit("(?iu)"), F.concat_ws("|", words, runs))
    masked = _spans(F.col("text"), pattern, None, lambda v: F.lit(True))
    return joined.withColumn("term", F.when(F.size("terms") > 0, masked).otherwise(none)).drop("terms")


#: Code points of the blocks that a text is cut into where many places of it are looked up.
BLOCK = 2048


def _replaced(text: Column, spans: Column) -> Column:
    """``text`` with sorted spans of ``start, -end, by`` replaced: by the first of those that overlap.

    What stays is read from blocks of the text, since to find a place means to count from the beginning.
    """
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    reached = running(F.transform(spans, lambda s: -s.getField("end")), "int", F.greatest)

    def between(cut: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
        own = F.array_join(F.slice(cut, first + 1, last - first + 1), "")
        return F.when(b > a, F.substring(own, a - first * BLOCK + 1, b - a)).otherwise("")

    def pieces(cut: Column, ends: Column) -> Column:
        before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        shown = F.transform(spans, lambda s, i: F.when(
            s.getField("start") >= before(i), F.concat(between(cut, before(i), s.getField("start")), s.getField("by"))).otherwise(""))
        return F.concat(F.array_join(shown, ""), between(cut, F.get(ends, F.size(ends) - 1), F.length(text)))

    return let(blocks, lambda cut: let(reached, lambda ends: pieces(cut, ends)))


def sanitised(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", **settings) -> DataFrame:
    """The rows of ``docs`` with every span replaced by its kind in brackets: a general term in place of it.

    Of overlapping spans the first, and the longer of two that begin together, names the
    replacement; the rest of the others goes too. ``n_chars`` follows the text where it exists.
    """
    spans = personal_data(docs, text=text, **settings)
    every = F.array_sort(_by_kind((*KINDS, "term"), lambda k, s: F.struct(
        s.getField("start").alias("start"), (-s.getField("end")).alias("end"), F.lit(f"[{k.upper()}]").alias("by"))))
    out = spans.withColumn("every", every)
    out = out.withColumn("clean", F.when(F.size("every") > 0, _replaced(F.col("text"), F.col("every")))).withColumn("every", F.size("every"))
    fields = []
    for c in docs.columns:
        old = F.col("row").getField(c)
        if c == text:
            old = F.when(F.col("every") > 0, F.col("clean")).otherwise(old)
        elif c == n_chars:
            old = F.when(F.col("every") > 0, F.length("clean")).otherwise(old).cast(docs.schema[c].dataType)
        fields.append(old.alias(c))
    return out.select(*fields)


@query("op10_sanitise")
def op10_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data(table(spark, sf_dir, "documents"))
    written = lambda kinds: F.array_join(_by_kind(kinds, lambda k, s: F.concat_ws(":", F.lit(k), s.getField("start"), s.getField("end"))), ",")
    return out.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(written(KINDS), 256).alias("base_sha256"), written((*KINDS, "term")).alias("spans"))
