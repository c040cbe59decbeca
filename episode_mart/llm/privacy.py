"""Personal data: fixed patterns, and information-theoretic sanitisation of terms that reveal them.

Every place of a base kind is a protected entity in a context of up to 80 characters on either side, base spans
blanked. The corpus is counted in units: a text has one for each context (equal contexts of an entity in one text
count once), or one if it has none; equal texts count once, so copies add no evidence. A term counts in every
context that holds it, or once in a text that holds it elsewhere only, so n(term) covers all texts, with entities or
without:

    certainty = n(term, entity) / (n(term) + 1)      how surely the term names the entity, smoothed by one unit
    gain      = log2(n(term, entity) * n / (n(term) * n(entity)))      bits learned about it

A term that stands near an entity with a gain of at least ``GAIN`` bits and a certainty of at least ``GENERALISE``
is generalised, from ``REMOVE`` on removed, in the whole text of every document that holds the entity. One unit is
enough evidence to generalise if the term is found nowhere else. Since that certainty is more than half of n(term),
a term reveals one entity at most. Terms are words of three or more letters or digits outside base spans.
Everything is SQL functions; counts are summed before they are shuffled, and joins are plain equality joins that
adaptive execution can split.

Defined cases: null and empty texts hold no spans; repeated rows get equal results; columns named like an
output are replaced. Rows are told apart by their key and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episode_mart.llm.common import keep
from episode_mart.llm.neardup import beyond, within
from episode_mart.llm.spans import labelled, let, places, rewrite

# The kinds in the order in which they are reported, and their patterns. Possessive
# quantifiers and the conditions on the first character change no match; they keep long runs linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

AROUND = 80
TERM = r"[\p{L}\p{N}]{3,}"
GAIN = 1.0
GENERALISE = 0.5
REMOVE = 0.7
PUT = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalise": "[TERM]", "remove": ""}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """True if the digits pass the check sum: from the right, every second one doubled, nines cast out."""
    def worth(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 0, n).otherwise(F.when(n > 4, 2 * n - 9).otherwise(2 * n))
    values = F.transform(F.split(F.reverse(digits), ""), worth)
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _base(body: Column) -> dict[str, Column]:
    def fits(s: Column) -> Column:
        return F.forall(F.split(s["value"], r"\."), lambda p: F.ltrim(p, F.lit("0")).cast("string").rlike(
            "^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return {
        "email": F.when(F.contains(body, F.lit("@")), places(body, EMAIL)).otherwise(places(F.lit(""), EMAIL)),
        "ip": F.filter(places(body, IP), fits),
        "card": F.filter(places(body, CARD), lambda s: _luhn(_digits(s["value"]))),
        "phone": F.filter(places(body, PHONE), lambda s: F.length(_digits(s["value"])).between(9, 15)),
    }


def _blanked(body: Column, found: Column) -> Column:
    """``body`` with blanks in place of the spans of one kind; all other places stay."""
    def one(s: Column, i: Column) -> Column:
        end = F.coalesce(F.get(found, i - 1)["end"], F.lit(0))
        return F.concat(F.substring(body, (end + 1).cast("int"), (s["start"] - end).cast("int")),
                        F.repeat(F.lit(" "), (s["end"] - s["start"]).cast("int")))
    end = F.get(found, F.size(found) - 1)["end"]
    return F.when(F.size(found) > 0, F.concat(F.array_join(F.transform(found, one), ""), F.substring(
        body, (end + 1).cast("int"), F.length(body)))).otherwise(body)


def _searched(rows: DataFrame) -> DataFrame:
    """``rows`` with the base spans of ``body``, and ``rest``: the text without them."""
    found = rows.select("*", *[c.alias(k) for k, c in _base(F.col("body")).items()], F.col("body").alias("rest"))
    for kind in KINDS:
        found = found.withColumn("rest", _blanked(F.col("rest"), F.col(kind)))
    return found


def _contexts(body: Column, rest: Column) -> Column:
    """(entity, context, terms) of every place of a base kind."""
    def of(kind: str) -> Column:
        def one(s: Column) -> Column:
            first = F.greatest(s["start"] - AROUND, F.lit(0))

            def sides(text: Column) -> tuple[Column, Column]:
                return (F.substring(text, (first + 1).cast("int"), (s["start"] - first).cast("int")),
                        F.substring(text, (s["end"] + 1).cast("int"), F.lit(AROUND)))
            left, right = sides(rest)
            # a word that the edge of the context cuts is not a term
            left = F.when(first > 0, F.regexp_replace(left, r"^[\p{L}\p{N}]+", "")).otherwise(left)
            right = F.when(F.length(right) == AROUND, F.regexp_replace(right, r"[\p{L}\p{N}]++$", "")).otherwise(right)
            return F.struct(F.concat(F.lit(f"{kind}:"), F.lower(s["value"])).alias("entity"),
                            F.xxhash64(*sides(body)).alias("context"), _terms(F.concat_ws(" ", left, right)).alias("terms"))
        return F.transform(kind, one)
    return F.concat(*[of(k) for k in KINDS])


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def disclosures(found: DataFrame, rows: DataFrame) -> DataFrame:
    """(entity, term, action) of all terms that reveal an entity; a term has one row at most.

    ``found`` has (text_hash, contexts) of every row of the corpus, ``rows`` its (text_hash, body).
    """
    contexts = found.where("contexts is not null").select("text_hash", F.explode("contexts").alias("c"))
    seen = contexts.select("text_hash", "c.entity", "c.context", F.explode("c.terms").alias("term")).distinct()
    units = contexts.select("text_hash", "c.entity", "c.context").distinct()
    near = seen.groupBy("text_hash", "term").agg(F.count("*").alias("m")).groupBy("term").agg(
        F.sum("m").alias("n_near"), F.sum(F.col("m") - 1).alias("n_more"))
    both = seen.groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    # contexts alone give the least n(term): other pairs cannot become certain by the rest of the corpus
    candidates = keep(both.join(near, "term").where(F.col("n_both") >= GENERALISE * (F.col("n_near") + 1)).select(
        "entity", "term", "n_both", "n_more"))
    hashes = found.groupBy("text_hash").agg(F.count("*").alias("rows"))
    repeated = keep(hashes.where("rows > 1").select("text_hash"))

    def wanted(some: DataFrame) -> DataFrame:
        words = _searched(some).select("text_hash", F.explode(_terms(F.col("rest"))).alias("term"))
        return within(words, candidates, "term")

    alone = wanted(beyond(rows, repeated, "text_hash")).select("term")
    copied = wanted(within(rows, repeated, "text_hash")).distinct().select("term")
    of_term = alone.unionAll(copied).groupBy("term").agg(F.count("*").alias("n_texts"))
    of_entity = units.groupBy("entity").agg(F.count("*").alias("n_entity"))
    of_text = units.groupBy("text_hash").agg((F.count("*") - 1).alias("more"))
    total = F.broadcast(hashes.agg(F.count("*").alias("n_all")).crossJoin(  # one row
        of_text.agg(F.coalesce(F.sum("more"), F.lit(0)).alias("more"))).select((F.col("n_all") + F.col("more")).alias("n")))
    n_term = F.col("n_texts") + F.col("n_more")
    rated = candidates.join(of_term, "term").join(of_entity, "entity").crossJoin(total).select(
        "entity", "term", (F.col("n_both") / (n_term + 1)).alias("certainty"),
        F.log2(F.col("n_both") * F.col("n") / (n_term * F.col("n_entity"))).alias("gain"))
    return rated.where((F.col("gain") >= GAIN) & (F.col("certainty") >= GENERALISE)).select(
        "entity", "term", F.when(F.col("certainty") >= REMOVE, "remove").otherwise("generalise").alias("action"))


def scan(docs: DataFrame, key: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """(key, text_hash, email, ip, card, phone, terms) of every row; ``terms`` are (start, end, action)."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*key, F.xxhash64(body).alias("text_hash"), body.alias("body"))
    any_found = sum(F.size(k) for k in KINDS) > 0
    found = keep(_searched(rows).select(
        *key, "text_hash", *KINDS, F.when(any_found, _contexts(F.col("body"), F.col("rest"))).alias("contexts"),
        F.when(any_found, F.col("rest")).alias("rest")))
    revealing = keep(disclosures(found, rows.select("text_hash", "body")))
    own = [F.col(k).alias(f"_{k}") for k in (*key, "text_hash")]
    names = [f"_{k}" for k in (*key, "text_hash")]
    held = found.where("contexts is not null")
    words = held.select(*own, F.explode(places(F.col("rest"), TERM)).alias("t")).select(
        *names, "t.start", "t.end", F.lower("t.value").alias("term"))
    entities = held.select("text_hash", F.explode("contexts.entity").alias("entity")).distinct()
    hits = within(words, revealing, "term").join(revealing, "term")
    terms = (hits.join(entities.withColumnRenamed("text_hash", "_text_hash"), ["_text_hash", "entity"], "left_semi")
             .groupBy(*names).agg(F.array_sort(F.collect_set(F.struct("start", "end", "action"))).alias("terms")))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*key, "text_hash")]
    joined = found.drop("contexts", "rest").join(terms, same, "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint,action:string>>")
    return joined.select(*key, "text_hash", *KINDS, F.coalesce("terms", none).alias("terms"))


def report(found: DataFrame) -> DataFrame:
    """``scan``'s arrays as counts, a digest of the base spans and the list of all spans."""
    base = F.concat(*[labelled(k, F.col(k)) for k in KINDS])
    terms = F.transform("terms", lambda t: F.concat_ws(":", t["action"], t["start"], t["end"]))
    return found.withColumns({
        **{f"n_{k}": F.size(k).cast("long") for k in KINDS}, "n_terms": F.size("terms").cast("long"),
        "base_sha256": F.sha2(F.array_join(base, ","), 256), "spans": F.array_join(F.concat(base, terms), ","),
    }).drop(*KINDS, "terms", "text_hash")


def sanitise(docs: DataFrame, key: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``docs`` with personal data and revealing terms replaced in their texts; all rows and columns stay."""
    found = scan(docs, key, text)

    def put(array: str, kind: Column | None = None) -> Column:
        def one(s: Column) -> Column:
            puts = F.lit(PUT[array]) if kind is None else F.when(s["action"] == "remove", PUT["remove"]).otherwise(
                PUT["generalise"])
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), puts.alias("put"))
        return F.transform(array, one)

    spans = F.concat(*[put(k) for k in KINDS], put("terms", F.lit(True)))
    own = found.select(*[F.col(k).alias(f"_{k}") for k in (*key, "text_hash")], spans.alias("_spans")).where(
        F.size("_spans") > 0).dropDuplicates([f"_{k}" for k in (*key, "text_hash")])
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))
    same = [(F.col("text_hash") if k == "text_hash" else F.col("row")[k]).eqNullSafe(F.col(f"_{k}"))
            for k in (*key, "text_hash")]
    new = F.when(F.col("_spans").isNotNull(), let(F.col("_spans"), lambda s: rewrite(F.col("row")[text], s)))
    return rows.join(own, same, "left").select(*[
        (F.coalesce(new, F.col("row")[text]) if c == text else F.col("row")[c]).alias(c) for c in docs.columns])
