"""Document fingerprints by I-Match with randomised lexicons (operator 11).

1. Document frequencies of all terms (words, A-Z in lower case) over the whole
   corpus.  The lexicon is the terms whose share of documents lies in a band of inverse
   document frequency: common words say little, rare ones are slips.  A term of the band
   is in more than a share `low` of all documents, so the lexicon has at most
   (mean distinct terms of a document) / low terms, however many documents there are.
2. Every term of the lexicon belongs to some of SUBSETS random sub-lexicons, by bytes of
   its SHA-256; the first ones take an eighth of all terms, the last a 256th, so that
   short and long documents both have sub-lexicons that see a few of their terms.
3. A document's distinct terms that the lexicon has are sorted; the digest of all of them is
   the first component of its fingerprint, the digests of those of each
   sub-lexicon are the others ('--------' where it has none).  Likeness of two fingerprints is
   the share of equal components among those that either of them has.

Documents follow one another by id.  They are dealt out by ranges of ids of about equal
size; the first document of a range also goes, as a guest, to the range before, so that each
has its next one beside it after the only shuffle of texts.  All later steps keep that
partitioning.  Only DataFrame functions are used.

Results for odd input: a null text counts as empty; rows without an id are left out;
rows that share an id follow one another by their text, and repeated rows count each;
a single row is its own next; a text without terms of the lexicon has the digest of its lower-cased text
as the only component, so all empty texts are alike and no two other such texts are unless equal;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redraft.llm import textblocks as tb
from redraft.llm.components import Tables

#: Share of documents that a term must exceed, and may not exceed, to be in the lexicon: the band of inverse document frequency from ln 50 to ln 1000.
LOW, HIGH = 0.001, 0.02
#: Sub-lexicons, and of each the share of terms in 256ths.
SHARES = [32] * 4 + [8] * 8 + [2] * 10 + [1] * 10
#: Lexicons up to so many terms are broadcast (some 100 MB); beyond that, which takes documents of thousands of distinct terms on average, terms meet the lexicon by a shuffle.
MOST_BROADCAST = 1_000_000
#: Ranges of ids for each shuffle partition, so that their sizes even out.
RANGES = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EMPTY = "--------"


def terms(text: Column) -> Column:
    """Distinct words of a text with A-Z in lower case."""
    return F.array_remove(F.array_distinct(F.split(F.translate(text, UPPER, LOWER), r"[\x20\x09-\x0D]+")), "")


def lexicon(texts: DataFrame, n_docs: int, low: float = LOW, high: float = HIGH, shares: list[int] | None = None) -> DataFrame:
    """(term, subsets): the terms whose document frequency lies in the band, and as bits the sub-lexicons that they belong to."""
    shares = SHARES if shares is None else shares
    counts = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    kept = counts.where((F.col("n") > low * n_docs) & (F.col("n") <= high * n_docs)).select("term", F.sha2("term", 256).alias("h"))
    within = lambda j, share: F.substring("h", 2 * j + 1, 2) < f"{share:02x}" if share < 256 else F.lit(True)
    bits = [F.when(within(j, share), F.lit(1 << j)).otherwise(F.lit(0)) for j, share in enumerate(shares)]
    mask = bits[0].cast("long")
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit.cast("long"))
    return kept.select("term", mask.alias("subsets"))


def range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the value, by bisection."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>")  # one literal, however many bounds
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(table, at + step - 1) <= value), at + step).otherwise(at))


def fingerprint(found: Column, own: Column, n_subsets: int) -> Column:
    """The components of sorted (term, subsets) in one text; own stands for the first one where there are none."""
    digest = lambda x: F.substring(F.md5(F.array_join(F.transform(x, lambda y: y["term"]), " ")), 1, 8)
    part = lambda j: F.filter(found, lambda x: F.getbit(x["subsets"], j) == 1)
    component = lambda j: F.transform(F.array(part(j)), lambda x: F.when(F.size(x) == 0, EMPTY).otherwise(digest(x)))[0]
    whole = F.when(F.size(found) == 0, own).otherwise(digest(found))
    return F.concat(whole, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n_subsets - 1)), component), ""))


def likeness(a: Column, b: Column, n_subsets: int) -> Column:
    """Share of equal components among those that either fingerprint has."""
    pair = lambda j: F.struct(F.substring(a, 8 * j + 1, 8).alias("a"), F.substring(b, 8 * j + 1, 8).alias("b"))
    pairs = F.filter(F.transform(F.sequence(F.lit(0), F.lit(n_subsets)), pair), lambda p: (p["a"] != EMPTY) | (p["b"] != EMPTY))
    return F.transform(F.array(pairs), lambda ps: F.size(F.filter(ps, lambda p: p["a"] == p["b"])) / F.size(ps))[0]


def neighbours(docs: DataFrame) -> DataFrame:
    """(bucket, no, guest, doc_id, text, next_text) of (doc_id, text), dealt out by ranges of ids and numbered in their order; guests are the first of the range behind."""
    spark = docs.sparkSession
    count = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = F.lit([(i + 1) / count for i in range(count - 1)])
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 100 * count).alias("b")).first()["b"] or []))
    at = range_of(F.col("doc_id"), bounds)
    firsts = docs.groupBy(at.alias("bucket")).agg(F.min("doc_id").alias("first"))  # a row for each range, so windows over all of them are small
    guests = firsts.select("first", F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.max("bucket").over(Window.partitionBy(F.lit(0)))).alias("before"))
    seat = lambda bucket, guest: F.struct(bucket.alias("bucket"), F.lit(guest).alias("guest"))
    seats = F.when(F.col("before").isNull(), F.array(seat(at, False))).otherwise(F.array(seat(at, False), seat(F.col("before"), True)))
    rows = docs.join(F.broadcast(guests), F.col("doc_id") == F.col("first"), "left").select("doc_id", "text", F.explode(seats).alias("seat"))
    order = Window.partitionBy("bucket").orderBy("guest", "doc_id", "text")
    return rows.select("seat.bucket", "seat.guest", "doc_id", "text").select("*", F.row_number().over(order).alias("no"), F.lead("text").over(order).alias("next_text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH, shares: list[int] | None = None) -> DataFrame:
    """One row per row of docs that has an id, with its fingerprint and that of its edited text.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next document's, by ascending id; after the last comes the first.
    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).
    """
    shares = SHARES if shares is None else shares
    tables = Tables(docs.sparkSession, "imatch")
    docs = tb.keyed(docs, id_col, text_col)
    words = tables.saved(lexicon(docs, docs.count(), low, high, shares))
    if words.count() <= MOST_BROADCAST:
        words = F.broadcast(words)

    n, cut = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = F.when(~F.col("guest"), F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)))
    rows = neighbours(docs).select("bucket", "no", "guest", "doc_id", n.alias("n_chars"), "text", edited.alias("edited"))
    # one row for each distinct term of either text; the first of each text, an empty one, carries the columns
    texts = F.array(F.struct(F.lit(False).alias("late"), F.col("text").alias("text")), F.struct(F.lit(True).alias("late"), F.col("edited").alias("text")))
    told = rows.select("bucket", "no", "guest", "doc_id", "n_chars", F.explode(texts).alias("t")).where("t.text is not null")
    told = told.select("bucket", "no", "guest", "doc_id", "n_chars", "t.late", F.col("t.text").alias("t"))
    all_terms = F.concat(F.array(F.lit("")), terms(F.col("t")))
    each = told.select("bucket", "no", "guest", "doc_id", "n_chars", "late", "t", F.posexplode(all_terms).alias("at", "term"))
    head = lambda c: F.when(F.col("at") == 0, c)
    own = F.substring(F.md5(F.translate("t", UPPER, LOWER)), 1, 8)
    each = each.select("bucket", "no", "late", "term", head(F.col("guest")).alias("guest"), head(F.col("doc_id")).alias("doc_id"), head(F.col("n_chars")).alias("n_chars"), head(own).alias("own"), F.when(F.col("late") & (F.col("at") == 0), F.sha2("t", 256)).alias("sha"))
    met = each.join(words, "term", "left").where("subsets is not null or doc_id is not null")
    term = F.struct("term", "subsets")
    seen = F.col("subsets").isNotNull()
    own_of = lambda late: F.max(F.when(F.col("late") == late, F.col("own")))
    terms_of = lambda late: F.array_sort(F.collect_list(F.when(seen & (F.col("late") == late), term)))
    docs_met = met.groupBy("bucket", "no").agg(
        F.max("doc_id").alias("doc_id"), F.max("guest").alias("guest"), F.max("n_chars").alias("n_chars"), F.max("sha").alias("edited_sha256"),
        own_of(False).alias("own"), own_of(True).alias("edited_own"), terms_of(False).alias("found"), terms_of(True).alias("edited_found"),
    )
    k = len(shares)
    prints = docs_met.select("bucket", "no", "guest", "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", fingerprint(F.col("found"), F.col("own"), k).alias("fingerprint"), fingerprint(F.col("edited_found"), F.col("edited_own"), k).alias("edited_fingerprint"))
    after = F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("no"))
    placed = prints.select("*", after.alias("next_fingerprint")).where(~F.col("guest"))
    return tables.last(placed.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), k).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint"), k).alias("near_next"),
    ))
