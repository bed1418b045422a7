"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

A text's terms are its words (runs of characters that aren't ASCII white space), weighted by their counts. Sample k
draws for each term, from hashes of the term and k, r and c from Gamma(2, 1) and b from [0, 1); a term of weight w has
t = floor(ln w / r + b) and a = c / exp(r (t - b + 1)), and the sample is the (term, t) of the smallest a. Two texts
agree on a sample with a chance that equals their generalised Jaccard similarity, sum of min weights over
sum of max weights, so the share of equal samples estimates it.

Documents are dealt by ranges of ``doc_id`` (bounds are quantiles). The first row of a range also goes to the
range before, and the table's first row to the last, so that a window finds every row's next one inside its range. A
text and its edited text share their beginning up to the last white space before the edit: these words are
counted and drawn once for both.

Nulls: a null text is an empty one; texts without a word have the fingerprint of the empty term. Null ids come
first. Rows that share an id are documents of their own, ordered by text. Only ``doc_id`` and ``text`` are read. An
empty table gives no rows. The next document of the only one is itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, table

#: Samples of a fingerprint, and how many of them one row works out (few, so that the generated code stays compilable).
SAMPLES, EACH = 32, 2
_SPACE = r"[\x20\x09-\x0D]+"
_STEP = 1 << 20


def _ranges(docs: DataFrame, n: int) -> tuple[list[int], int | None]:
    """Bounds of ``n`` ranges of ids, and the first id (null if there is a null id)."""
    shares = ",".join(str(i / n) for i in range(1, n)) or "0.5"
    found = docs.agg(F.expr(f"percentile_approx(doc_id, array({shares}), 20000)").alias("q"), F.min("doc_id").alias("low"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    low = None if found["nulls"] else found["low"]
    return sorted(set(found["q"] or []) - {low}), low


def _with_next(docs: DataFrame) -> DataFrame:
    """(bucket, pos, late, doc_id, text, next_text): rows in order within their range; late rows belong to the next one."""
    bounds, low = _ranges(docs, 4 * shuffle_partitions(docs.sparkSession))
    cuts = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    steps = [1 << s for s in reversed(range(max(1, len(bounds)).bit_length()))]
    at = F.coalesce(  # number of bounds up to the id, by halving steps
        F.aggregate(
            F.array(*map(F.lit, steps)),
            F.lit(0),
            lambda n, s: n + F.when((n + s <= len(bounds)) & (F.get(cuts, n + s - 1) <= F.col("doc_id")), s).otherwise(0),
        ),
        F.lit(0),
    )
    first = F.col("doc_id").eqNullSafe(F.lit(low).cast("long"))
    begins = (F.col("bucket") > 0) & (F.get(cuts, F.col("bucket") - 1) == F.col("doc_id"))
    place = lambda bucket, late: F.struct(bucket.cast("int").alias("to"), F.lit(late).alias("late"))
    places = F.concat(
        F.array(place(F.col("bucket"), False)),
        F.when(begins, F.array(place(F.col("bucket") - 1, True))).otherwise(F.array().cast("array<struct<to:int,late:boolean>>")),
        F.when(first, F.array(place(F.lit(len(bounds)), True))).otherwise(F.array().cast("array<struct<to:int,late:boolean>>")),
    )
    dealt = docs.withColumn("bucket", at).select("doc_id", "text", F.inline(places)).withColumnRenamed("to", "bucket")
    order = Window.partitionBy("bucket").orderBy("late", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.withColumn("pos", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order))


def _uniform(h: Column, shift: int) -> Column:
    """(0, 1] from 21 bits of a hash."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND((1 << 21) - 1) + 1) / F.lit(float(1 << 21))


def _draws(k: Column) -> Column:
    """r, ln c, b and an identity of sample ``k`` of ``term``."""
    h = F.xxhash64("term", k)
    g = F.xxhash64(h)
    r = -F.ln(_uniform(h, 0) * _uniform(h, 21))
    ln_c = F.ln(-F.ln(_uniform(g, 0) * _uniform(g, 21)) + F.lit(1e-12))
    return F.struct((r + F.lit(1e-9)).alias("r"), ln_c.alias("c"), (_uniform(g, 42) - F.lit(1 / (1 << 21))).alias("b"), h.alias("h"))


def _sample(d: str, ln_w: str) -> Column:
    """ln a in the high half and 32 bits of (term, t) in the low half, so that the least is the sample."""
    r, c, b, h = (F.col(f"{d}.{x}") for x in "rcbh")
    t = F.floor(F.col(ln_w) / r + b)
    a = F.floor((c - r * (t - b + 1)) * _STEP)
    name = F.shiftrightunsigned(h.bitwiseXOR(t * 2654435769), 12).bitwiseAND(0xFFFFFFFF)
    return F.when(F.col(ln_w).isNotNull(), F.shiftleft(a, 32).bitwiseOR(name))


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; see the module's text."""
    rows = _with_next(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, n_chars - cut)"), F.expr("substring(next_text, 1, cut)"))
    rows = rows.withColumn("n_chars", n).withColumn("cut", cut).withColumn("next_text", F.coalesce("next_text", F.lit("")))
    rows = rows.withColumn("edited", edited)
    about = rows.select("bucket", "pos", "late", "doc_id", F.col("n_chars").cast("long"), F.sha2("edited", 256).alias("edited_sha256"))

    kept = F.regexp_extract(F.expr("substring(text, 1, n_chars - cut)"), r"(?s)^(.*[\x20\x09-\x0D])", 1)
    part = lambda seg, body, blank: F.struct(F.lit(seg).alias("seg"), body.alias("body"), F.lit(blank).alias("blank"))
    blank_of = lambda c: ~F.col(c).rlike(r"[^\x20\x09-\x0D]")
    none = F.array().cast("array<struct<seg:int,body:string,blank:boolean>>")
    parts = F.concat(
        F.array(part(0, F.col("kept"), False), part(1, F.expr("substring(text, length(kept) + 1)"), False), part(2, F.expr("substring(edited, length(kept) + 1)"), False)),
        F.when(blank_of("text"), F.array(part(1, F.lit(""), True))).otherwise(none),
        F.when(blank_of("edited"), F.array(part(2, F.lit(""), True))).otherwise(none),
    )
    words = rows.withColumn("kept", kept).select("bucket", "pos", F.inline(parts)).select("bucket", "pos", "seg", "blank", F.explode(F.split("body", _SPACE)).alias("word")).filter("word != '' or blank")
    terms = words.select("bucket", "pos", F.xxhash64("word").alias("term"), (F.col("seg") < 2).cast("long").alias("own"), (F.col("seg") != 1).cast("long").alias("other"))
    terms = terms.groupBy("bucket", "pos", "term").agg(F.sum("own").alias("own"), F.sum("other").alias("other"))
    ln_of = lambda c: F.when(F.col(c) > 0, F.ln(F.col(c).cast("double")))
    terms = terms.select("bucket", "pos", "term", ln_of("own").alias("own"), ln_of("other").alias("other"), F.explode(F.sequence(F.lit(0), F.lit(SAMPLES - 1), F.lit(EACH))).alias("k"))
    drawn = terms.select("bucket", "pos", "k", "own", "other", *(_draws(F.col("k") + i).alias(f"d{i}") for i in range(EACH)))
    keys = drawn.select("bucket", "pos", "k", *(_sample(f"d{i}", w).alias(f"{w}{i}") for w in ("own", "other") for i in range(EACH)))
    least = keys.groupBy("bucket", "pos", "k").agg(*(F.min(f"{w}{i}").alias(f"{w}{i}") for w in ("own", "other") for i in range(EACH)))
    hexed = lambda w: F.concat(*(F.lpad(F.hex(F.col(f"{w}{i}").bitwiseAND(0xFFFFFFFF)), 8, "0") for i in range(EACH)))
    prints = (
        least.groupBy("bucket", "pos")
        .agg(F.array_sort(F.collect_list(F.struct("k", hexed("own").alias("own"), hexed("other").alias("other")))).alias("all"))
        .select("bucket", "pos", F.array_join("all.own", "").alias("fingerprint"), F.array_join("all.other", "").alias("edited_fingerprint"))
    )
    whole = about.join(prints, ["bucket", "pos"])
    whole = whole.withColumn("next_fingerprint", F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("pos")))
    return whole.filter("not late").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )


def likeness(one: str, other: str) -> Column:
    """Share of equal samples of two fingerprints."""
    same = (F.expr(f"substring({one}, {8 * i + 1}, 8) = substring({other}, {8 * i + 1}, 8)").cast("int") for i in range(SAMPLES))
    total = None
    for x in same:
        total = x if total is None else total + x
    return total / F.lit(float(SAMPLES))


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(table(spark, sf_dir, "documents"))
