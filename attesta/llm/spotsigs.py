"""SpotSigs document fingerprints, in DataFrame operations only."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bind

# fixed values: common words of the languages of the corpus, the anchors of the signatures
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his in is it its not of on or she that the their "
    "they this to was were which with you "
    "au aux ce cette dans de des du elle en est et il je la le les leur mais ne nous on ou par pas pour que qui sa se ses son sur un une "
    "als am auch auf aus bei das dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit "
    "nicht noch sein sich sie sind und von vor war werden wie wird zu zum zur über "
    "al como con del el ella ellos era esta este ha las lo los más no para pero por se si sin su sus también una unos y ya"
).split()
CHAIN = 2
WORDS_OF = r"[^\p{L}\p{N}]+"


def marked_words(text: Column) -> Column:
    """The content words in order; one after a run of anchors carries the last of them: 'of=house'."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), WORDS_OF, " "))

    def mark(before: Column, word: Column) -> Column:
        return F.when(word.isin(ANCHORS), None).when(before.isin(ANCHORS), F.concat(before, F.lit("="), word)).otherwise(word)

    marked = bind(F.split(plain, " "), lambda w: F.zip_with(F.concat(F.array(F.lit("")), w), w, mark))
    return F.filter(marked, lambda w: w.isNotNull())


def _number(text: Column) -> Column:
    """The first 32 bits of the MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def spot_set(words: Column, chain: int = CHAIN) -> Column:
    """Sorted distinct signatures: an anchor and the `chain` content words from it on, as 32-bit numbers.

    A text without any (few words, no anchor) has one signature, that of all its words together. `words`
    has to be a column, not an expression over the text, which would be computed several times.
    """
    steps = [words, *[F.slice(words, F.lit(i + 1), F.size(words)) for i in range(1, chain)]]
    last = str(chain - 1)
    spots = F.filter(F.arrays_zip(*[s.alias(str(i)) for i, s in enumerate(steps)]), lambda z: z["0"].contains("=") & z[last].isNotNull())
    bare = lambda w: F.substring_index(w, "=", -1)
    sigs = F.transform(spots, lambda z: _number(F.concat_ws(" ", z["0"], *[bare(z[str(i)]) for i in range(1, chain)])))
    return bind(
        sigs, lambda s: F.when(F.size(s) > 0, F.sort_array(F.array_distinct(s))).otherwise(F.array(_number(F.array_join(words, " "))))
    )


def fingerprint(sigs: Column) -> Column:
    """A signature set as text: eight hex digits each, in order."""
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.lower(F.hex(s)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets (neither is ever empty)."""
    return bind(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))


def near_pairs(docs: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(fp_a, fp_b, likeness) of different fingerprints at least `threshold` alike; join `fingerprint` for members.

    Sets are partitioned by length, with bounds that grow by 1 / threshold, so that a set meets only its
    own and the next partition; there it is looked up by its rarest signatures, as many as any partner
    has to share one of. Lengths prune pairs before their likeness is computed. Equal texts are one
    set here, so copies emit no pairs.
    """
    words = docs.select(marked_words(F.col(text)).alias("w"))
    sets = words.select(spot_set(F.col("w")).alias("s")).withColumn("fp", F.sha2(fingerprint(F.col("s")), 256)).groupBy("fp").agg(F.first("s").alias("s"))
    often = sets.select(F.explode("s").alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    part = F.floor(F.log(F.col("size").cast("double")) / F.lit(-log(threshold)) + 1e-9) if threshold < 1 else F.col("size")
    ranked = (
        sets.select("fp", F.size("s").alias("size"), F.explode("s").alias("sig")).join(often, "sig")
        .withColumn("at", F.row_number().over(Window.partitionBy("fp").orderBy("df", "sig")))
        .filter(F.col("at") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1).withColumn("part", part)
    )
    left = ranked.select(F.col("fp").alias("fp_a"), F.col("size").alias("na"), "sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    right = ranked.select(F.col("fp").alias("fp_b"), F.col("size").alias("nb"), "sig", "part")
    order = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("fp_a") < F.col("fp_b")))
    near = left.join(right, ["part", "sig"]).filter(order & (F.col("na") >= threshold * F.col("nb") - 1e-9)).select("fp_a", "fp_b").distinct()
    own = sets.select(F.col("fp").alias("fp_a"), F.col("s").alias("sa")), sets.select(F.col("fp").alias("fp_b"), F.col("s").alias("sb"))
    scored = near.join(own[0], "fp_a").join(own[1], "fp_b").withColumn("likeness", likeness(F.col("sa"), F.col("sb")))
    return scored.filter(F.col("likeness") >= threshold - 1e-12).select("fp_a", "fp_b", "likeness")


def with_next(docs: DataFrame, columns: list[str], key: str, tie: str) -> DataFrame:
    """Rows with `next_<c>` of the row after them in descending `key`; the last row is followed by the first.

    Rows are dealt to ranges of the key (four per shuffle partition), each range is ordered on its own,
    and each gets the first row of the next one as a guest at its end: no task sees more than its ranges.
    Null keys come last; equal keys are ordered by `tie`.
    """
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = docs.select(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []
    marks = sorted(set(marks))
    bounds = F.array(*[F.lit(m) for m in marks]).cast("array<bigint>")
    dealt = docs.withColumn("_range", F.when(F.col(key).isNull(), -1).otherwise(F.size(F.filter(bounds, lambda b: b < F.col(key)))))
    # one row per range: its greatest key (null in the range of null keys)
    tops = dealt.groupBy("_range").agg(F.max(key).alias("_top")).orderBy(F.col("_range").desc()).collect()
    after = {tops[i]["_range"]: tops[(i + 1) % len(tops)] for i in range(len(tops))}
    if not tops:
        empty = dealt.drop("_range")
        return empty.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    hosts = spark.createDataFrame([(t["_range"], t["_top"], r) for r, t in after.items()], "_from int, _top long, _host int")
    firsts = Window.partitionBy("_from").orderBy(F.col(tie).asc_nulls_first())
    guests = (
        dealt.join(F.broadcast(hosts), (F.col("_range") == F.col("_from")) & F.col(key).eqNullSafe(F.col("_top")))
        .withColumn("_n", F.row_number().over(firsts)).filter("_n = 1").withColumn("_range", F.col("_host"))
    )
    both = dealt.withColumn("_guest", F.lit(0)).unionByName(guests.withColumn("_guest", F.lit(1)).select(*dealt.columns, "_guest"))
    order = Window.partitionBy("_range").orderBy("_guest", F.col(key).desc_nulls_last(), F.col(tie).asc_nulls_first())
    return both.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).filter("_guest = 0").drop("_guest", "_range")


def edited(text: Column, following: Column, n_chars: Column) -> Column:
    """`text` with its last half (rounded down) replaced by as many first characters of the following text."""
    half = F.floor(n_chars / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n_chars - half).cast("int")), F.substring(following, F.lit(1), half))


def compare(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness and that to the next document.

    One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. A null text counts as empty; the next document is that of the next lower id (after the
    last the first; repeated ids in the order of their texts; null ids last). Other columns are left out.
    """
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumn("w", marked_words(F.col("text"))).select("doc_id", "text", spot_set(F.col("w")).alias("s"))
    pairs = with_next(own, ["text", "s"], "doc_id", "text").withColumn("n_chars", F.length("text").cast("bigint"))
    pairs = pairs.withColumn("e", edited(F.col("text"), F.col("next_text"), F.col("n_chars")))
    pairs = pairs.select("doc_id", "n_chars", "s", "next_s", F.sha2("e", 256).alias("edited_sha256"), marked_words(F.col("e")).alias("w"))
    pairs = pairs.select("doc_id", "n_chars", "s", "next_s", "edited_sha256", spot_set(F.col("w")).alias("e"))
    return pairs.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("s")).alias("fingerprint"), fingerprint(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("e")).alias("near_edited"), likeness(F.col("s"), F.col("next_s")).alias("near_next"),
    )


_IN = "(" + ", ".join(f"'{a}'" for a in sorted(set(ANCHORS))) + ")"


def _sql_words(text: str) -> str:
    return f"string_split(trim(regexp_replace(lower({text}), '{WORDS_OF}', ' ', 'g')), ' ')"


def _sql_set(text: str) -> str:
    mark = f"list_transform({text}, lambda w, i: CASE WHEN w IN {_IN} THEN NULL WHEN i > 1 AND {text}[i - 1] IN {_IN} THEN {text}[i - 1] || '=' || w ELSE w END)"
    return f"list_filter({mark}, lambda w: w IS NOT NULL)"


_SIGS = """list_transform(list_filter(range(1, len({w})), lambda i: contains({w}[i], '=')), lambda i: substr(md5({w}[i] || ' ' || string_split({w}[i + 1], '=')[-1]), 1, 8))"""


def _sql_final(w: str) -> str:
    sigs = _SIGS.format(w=w)
    return f"CASE WHEN len({sigs}) > 0 THEN list_sort(list_distinct({sigs})) ELSE [substr(md5(array_to_string({w}, ' ')), 1, 8)] END"


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, length(text) AS n_chars, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text FROM d),
e AS (SELECT *, left(text, n_chars - n_chars // 2) || left(next_text, n_chars // 2) AS e FROM n),
p AS MATERIALIZED (SELECT doc_id, n_chars, e, {_sql_words('text')} AS p1, {_sql_words('e')} AS p2, {_sql_words('next_text')} AS p3 FROM e),
w AS MATERIALIZED (SELECT doc_id, n_chars, e, {_sql_set('p1')} AS w1, {_sql_set('p2')} AS w2, {_sql_set('p3')} AS w3 FROM p),
s AS MATERIALIZED (SELECT doc_id, n_chars, e, {_sql_final('w1')} AS s1, {_sql_final('w2')} AS s2, {_sql_final('w3')} AS s3 FROM w)
SELECT doc_id, n_chars, sha256(e) AS edited_sha256, array_to_string(s1, '') AS fingerprint, array_to_string(s2, '') AS edited_fingerprint,
  len(list_intersect(s1, s2)) / (len(s1) + len(s2) - len(list_intersect(s1, s2))) AS near_edited,
  len(list_intersect(s1, s3)) / (len(s1) + len(s3) - len(list_intersect(s1, s3))) AS near_next
FROM s
"""
